"""The scalar functions under names of their own in SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from sedgeline import vocab
from sedgeline.functions import answers, text

# Bodies in Spark SQL over the parameter t (and ns); backslashes as in raw strings.
_SPACES = r"r'(?U)[\s\x1c-\x1f]+'"
_TIGHT = r"r'(?U)[\s\x1c-\x1f]*([,.;:!?=+\-*/^(){}\[\]])[\s\x1c-\x1f]*'"
_ONE = r"regexp_replace(translate(nfkc_casefold(t), '−×÷', '-*/'), r'(?U)(?<=\d),(?=\d{3}\b)', '')"
BODIES = {
    "norm_v0": f"trim(regexp_replace(lower(t), {_SPACES}, ' '))",
    "hash_v0": "sha2(norm_v0(t), 256)",
    "norm_v1": f"trim(regexp_replace(regexp_replace({_ONE}, {_TIGHT}, '$1'), {_SPACES}, ' '))",
    "content_hash": f"concat('sha256:', sha2(concat_ws('\\u001f', 'canonical-content', '{vocab.NORMALIZATION}', norm_v1(t)), 256))",
    "find_artifact": f"nullif(regexp_extract(t, r'{text.ARTIFACT}', 1), '')",
    "final_answer": f"nullif(regexp_extract(t, r'{answers.FINAL}', 1), '')",
    "has_markup": f"t rlike r'{text.MARKUP}'",
}
KINDS = {"has_markup": "BOOLEAN"}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to spark.sql in this session; null in, null out. Gives their names.

    All but ``nfkc_casefold`` are SQL expressions, so that Spark optimizes through them.
    """

    @pandas_udf(StringType())
    def nfkc_casefold(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    spark.udf.register("nfkc_casefold", nfkc_casefold)
    for name, body in BODIES.items():
        guarded = f"CASE WHEN t IS NOT NULL THEN {body} END"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {KINDS.get(name, 'STRING')} RETURN {guarded}")
    return ["nfkc_casefold", *BODIES]
