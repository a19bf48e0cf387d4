from pyspark.sql import functions as F

from sedgeline.functions import answers, identity, sql, text

STRINGS = ["", None, "3 × 4 ÷ 2 − 1", "1,234,567 and 12,34", "４２ ｋｇ", "Straße ǅ", "In ( a ) b , c", "<<1+1=2>>2 #### -7", "a\u00a0b\u001cc"]


def test_sql_names_equal_columns(spark):
    sql.register(spark)
    spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "i int, c string").createOrReplaceTempView("strings")
    pairs = {"norm_v0": text.norm_v0, "hash_v0": identity.hash_v0, "norm_v1": text.norm_v1, "content_hash": identity.content_hash, "find_artifact": text.find_artifact, "final_answer": answers.final_answer, "has_markup": text.has_markup}
    for name, f in pairs.items():
        got = [r.v for r in spark.sql(f"SELECT {name}(c) AS v FROM strings ORDER BY i").collect()]
        want = [r.v for r in spark.table("strings").orderBy("i").select(f(F.col("c")).alias("v")).collect()]
        assert got == want, name
