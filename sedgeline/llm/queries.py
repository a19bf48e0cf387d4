"""The training-data queries and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgeline import scratch
from sedgeline.llm import common, copies, languages, leakage, leaks, mixing, neardup, oracles, sampling, splits, tokens
from sedgeline.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Problem 2


@query
def p2_found(spark, d):
    return copies.found(table(spark, d, "inventory"), table(spark, d, "training_rows"))


@query
def p2_collapsed(spark, d):
    return copies.collapsed(table(spark, d, "inventory"), table(spark, d, "training_rows"))


# Problem 7


@query
def p7_ids(spark, d):
    return tokens.encode(table(spark, d, "documents"))


@query
def p7_spans(spark, d):
    return tokens.spans(table(spark, d, "documents"))


@query
def p7_decoded(spark, d):
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


@query
def p7_coverage(spark, d):
    """(doc_id, covered, gaps, aligned): characters up to the last token's end, characters between two tokens that none covers, and
    whether ids, starts and ends are equally many."""
    s = tokens.spans(table(spark, d, "documents"))
    between = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ids") - 1, F.lit(1))), lambda i: F.greatest(F.coalesce(F.try_element_at("starts", i + 1) - F.try_element_at("ends", i), F.lit(0)), F.lit(0)))
    gaps = F.aggregate(between, F.lit(0), lambda a, x: a + x) + F.coalesce(F.try_element_at("starts", F.lit(1)), F.lit(0))
    aligned = (F.size("starts") == F.size("ids")) & (F.size("ends") == F.size("ids"))
    return s.select("doc_id", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).alias("covered"), gaps.alias("gaps"), aligned.alias("aligned"))


@query
def p7_fertility(spark, d):
    """(lang, documents, fertility): tokens a word, by the label of the document."""
    return tokens.fertility(table(spark, d, "documents"))


# Problem 1


def _components(spark, rows, parts: int = 1):
    """The component table, kept below the shared folder by loading the rows in so many batches."""
    kept = splits.SplitTable(spark, f"{scratch.root(spark)}/components-{uuid.uuid4().hex}")
    for k in range(parts):
        kept.update(rows if parts == 1 else rows.where(F.pmod(F.xxhash64("line_no"), F.lit(parts)) == k), None)
    return kept


@query
def p1_found(spark, d):
    rows = table(spark, d, "training_rows")
    return splits.torn(rows, table(spark, d, "build_membership"), _components(spark, rows))


@query
def p1_splits(spark, d):
    rows = table(spark, d, "training_rows")
    return splits.assign(rows, table(spark, d, "build_membership"), table(spark, d, "split_plan"), _components(spark, rows))


@query
def p1_shares(spark, d):
    rows, plan = table(spark, d, "training_rows"), table(spark, d, "split_plan")
    return splits.shares(rows, splits.assign(rows, table(spark, d, "build_membership"), plan, _components(spark, rows)), plan)


@query
def p1_checks(spark, d):
    """(build_name, families, quarantined, evaluated, kept_in_train, torn_components): what an assignment must keep: every family has one
    split a build, torn components are quarantined, those with evaluation rows only stay out of train, the others with rows in it."""
    rows, membership = table(spark, d, "training_rows"), table(spark, d, "build_membership")
    kept = _components(spark, rows)
    given = scratch.stored(splits.assign(rows, membership, table(spark, d, "split_plan"), kept), "assigned")
    component = kept.read().select(common.hash_text(F.col("family")).alias("family_id"), "component")
    met = given.join(component, "family_id")
    flags = splits.build_families(kept.rows(), membership).join(kept.read().select("family", "component"), "family").groupBy("build_name", "component").agg(F.max("evaluation").alias("e"), F.max("other").alias("o"))
    of = met.join(flags, ["build_name", "component"], "left")
    n = of.groupBy("build_name").agg(
        F.count_distinct("family_id").alias("families"),
        F.count_if(F.col("split") == splits.QUARANTINE).alias("quarantined"),
        F.count_if(F.col("e") & ~F.col("o") & F.col("split").isin("test", "validation")).alias("evaluated"),
        F.count_if(F.col("o") & ~F.col("e") & (F.col("split") == "train")).alias("kept_in_train"),
    )
    torn = met.groupBy("build_name", "component").agg(F.count_distinct("split").alias("k")).groupBy("build_name").agg(F.count_if(F.col("k") > 1).cast("int").alias("torn_components"))
    return n.join(torn, "build_name")


def _named(kept):
    return kept.read().select(common.hash_text(F.col("family")).alias("family_id"), common.hash_text(F.col("component")).alias("component_id"))


@query
def p1_components(spark, d):
    """The component of every family, its smallest family, from one load."""
    return _named(_components(spark, table(spark, d, "training_rows")))


@query
def p1_incremental(spark, d):
    """The same from three batches by a hash of the line, so that most ties cross batches."""
    return _named(_components(spark, table(spark, d, "training_rows"), 3))


ORACLE_SQL["p1_components"] = ORACLE_SQL["p1_incremental"] = """
WITH RECURSIVE
rows_ AS (SELECT DISTINCT regexp_extract(lower(row_id), '[0-9a-f]{64}') AS row_id, regexp_extract(lower(family_id), '[0-9a-f]{64}') AS family, regexp_extract(lower(duplicate_of), '[0-9a-f]{64}') AS dup FROM training_rows),
edge AS (SELECT DISTINCT a.family AS a, b.family AS b FROM rows_ a JOIN rows_ b ON a.dup = b.row_id WHERE a.family <> b.family),
both_ AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
tied AS (SELECT family AS a, family AS b FROM rows_ WHERE family <> '' UNION SELECT a, b FROM reach)
SELECT 'sha256:' || a AS family_id, 'sha256:' || min(b) AS component_id FROM tied GROUP BY a
"""


ORACLE_SQL["p1_found"] = """
WITH RECURSIVE
rows_ AS (SELECT DISTINCT regexp_extract(lower(row_id), '[0-9a-f]{64}') AS row_id,
                 regexp_extract(lower(family_id), '[0-9a-f]{64}') AS family,
                 regexp_extract(lower(duplicate_of), '[0-9a-f]{64}') AS dup FROM training_rows),
edge AS (SELECT DISTINCT a.family AS a, b.family AS b FROM rows_ a JOIN rows_ b ON a.dup = b.row_id WHERE a.family <> b.family),
both_ AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
tied AS (SELECT family AS a, family AS b FROM rows_ UNION SELECT a, b FROM reach),
mem AS (SELECT DISTINCT m.build_name, r.family, lower(trim(m.membership)) = 'evaluation' AS ev
        FROM build_membership m JOIN rows_ r ON regexp_extract(lower(m.row_id), '[0-9a-f]{64}') = r.row_id),
state AS (SELECT m.build_name, t.a AS family, bool_or(m.ev) AS e, bool_or(NOT m.ev) AS o FROM mem m JOIN tied t ON t.b = m.family GROUP BY ALL)
SELECT s.build_name, 'sha256:' || s.family AS family_id FROM state s
WHERE s.e AND s.o AND EXISTS (SELECT 1 FROM mem m WHERE m.build_name = s.build_name AND m.family = s.family)
"""


# Problem 6


@query
def p6_found(spark, d):
    return neardup.found(table(spark, d, "inventory"))


@query
def p6_groups(spark, d):
    return neardup.grouped(table(spark, d, "inventory"))


# Problem 3


@query
def p3_found(spark, d):
    return leaks.found(table(spark, d, "inventory"), table(spark, d, "training_rows"), table(spark, d, "source_records"))


@query
def p3_fractions(spark, d):
    return leaks.overlap_fractions(table(spark, d, "inventory"))


@query
def p3_overlapping(spark, d):
    """The evaluation records of the inventory that come back in the training split, without pairs."""
    inventory = table(spark, d, "inventory")
    return leaks.overlapping(inventory, leaks._chunked_inventory(inventory)).withColumnRenamed("id", "record_no")


@query
def p3_row_report(spark, d):
    """The part of the report on training_rows."""
    return leaks.row_report(table(spark, d, "training_rows"), table(spark, d, "source_records")).select("source", "split", "record_count", "overlapping")


@query
def p3_classes(spark, d):
    return leaks.classes(table(spark, d, "inventory"))


@query
def p3_report(spark, d):
    return leaks.report(table(spark, d, "inventory"), table(spark, d, "training_rows"), table(spark, d, "source_records"))


# Problem 4


def _mix(spark, d):
    return table(spark, d, "mix_plan"), table(spark, d, "inventory"), table(spark, d, "sources")


@query
def p4_found(spark, d):
    return mixing.found(*_mix(spark, d))


@query
def p4_mix(spark, d):
    return mixing.draw(*_mix(spark, d))


@query
def p4_shares(spark, d):
    return mixing.shares(*_mix(spark, d))


ORACLE_SQL["p4_found"] = """
SELECT m.mix_name, lower(trim(m.dataset)) AS dataset FROM mix_plan m
LEFT JOIN (SELECT lower(trim(s.dataset)) AS dataset, s.license_class, sum(length(i.canonical_prompt)) AS chars
           FROM sources s JOIN inventory i ON i.source_id = s.id GROUP BY ALL) x
  ON x.dataset = lower(trim(m.dataset)) AND x.license_class IS NOT DISTINCT FROM m.license_class
WHERE m.target_share * m.mix_chars > m.max_repeats * coalesce(x.chars, 0)
"""


# Problem 5


def _sample(spark, d):
    return table(spark, d, "sample_plan"), table(spark, d, "balanced_tutoring_v8"), table(spark, d, "inventory")


@query
def p5_found(spark, d):
    return sampling.found(*_sample(spark, d))


@query
def p5_sample(spark, d):
    return sampling.draw(*_sample(spark, d))


@query
def p5_gaps(spark, d):
    return sampling.gaps(*_sample(spark, d))


@query
def p5_shortfalls(spark, d):
    """(sample_name, subject, lack, twice, foreign_records): what a drawn sample's cells lack of their minimums, which must be the least
    possible; records drawn twice for a sample, and drawn for a cell they don't have."""
    plan, cells, inventory = _sample(spark, d)
    sample = scratch.stored(sampling.draw(plan, cells, inventory), "sample")
    by = ["sample_name", "subject", "behavior"]
    n = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    lack = sampling.targets(plan, cells).select(*by, "minimum").distinct().join(n, by, "left").groupBy("sample_name", "subject").agg(F.sum(F.greatest(F.col("minimum") - F.coalesce("n", F.lit(0)), F.lit(0))).cast("long").alias("lack"))
    twice = sample.groupBy("sample_name", "record_no").agg(F.count(F.lit(1)).alias("k"), F.first("subject").alias("subject")).where("k > 1").groupBy("sample_name", "subject").agg(F.count(F.lit(1)).alias("twice"))
    foreign = sample.join(sampling.units(inventory), ["record_no", "subject", "behavior"], "left_anti").groupBy("sample_name", "subject").agg(F.count(F.lit(1)).alias("foreign_records"))
    out = lack.join(twice, ["sample_name", "subject"], "left").join(foreign, ["sample_name", "subject"], "left")
    return out.select("sample_name", "subject", "lack", F.coalesce("twice", F.lit(0)).alias("twice"), F.coalesce("foreign_records", F.lit(0)).alias("foreign_records"))


ORACLE_SQL["p5_found"] = """
WITH inv AS (
  SELECT CASE WHEN s IN ('math', 'maths', 'mathematics') THEN 'math' WHEN s IN ('earth_science', 'earth_sciences') THEN 'earth_science' ELSE s END AS subject, b AS behavior, count(*) AS n
  FROM (SELECT regexp_replace(lower(trim(subject)), '[\\s_-]+', '_', 'g') AS s, unnest(list_distinct(eligible_behaviors)) AS b FROM inventory)
  WHERE s IS NOT NULL GROUP BY ALL)
SELECT p.sample_name, p.subject, p.behavior FROM sample_plan p
LEFT JOIN balanced_tutoring_v8 c ON c.subject = p.subject AND c.behavior = p.behavior
LEFT JOIN inv ON inv.subject = p.subject AND inv.behavior = p.behavior
WHERE coalesce(inv.n, 0) < greatest(coalesce(c.minimum_examples, 0), coalesce(p.target_share, 0) * p.sample_size)
"""


# Problem 8


@query
def p8_found(spark, d):
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_leaks(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_items(spark, d):
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


# Problem 9


@query
def p9_found(spark, d):
    return languages.found(table(spark, d, "documents"))


@query
def p9_segments(spark, d):
    return languages.segments(table(spark, d, "documents"))


@query
def p9_languages(spark, d):
    return languages.identified(table(spark, d, "documents"))
