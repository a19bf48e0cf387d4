"""Supply census: which records count, for which cells, from which sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeline import vocab
from sedgeline.operators.selection import one_row
from sedgeline.sizing import small


def decided(inventory: DataFrame, sources: DataFrame, decisions: DataFrame | None = None, key: str = "record_no", strict: bool = True) -> DataFrame:
    """The inventory with ``reasons`` for rejection, in a fixed order: the record's own, then the
    source's, the record's against the source, the hard gate, and the firewall's.

    decisions: (key, reasons) of the firewall; without it every record lacks a frozen
    evaluation. strict: an unknown source is an error, else its records are rejected.
    """
    s = small(sources.select(F.col("id").alias("source_id"), F.struct("allowed_use", "revision", "imported_split", "license_class").alias("_s")).dropDuplicates(["source_id"]))
    of = inventory.join(s, "source_id", "left")
    unknown = F.col("_s").isNull()
    error = F.concat(F.lit("inventory references unknown source "), F.coalesce("source_id", F.lit("null")))
    if decisions is not None:
        of = of.join(decisions.select(key, F.col("reasons").alias("_firewall")), key, "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    gates = F.array_compact(
        F.array(
            F.when(unknown, F.raise_error(error).cast("string") if strict else F.lit("unknown_source")),
            F.when(~F.coalesce("_s.allowed_use", F.lit(False)) & ~unknown, "source_not_approved"),
            F.when((F.coalesce("_s.revision", F.lit("")) == "") & ~unknown, "revision_not_pinned"),
            F.when(differs("source_split", "_s.imported_split") & ~unknown, "split_mismatch"),
            F.when(~F.col("grade_band").eqNullSafe(vocab.GRADE_BAND), "outside_target_grade"),
            F.when(differs("license_class", "_s.license_class") & ~unknown, "license_class_mismatch"),
            F.when(~F.coalesce("hard_gate_pass", F.lit(False)), "hard_gate_failed"),
        )
    )
    empty = F.array().cast("array<string>")
    last = F.coalesce("_firewall", empty) if decisions is not None else F.array(F.lit("frozen_eval_manifest_missing"))
    return of.withColumn("reasons", F.concat(F.coalesce("rejection_reasons", empty), gates, last)).drop("_s", "_firewall")


def accepted_cells(decided_: DataFrame) -> DataFrame:
    """(source_id, family_id, subject, behavior) of accepted records; behaviors that need grounding have it."""
    each = decided_.where(F.size("reasons") == 0).select("source_id", "family_id", "subject", "grounding_available", F.explode("eligible_behaviors").alias("behavior"))
    return each.where(~F.col("behavior").isin(*vocab.GROUNDED_BEHAVIORS) | F.col("grounding_available")).drop("grounding_available")


#: What to do about a short cell; own wording, to be replaced as needed, by subject or for any.
REMEDIES = {None: ("pin and approve more sources", "import records that pass the gates", "add structured sources before any generation")}


def cells(decided_: DataFrame, minimum: int = vocab.CELL_MINIMUM, target: int = vocab.CELL_TARGET, remedies: dict | None = None) -> DataFrame:
    """All cells of subject and behavior: distinct families across sources, by source (which may
    add up to more), the gap to the minimum, the status, and for short ones the remedies."""
    spark = decided_.sparkSession
    spine = spark.createDataFrame([(s, b) for s in vocab.SUBJECTS for b in vocab.BEHAVIORS], "subject string, behavior string")
    each = accepted_cells(decided_)
    total = each.groupBy("subject", "behavior").agg(F.count_distinct("family_id").alias("families"))
    by_source = each.groupBy("subject", "behavior", "source_id").agg(F.count_distinct("family_id").alias("n"))
    listed = by_source.groupBy("subject", "behavior").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "n")))).alias("by_source"))  # sources a cell
    out = spine.join(total, ["subject", "behavior"], "left").join(listed, ["subject", "behavior"], "left")
    n = F.coalesce("families", F.lit(0))
    return out.select("subject", "behavior", n.alias("families"), F.lit(target).alias("preferred_target"), F.lit(minimum).alias("minimum"), F.greatest(F.lit(minimum) - n, F.lit(0)).alias("gap"), F.when(n >= minimum, "ready").otherwise("short").alias("status"), F.coalesce("by_source", F.create_map().cast("map<string,bigint>")).alias("by_source"), _remedies(remedies or REMEDIES, n < minimum).alias("remediation"))


def _remedies(of: dict, short) -> Column:
    words = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    out = words(of.get(None, ()))
    for subject, xs in of.items():
        if subject is not None:
            out = F.when(F.col("subject") == subject, words(xs)).otherwise(out)
    return F.when(short, out).otherwise(words(()))


def gate_a(decided_: DataFrame, sources: DataFrame, registry_rows: DataFrame, schema_fields: int, minimum: int = vocab.CELL_MINIMUM) -> DataFrame:
    """One row: the columns of the schema, the sources, the rows of the registry's tables (table_name, row_count), and the
    census with its decision; may_start only if every cell is ready."""
    held = registry_rows.agg(F.sum("row_count").alias("registry_rows"), F.count(F.lit(1)).alias("registry_tables"))
    listed = sources.agg(F.count(F.lit(1)).alias("source_count"))
    whole = one_row(summary(decided_, sources, minimum), held, listed)
    return whole.withColumns({"phase": F.lit("A"), "schema_fields": F.lit(schema_fields), "tooling_complete": F.col("ready_cells") + F.col("short_cells") == len(vocab.SUBJECTS) * len(vocab.BEHAVIORS), "may_start": F.col("all_ready")})


def by_source(decided_: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, inventory_rows, counted_families, rejected_rows) of every source, 0 without records.
    Families count even if no cell takes them."""
    ok = F.size("reasons") == 0
    n = decided_.groupBy("source_id").agg(F.count(F.lit(1)).alias("inventory_rows"), F.count_distinct(F.when(ok, F.col("family_id"))).alias("counted_families"), F.count_if(~ok).alias("rejected_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.select(F.col("id").alias("source_id")).join(small(n), "source_id", "left").select("source_id", zero("inventory_rows"), zero("counted_families"), zero("rejected_rows"))


def summary(decided_: DataFrame, sources: DataFrame, minimum: int = vocab.CELL_MINIMUM) -> DataFrame:
    """One row: rows seen, approved sources, ready and short cells, and the decision."""
    c = cells(decided_, minimum).agg(F.count_if(F.col("status") == "ready").alias("ready_cells"), F.count_if(F.col("status") == "short").alias("short_cells"), F.bool_and(F.col("status") == "ready").alias("all_ready"))
    seen, approved = decided_.agg(F.count(F.lit(1)).alias("inventory_rows_seen")), sources.agg(F.count_if("allowed_use").alias("approved_sources"))
    return one_row(seen, approved, c).withColumn("supply_decision", F.when(F.col("all_ready"), "go").otherwise("blocked_short_cells"))


def reason_counts(decided_: DataFrame) -> DataFrame:
    """(reason, row_count)."""
    return decided_.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))
