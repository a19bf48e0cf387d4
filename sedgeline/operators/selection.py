"""Quotas, caps, splits and representatives over candidate rows.

Ranks are taken within a group by windows; where one group may hold much of a table
and only its first rows matter, the rank is limited, so that partial ranks keep no more than
these of any partition (Spark pushes ``rank <= k`` below the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgeline import vocab
from sedgeline.functions import text as text_functions
from sedgeline.joins import attach
from sedgeline.scratch import stored
from sedgeline.sizing import small


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def fill_quotas(df: DataFrame, cell: list[str], quota: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of each cell up to its quota (cell, quota); most bounds any quota."""
    w = Window.partitionBy(*cell).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    return ranked.join(small(quota), cell).where(F.col("_rank") <= F.col("quota")).drop("_rank", "quota")


def balanced_size(counts: DataFrame, n: str = "n", least: int = 400, target: int = 500) -> DataFrame:
    """One row: the size that every cell can give, at most the target, and whether it is enough."""
    return counts.agg(F.least(F.coalesce(F.min(n), F.lit(0)), F.lit(target)).alias("size")).withColumn("enough", F.col("size") >= least)


def resized(df: DataFrame, cell: list[str], order: list[Column], least: int = 400, target: int = 500, full: int = 475) -> tuple[DataFrame, DataFrame]:
    """(rows, claim): the first rows of every cell, as many of each as all can give (``balanced_size``), none if that is too
    few; claim: one row (size, enough, full), full if the size allows to call the build a full one."""
    n = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    claim = balanced_size(n, "n", least, target).withColumn("full", F.col("size") >= full)
    size, enough, _ = claim.first()  # one row
    return top_per_group(df, cell, order, size if enough else 0), claim


def family_cap(df: DataFrame, family: list[str], order: list[Column], most: int = 2) -> DataFrame:
    return top_per_group(df, family, order, most)


def representatives(df: DataFrame, by: list[str], key: str, order: list[Column]) -> DataFrame:
    """The rows with ``retained``, the key of their group's best row, and ``is_duplicate``.

    The best row is a rank of at most 1, of which every partition keeps one row a group
    before the shuffle, and rows of large groups are met by broadcast (``joins.attach``): a large group
    never meets in a task. Rows with a null in ``by`` belong to no group: null and null.
    """
    rows = df.dropna(subset=by)
    best = top_per_group(rows, by, order, 1).select(*by, F.col(key).alias("retained"))
    sized = stored(best.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by), "representatives")
    met = attach(rows, sized, by, "_n").select(*df.columns, "retained")
    alone = F.col(by[0]).isNull()
    for b in by[1:]:
        alone = alone | F.col(b).isNull()
    none = df.where(alone).withColumn("retained", F.lit(None).cast(df.schema[key].dataType))
    return met.unionByName(none).withColumn("is_duplicate", F.col(key) != F.col("retained"))


def share_caps(df: DataFrame, cell: list[str], value: str, cap: float) -> DataFrame:
    """(cell, value, n, share, over): each value's share of its cell, and whether it is above a cap."""
    n = df.groupBy(*cell, value).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy(*cell).agg(F.sum("n").alias("_whole"))
    return n.join(whole, cell).withColumn("share", F.col("n") / F.col("_whole")).withColumn("over", F.col("share") > cap).drop("_whole")


def within_caps(df: DataFrame, cell: list[str], quota: Column, caps: dict[str, float], order: list[Column]) -> DataFrame:
    """The rows of each cell that fit under the caps: of each value of a capped column at most cap x quota
    rows, the first ones by the order, one column after the other (so the second cap counts what the
    first left), then at most quota rows of the cell.

    quota: a column of df. Every rank is limited, so partitions keep no more than they may give.
    """
    most = df.agg(F.max(quota)).first()[0] or 0
    out = df
    for column, cap in [*caps.items(), (None, 1.0)]:
        by = cell if column is None else [*cell, column]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        out = out.withColumn("_rank", rank).where(F.col("_rank") <= int(most * cap)).where(F.col("_rank") <= F.floor(quota * cap)).drop("_rank")
    return out


def rarity(df: DataFrame, cell: list[str], value: str, name: str = "rarity") -> DataFrame:
    """df with the number of rows of its cell that share a value: small for rare ones. Nulls are a value."""
    n = df.groupBy(*cell, value).agg(F.count(F.lit(1)).alias(name))
    keys = [*cell, value]
    renamed = stored(n.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), name), "rarity")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(small(renamed), same, "left").select(*df.columns, name)


def quota_controller(rows: DataFrame, targets: DataFrame, key: str, cell: str, options: str, order: list[Column]) -> DataFrame:
    """(key, cell, option): one option for each row that gets one, filling the short options of a cell.

    rows: key, cell, options (array<string>); targets: (cell, option, target). In each cell the options are
    filled from the scarcest (candidates against target) to the most plentiful, each with the
    first rows by the order that no option before took; at most as many steps as a cell has
    options, each for all cells at once.
    """
    each = rows.select("*", F.explode(F.array_distinct(options)).alias("_o"))
    supply = each.groupBy(cell, F.col("_o").alias("option")).agg(F.count(F.lit(1)).alias("_n"))
    plan = targets.join(supply, [cell, "option"], "left").where("target > 0")
    turn = F.row_number().over(Window.partitionBy(cell).orderBy(F.coalesce("_n", F.lit(0)) / F.col("target"), "option"))
    plan = stored(plan.select(cell, F.col("option").alias("_want"), "target", turn.alias("_turn")), "turns")
    steps, most = plan.agg(F.max("_turn"), F.max("target")).first()  # a plan's lines
    left, out = rows, None
    for k in range(1, (steps or 0) + 1):
        now = left.join(small(plan.where(F.col("_turn") == k)), cell).where(F.array_contains(options, F.col("_want")))
        rank = F.row_number().over(Window.partitionBy(cell).orderBy(*order))
        took = now.withColumn("_rank", rank).where(F.col("_rank") <= int(most)).where("_rank <= target")
        took = stored(took.select(key, cell, F.col("_want").alias("option")), "taken")
        out = took if out is None else out.unionByName(took)
        left = left.join(took.select(key), key, "left_anti")
    return out if out is not None else rows.select(key, cell, F.lit(None).cast("string").alias("option")).limit(0)


def hash_split(key: Column, seed: int = 0, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)), given: Column | None = None) -> Column:
    """A split by a hash of the family (the first 32 bits of the SHA-256 of seed and key); a split given
    by the source comes first."""
    u = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), F.lit(8)), 16, 10).cast("long") / float(1 << 32)
    out, top = F.lit(shares[-1][0]), sum(s for _, s in shares)
    for name, s in reversed(shares[:-1]):
        top = sum(x for n, x in shares[: [k for k, _ in shares].index(name) + 1])
        out = F.when(u < top, name).otherwise(out)
    return F.when(key.isNull(), None).otherwise(out) if given is None else F.coalesce(given, F.when(key.isNotNull(), out))


def stratified_sample(df: DataFrame, strata: list[str], key: str, part: float, least: int = 1) -> DataFrame:
    """A part of each stratum, at least ``least`` rows where it has them: the first ceil(part x stratum) rows by
    the MD5 of their key.

    Strata are not sorted: a histogram over the hash's first twelve bits shows in which of 4,096
    buckets the part ends. Buckets before it are taken whole, and only that one is ranked. Null strata are left out.
    """
    hashed = df.dropna(subset=strata).withColumn("_h", F.md5(F.col(key).cast("string")))
    hashed = hashed.withColumn("_b", F.conv(F.left("_h", F.lit(3)), 16, 10).cast("int"))
    n = hashed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata)
    run = n.withColumn("_to", F.sum("_n").over(w.orderBy("_b"))).withColumn("_all", F.sum("_n").over(w))
    want = F.greatest(F.ceil(F.col("_all") * part), F.lit(least))
    left = run.withColumn("_left", want - (F.col("_to") - F.col("_n"))).where("_left > 0")
    rows = hashed.join(left.select(*strata, "_b", "_left", (F.col("_left") < F.col("_n")).alias("_last")), [*strata, "_b"])
    rank = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    last = rows.where("_last").withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).drop("_rank")
    return rows.where("not _last").unionByName(last).select(*df.columns)


def quality(scores: list[str], total: int = 9, non_zero: list[str] | None = None) -> Column:
    """Whether scores of 0 to 2 add up to enough, none of some being zero."""
    s = sum((F.coalesce(F.col(c), F.lit(0)) for c in scores), F.lit(0)) >= total
    for c in non_zero or []:
        s = s & (F.coalesce(F.col(c), F.lit(0)) > 0)
    return s


def route(*candidates: Column) -> Column:
    """The first source of a value that has one, in order of priority."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates))


def routed(df: DataFrame, explicit: str, known: list[str], mapping: DataFrame, key: str, keywords: list[tuple[str, str]], text: str) -> DataFrame:
    """df with ``routed`` and ``routed_by``: the explicit value if it is a known one (metadata), else the one that the
    mapping (key, value) gives for the row's key (mapping), else the first keyword pattern that the text meets
    (keyword), else null (unresolved). A key mapped to several values maps to none."""
    one = mapping.dropna().groupBy(key).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).where("_lo = _hi").select(F.col(key).alias("_key"), F.col("_lo").alias("_mapped"))
    met = df.join(small(one), F.col(key) == F.col("_key"), "left")
    own = F.when(F.col(explicit).isin(*known), F.col(explicit))
    by_word = F.coalesce(*(F.when(F.col(text).rlike(p), v) for p, v in keywords), F.lit(None).cast("string"))
    how = F.when(own.isNotNull(), "metadata").when(F.col("_mapped").isNotNull(), "mapping").when(by_word.isNotNull(), "keyword").otherwise("unresolved")
    return met.withColumns({"routed": F.coalesce(own, "_mapped", by_word), "routed_by": how}).drop("_key", "_mapped")


def band(score: Column, low: float, high: float) -> Column:
    """accept, review or reject, by a threshold with a band of doubt."""
    return F.when(score >= high, "accept").when(score >= low, "review").when(score.isNotNull(), "reject")


def boilerplate(df: DataFrame, text: Column, length: int = 40, least: int = 10) -> DataFrame:
    """(opening, n): openings of at least so many rows."""
    return df.select(F.left(text, F.lit(length)).alias("opening")).where("opening <> ''").groupBy("opening").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def build_gates(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, violations, passed): rows that break each gate, all counted in one pass."""
    n = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(g) for g, c in gates.items()))
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("violations"), (F.col(g) == 0).alias("passed")) for g in gates))
    return n.select(F.inline(rows))


def combine(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base and those rows of new whose key base lacks: every key once."""
    return base.dropDuplicates([key]).unionByName(new.dropDuplicates([key]).join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def replay_weights(df: DataFrame, is_replay: Column, replay: float = 0.1) -> DataFrame:
    """The rows with ``weight``, so that replay rows make up a part of the whole without being copied.
    The rows are counted here and now. Null means no replay row."""
    is_replay = F.coalesce(is_replay, F.lit(False))
    n = df.agg(F.count_if(is_replay).alias("r"), F.count_if(~is_replay).alias("f")).first()
    return df.withColumn("weight", F.when(is_replay, replay / max(n.r, 1)).otherwise((1 - replay) / max(n.f, 1)))


def budget(events: DataFrame, stage: str = "stage", tokens: str = "tokens", cost: str = "cost") -> DataFrame:
    """(stage, calls, tokens, cost)."""
    return events.groupBy(stage).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost"))


def fallback(first: DataFrame, second: DataFrame, least: int = 1500) -> DataFrame:
    """The first table if it has enough rows, else the second."""
    return first if first.limit(least).count() >= least else second


def translated_well(source: Column, target: Column, low: float = 0.4, high: float = 2.5, least_script: float = 0.5, script: str | None = None) -> Column:
    """Whether a translation can be kept: neither side blank, a length between ``low`` and ``high`` times the source's, the
    same numbers in any order, and, where a script is named, enough of its letters in the target."""
    a, b = F.length(F.trim(F.coalesce(source, F.lit("")))), F.length(F.trim(F.coalesce(target, F.lit(""))))
    same = F.array_sort(text_functions.numbers(source)) == F.array_sort(text_functions.numbers(target))
    ok = (a > 0) & (b > 0) & (b >= low * a) & (b <= high * a) & same
    return F.coalesce(ok if script is None else ok & (text_functions.script_share(target, script) >= least_script), F.lit(False))


def default_error_class(error_type: Column) -> Column:
    """The class an error type has by default; null for none, and for types decided case by case."""
    out = F.lit(None).cast("string")
    for name, types in vocab.DEFAULT_ERROR_CLASSES.items():
        out = F.when(error_type.isin(*types), name).otherwise(out)
    return out


def fertility(df: DataFrame, tokens: str, words: str, *by: str) -> DataFrame:
    """(by, fertility): tokens a word."""
    return df.groupBy(*by).agg((F.sum(tokens) / F.nullif(F.sum(words), F.lit(0))).alias("fertility"))


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, of different columns, side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*(F.max(c).alias(c) for c in out.columns))
