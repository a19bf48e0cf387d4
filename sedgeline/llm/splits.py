"""Splits that keep related records together.

Families tied by ``duplicate_of`` form components. Their table is kept between
runs: new ties only merge existing components, found by hooking each component to
its smallest neighbour and pointer jumping until every one points at a root.
Components that have a split keep it, new ones fill what the splits lack, and
merges of components with different splits are quarantined.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import common
from sedgeline.scratch import store, stored

#: A component with more than this part of all rows is placed by itself, largest
#: first; so at most 1 / this part of them come to the driver.
LARGE_PART = 0.001
QUARANTINE = "quarantine"


def row_families(rows: DataFrame) -> DataFrame:
    """Distinct (row, family), as hash keys; rows without an id or a family are left out."""
    return rows.select(common.hash_key(F.col("row_id")).alias("row"), common.hash_key(F.col("family_id")).alias("family")).dropna().distinct()


def row_points(rows: DataFrame) -> DataFrame:
    """Distinct (row, src): the rows that duplicate_of names, and the families naming them."""
    return rows.select(common.hash_key(F.col("duplicate_of")).alias("row"), common.hash_key(F.col("family_id")).alias("src")).dropna().distinct()


def ties(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: families tied by one duplicate_of. Values that lead
    nowhere, to the row itself or to its own family tie nothing."""
    return _tied(row_points(rows), row_families(rows))


def _tied(points: DataFrame, rows: DataFrame) -> DataFrame:
    both = points.join(rows, "row").where("src <> family")
    return both.select(F.least("src", "family").alias("a"), F.greatest("src", "family").alias("b")).distinct()


def merge_components(existing: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(family, component): of all families in ``existing`` or ``edges``; a component's
    name is its smallest family. A family in neither is a component by itself.

    existing: such a table of an earlier run, or None; edges: (a, b) pairs of
    families. Each round merges components into roots, at least halving those that
    still have edges; jumping takes the logarithm of the longest chain. Every step
    is written to the shared folder, so lost executors cost one step at most.
    """
    edges = store(edges, "edges")
    ends = edges.df.select(F.col("a").alias("family")).union(edges.df.select("b")).distinct()
    if existing is None:
        table = store(ends.withColumn("component", F.col("family")), "components")
    else:
        table = store(ends.join(existing, "family", "full").select("family", F.coalesce("component", "family").alias("component")), "components")
        edges = _relabel(edges, table.df.withColumnsRenamed({"family": "node", "component": "root"}))
    while not edges.df.isEmpty():
        around = edges.df.union(edges.df.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        roots = store(around.select("node", F.least("node", "b").alias("root")), "roots")
        most = _largest(roots.df, "root")[0]
        while True:
            up = roots.df.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = store(_looked_up(roots.df, up, "root", most).select("node", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")), "roots")
            roots.drop()
            roots = jumped
            most, moved = _largest(roots.df, "root", F.bool_or("moved"))
            if not moved:
                break
        renamed = roots.df.select(F.col("node").alias("component"), "root")
        merged = _looked_up(table.df, renamed, "component", _largest(table.df, "component")[0], "left")
        table_next = store(merged.select("family", F.coalesce("root", "component").alias("component")), "components")
        edges = _relabel(edges, roots.df)
        roots.drop()
        table.drop()
        table = table_next
    return table.df


def _largest(df: DataFrame, by: str, *more) -> tuple:
    """(rows of the largest group, more): found with one partial aggregate."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *(m.alias(f"_m{i}") for i, m in enumerate(more)))
    row = n.agg(F.coalesce(F.max("_n"), F.lit(0)), *(F.bool_or(f"_m{i}") for i in range(len(more)))).first()
    return tuple(row)


def _looked_up(rows: DataFrame, unique: DataFrame, by: str, most: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of unique keys. Where a key has more than ``common.HOT_ROWS`` rows (most: the
    largest group), as the name of a giant component may, such keys are broadcast, at most 10,000 of them."""
    if most <= common.HOT_ROWS:
        return rows.join(unique, by, how)
    n = stored(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    sized = stored(n.join(unique, by, how), "sized-keys")
    return common.attach(rows, sized, [by], "_n").drop("_n")


def _relabel(edges, roots: DataFrame):
    """The edges between roots; edges within a root are gone."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    to = edges.df.join(a, "a").join(b, "b").where("ra <> rb")
    out = store(to.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    edges.drop()
    return out


def _with_component(df: DataFrame, components: DataFrame) -> DataFrame:
    return df.join(components, "family", "left").withColumn("component", F.coalesce("component", "family"))


def build_families(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """(build_name, family, evaluation, other): the families with a row in a build, and
    whether some row of theirs has the membership evaluation, or another one. rows: (row, family), distinct."""
    value = common.spelled(F.col("membership"))
    of_row = (
        membership.select("build_name", common.hash_key(F.col("row_id")).alias("row"), (value == "evaluation").alias("e"), (value != "evaluation").alias("o"))
        .dropna(subset=["build_name", "row"])
        .groupBy("build_name", "row")
        .agg(F.coalesce(F.max("e"), F.lit(False)).alias("e"), F.coalesce(F.max("o"), F.lit(False)).alias("o"))
    )
    return of_row.join(rows, "row").groupBy("build_name", "family").agg(F.max("e").alias("evaluation"), F.max("o").alias("other"))


def torn(rows: DataFrame, membership: DataFrame, kept: SplitTable | None = None) -> DataFrame:
    """(build_name, family_id): families of which the tied families, itself included,
    have in a build a row with membership evaluation and a row with another one.

    Memberships of rows that don't exist, null builds and null memberships count
    for nothing. Families without ties are judged where they are; only tied ones,
    the few, are brought together by component. kept: a component table that has taken in the rows.
    """
    components, own = (merge_components(None, ties(rows)), row_families(rows)) if kept is None else (kept.read(), kept.rows())
    led = components.where("family <> component").select("family", "component")
    components = stored(led.union(led.select(F.col("component").alias("family"), "component").distinct()), "tied-families")
    families = stored(build_families(own, membership).join(components, "family", "left"), "build-families")
    alone = families.where("component is null and evaluation and other").select("build_name", "family")
    tied = families.where("component is not null").select("build_name", "component", "family", "evaluation", "other")
    by = ["build_name", "component"]
    bad = tied.groupBy(*by).agg(F.max("evaluation").alias("e"), F.max("other").alias("o"), F.count(F.lit(1)).alias("n")).where("e and o").select(*by, "n")
    together = common.attach(tied, stored(bad, "torn"), by, "n").select("build_name", "family")
    return alone.union(together).select("build_name", common.hash_text(F.col("family")).alias("family_id"))


def place(sizes: DataFrame, fixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(grp, component, n, split) for all components of ``sizes`` (grp, component, n).

    fixed: (grp, component, split), splits that components already have; one with
    several different ones goes to quarantine. plan: (grp, split, share), the wanted
    shares of each group of splits (a build); shares are scaled to 1, and null or negative
    ones count as 0. New components fill the splits' deficits: those
    with more than ``LARGE_PART`` of a group's rows one by one, largest first, the
    others by a hash of their name against the deficits that are left. A group
    without a plan gets null splits.
    """
    held = fixed.where("split is not null").groupBy("grp", "component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    old = held.select("grp", "component", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(QUARANTINE).alias("split"))
    state = stored(sizes.join(old, ["grp", "component"], "left"), "split-state")
    shares: dict = {}
    for r in plan.groupBy("grp", "split").agg(F.sum("share").alias("share")).collect():  # a plan is as large as its builds and splits
        shares.setdefault(r.grp, {})[r.split] = max(0.0, r.share or 0.0)
    used: dict = {g: dict.fromkeys(s, 0) for g, s in shares.items()}
    total: dict = dict.fromkeys(shares, 0)
    for r in state.groupBy("grp", "split").agg(F.sum("n").alias("n")).collect():  # groups x splits
        if r.grp in total:
            total[r.grp] += 0 if r.split == QUARANTINE else r.n
            if r.split in used[r.grp]:
                used[r.grp][r.split] += r.n
    lack = {g: {s: share / (sum(of.values()) or 1) * total[g] - used[g][s] for s, share in sorted(of.items())} for g, of in shares.items()}
    limits = [(g, float(max(1, LARGE_PART * n))) for g, n in total.items()]
    spark = sizes.sparkSession
    limit = F.broadcast(spark.createDataFrame(limits, "grp string, least double")) if limits else spark.createDataFrame([], "grp string, least double")
    new = state.where("split is null").join(limit, "grp")
    placed = []
    for r in sorted(new.where("n > least").select("grp", "component", "n").collect(), key=lambda r: (r.grp, -r.n, bytes(r.component))):
        best = max(lack[r.grp], key=lambda s: lack[r.grp][s])  # at most 1 / LARGE_PART rows a group
        lack[r.grp][best] -= r.n
        placed.append((r.grp, r.component, best))
    cuts = []
    for g, of in lack.items():
        room = {s: max(0.0, x) for s, x in of.items()}
        if not sum(room.values()):
            room = dict(shares[g])
        whole, at = sum(room.values()), 0.0
        for s, x in room.items():
            if x > 0:
                cuts.append((g, at / whole, (at := at + x) / whole, s))
    cut = F.broadcast(spark.createDataFrame(cuts, "grp string, lo double, hi double, s string"))
    one = F.broadcast(spark.createDataFrame(placed, "grp string, component binary, by_size string"))
    unit = F.pmod(F.xxhash64("grp", "component"), F.lit(1 << 40)) / float(1 << 40)
    rest = state.withColumn("u", unit).join(one, ["grp", "component"], "left")
    c = rest.join(cut, (rest["grp"] == cut["grp"]) & (rest["u"] >= cut["lo"]) & (rest["u"] < cut["hi"]), "left")
    return c.select(rest["grp"], "component", "n", F.coalesce("split", "by_size", "s").alias("split"))


def assign(rows: DataFrame, membership: DataFrame, plan: DataFrame, kept: SplitTable | None = None) -> DataFrame:
    """(build_name, family_id, split): a split of every build for every family.

    A component with only evaluation rows in the build stays in evaluation (test or
    validation, by a hash against their shares), one with only other rows in train;
    torn ones are quarantined; those without rows in the build are new. kept: a component table that has
    taken in the rows.
    """
    components, own = (stored(merge_components(None, ties(rows)), "components"), row_families(rows)) if kept is None else (kept.read().select("family", "component"), kept.rows())
    families = stored(_with_component(own.groupBy("family").agg(F.count(F.lit(1)).alias("n")), components), "families")
    plan = plan.select("build_name", common.split_name(F.col("split_name")).alias("split"), F.col("target_share").alias("share")).dropna(subset=["build_name", "split"])
    builds = [F.lit(r.build_name) for r in plan.select("build_name").distinct().sort("build_name").collect()]  # the plan's builds
    every = F.explode(F.array(*builds) if builds else F.array().cast("array<string>"))
    sizes = families.groupBy("component").agg(F.sum("n").alias("n")).select(every.alias("grp"), "component", "n")
    flags = _with_component(build_families(own, membership), components).groupBy(F.col("build_name").alias("grp"), "component").agg(F.max("evaluation").alias("e"), F.max("other").alias("o"))
    held_out = plan.where("split <> 'train'").groupBy(F.col("build_name").alias("grp")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "share")))).alias("m"))
    part = F.pmod(F.xxhash64(F.lit("held out"), "component"), F.lit(1 << 40)) / float(1 << 40)
    validation = F.coalesce(F.col("m")["validation"], F.lit(0.0)) / F.greatest(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), F.lit(1e-12))
    held = flags.join(F.broadcast(held_out), "grp", "left")
    evaluation = F.when(part < F.coalesce(validation, F.lit(0.0)), "validation").otherwise("test")
    value = F.when(F.col("e") & F.col("o"), F.array(F.lit("test"), F.lit("train"))).when(F.col("e"), F.array(evaluation)).when(F.col("o"), F.array(F.lit("train")))
    fixed = held.select("grp", "component", F.explode(value).alias("split"))
    placed = place(sizes, fixed, plan.withColumnRenamed("build_name", "grp"))
    # one row a component with its split in every build, which families of a giant component meet by broadcast
    of = placed.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("grp", "split"))).alias("splits"))  # builds of the plan
    sized = stored(of.join(families.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component"), "component-splits")
    spread = common.attach(families.select("family", "component"), sized, ["component"], "size")
    return spread.select(common.hash_text(F.col("family")).alias("family_id"), F.explode("splits").alias("build_name", "split")).select("build_name", "family_id", "split")


def shares(rows: DataFrame, assigned: DataFrame, plan: DataFrame) -> DataFrame:
    """(build_name, split, row_count, share, target_share) of an assignment, by rows."""
    n = row_families(rows).groupBy(common.hash_text(F.col("family")).alias("family_id")).agg(F.count(F.lit(1)).alias("n"))
    reached = assigned.join(n, "family_id").groupBy("build_name", "split").agg(F.sum("n").alias("row_count"))
    whole = reached.groupBy("build_name").agg(F.sum("row_count").alias("whole"))
    wanted = plan.select("build_name", common.split_name(F.col("split_name")).alias("split"), "target_share")
    out = reached.join(F.broadcast(whole), "build_name").join(F.broadcast(wanted), ["build_name", "split"], "full")
    return out.select("build_name", "split", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.round(F.coalesce(F.col("row_count") / F.col("whole"), F.lit(0.0)), 6).alias("share"), "target_share")


#: Versions after which a split table is written whole again; in between only what changed is.
WHOLE_EVERY = 16


class SplitTable:
    """(family, component, n, split), kept in versions below a path of the shared storage.

    A version holds what its batch changed: families that are new or have another component, number of rows or
    split, and the batch's new (row, family) and (row, src), by which ties are found whichever batch
    their two rows come in. Every ``WHOLE_EVERY``th version is whole. A version is
    complete once its families have a success marker, so a lost driver leaves the last one in force, and
    the next batch overwrites what it left. One writer at a time.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at, jvm

    def version(self) -> int | None:
        fs, at, jvm = self._folder()
        if not fs.exists(at):
            return None
        folders = [s.getPath() for s in fs.listStatus(at)]
        done = [int(p.getName()[1:]) for p in folders if re.fullmatch("v[0-9]+", p.getName()) and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "families/_SUCCESS"))]
        return max(done, default=None)

    def _paths(self, name: str, v: int) -> list[str]:
        whole = v - v % WHOLE_EVERY
        return [f"{self.path}/v{k}/{name}" for k in range(whole, v + 1)]

    def read(self, v: int | None = None) -> DataFrame | None:
        """The families of a version, of the last one by default; None before the first."""
        v = self.version() if v is None else v
        if v is None:
            return None
        if not v % WHOLE_EVERY:
            return self.spark.read.parquet(*self._paths("families", v))
        changes = None
        for k, path in enumerate(self._paths("families", v)):
            part = self.spark.read.parquet(path).withColumn("_v", F.lit(k))
            changes = part if changes is None else changes.unionByName(part)
        last = changes.groupBy("family").agg(F.max_by(F.struct("component", "n", "split"), "_v").alias("s"))
        return last.select("family", "s.*")

    def rows(self) -> DataFrame | None:
        """(row, family), distinct, of all rows taken in."""
        v = self.version()
        return None if v is None else self.spark.read.parquet(*self._paths("rows", v))

    def update(self, rows: DataFrame, plan: dict[str, float] | None) -> DataFrame:
        """Take in new rows (row_id, family_id, duplicate_of); plan: share of each split, None to keep components only.
        Rows exported again, in this batch or a later one, count once."""
        spark, v = self.spark, self.version()
        number = 0 if v is None else v + 1
        old = None if v is None else stored(self.read(v), "split-table")
        fresh, points = stored(row_families(rows), "new-rows"), stored(row_points(rows), "new-points")
        edges, had, named = _tied(points, fresh), None, None
        if old is not None:
            had, named = spark.read.parquet(*self._paths("rows", v)), spark.read.parquet(*self._paths("points", v))
            fresh = stored(fresh.join(had, ["row", "family"], "left_anti"), "new-rows")
            points = stored(points.join(named, ["row", "src"], "left_anti"), "new-points")
            edges = _tied(points, had.unionByName(fresh)).union(_tied(named, fresh)).distinct()
        merged = merge_components(old.select("family", "component") if old is not None else None, edges)
        counted = fresh.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
        seen = counted if old is None else counted.join(old.select("family", F.col("n").alias("before")), "family", "full").select("family", (F.coalesce("n", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("n"))
        # a tied family without a row id has no rows that count, but its ties last
        whole = seen.join(merged, "family", "full").select("family", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "family").alias("component"))
        families = stored(whole, "families")
        out = families.withColumn("split", F.lit(None).cast("string")) if plan is None else self._placed(families, old, plan)
        if old is not None and number % WHOLE_EVERY:
            before = old.select("family", F.struct("component", "n", "split").alias("_before"))
            changed = out.join(before, "family", "left").where(~F.struct("component", "n", "split").eqNullSafe(F.col("_before")))
            out = changed.drop("_before")
        elif old is not None:
            fresh, points = had.unionByName(fresh), named.unionByName(points)
        fresh.write.mode("overwrite").parquet(f"{self.path}/v{number}/rows")
        points.write.mode("overwrite").parquet(f"{self.path}/v{number}/points")
        out.select("family", "component", "n", "split").write.mode("overwrite").parquet(f"{self.path}/v{number}/families")  # last: its marker completes the version
        return self.read(number)

    def _placed(self, families: DataFrame, old: DataFrame | None, plan: dict[str, float]) -> DataFrame:
        """The families with a split: components keep theirs, new ones fill deficits."""
        sizes = families.groupBy(F.lit("all").alias("grp"), "component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size"))
        sizes = stored(sizes, "component-sizes")
        fixed = self.spark.createDataFrame([], "grp string, component binary, split string")
        if old is not None:
            fixed = families.join(old.select("family", "split"), "family").select(F.lit("all").alias("grp"), "component", "split").distinct()
        wanted = self.spark.createDataFrame([("all", s, float(x)) for s, x in plan.items()], "grp string, split string, share double")
        placed = place(sizes.drop("size"), fixed, wanted).select("component", "split")
        sized = stored(placed.join(sizes.select("component", "size"), "component"), "component-splits")
        return common.attach(families, sized, ["component"], "size").select("family", "component", "n", "split")
