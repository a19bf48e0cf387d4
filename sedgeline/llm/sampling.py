"""Samples that match target proportions of categories.

Cell targets are raked: proportional fitting over the subject, the behavior and the
cell margins, under what each cell can supply. Each record then takes one of its
cells by weighted exponential keys, cells take their smallest keys up to
their quota. Cells below their minimum, then those below their quota, are filled by
augmenting exchanges over the kinds of records (those with the same cells in a sample), until
nothing moves; what still lacks cannot be met and is reported.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgeline.llm import budgets, common
from sedgeline.scratch import stored
from sedgeline.sizing import small

#: Rounds of fitting.
FITTING = 100


def behavior_name(c):
    """Lower case and trimmed; first_error is an older name of diagnose."""
    s = common.spelled(c)
    return F.when(s == "first_error", "diagnose").otherwise(s)


def units(inventory: DataFrame) -> DataFrame:
    """(record_no, subject, behavior): the cells of each record. Null subjects and behaviors have none;
    a behavior listed twice counts once."""
    each = F.explode(F.array_distinct(F.transform("eligible_behaviors", behavior_name)))
    return inventory.select(F.col("record_no").cast("long").alias("record_no"), common.subject_name(F.col("subject")).alias("subject"), each.alias("behavior")).dropna()


def targets(plan: DataFrame, cells: DataFrame) -> DataFrame:
    """The plan's lines with their minimum (the cell plan's minimum_examples, else 0)."""
    least = cells.select(common.subject_name(F.col("subject")).alias("subject"), behavior_name(F.col("behavior")).alias("behavior"), "minimum_examples").groupBy("subject", "behavior").agg(F.max("minimum_examples").alias("minimum"))
    lines = plan.select("sample_name", common.subject_name(F.col("subject")).alias("subject"), behavior_name(F.col("behavior")).alias("behavior"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"))
    return lines.join(small(least), ["subject", "behavior"], "left").withColumn("minimum", F.coalesce("minimum", F.lit(0)))


def supply(plan: DataFrame, cells: DataFrame, inventory: DataFrame) -> DataFrame:
    """The plan's lines with the number of records of their cell."""
    n = units(inventory).groupBy("subject", "behavior").agg(F.count(F.lit(1)).alias("supply"))
    return targets(plan, cells).join(small(n), ["subject", "behavior"], "left").withColumn("supply", F.coalesce("supply", F.lit(0)))


def rake(lines: list[dict]) -> dict[tuple[str, str], float]:
    """The quota of each cell of one sample, by proportional fitting.

    A cell's target is its share of the sample size; shares that add up to more than
    1 are scaled to 1. Of several lines of a cell the largest share counts, one that is negative or no number is none. Every cell keeps its target as far as it is supplied, its margin. What cells lack is raked over
    the others: in turn the cells of each subject, of each behavior, and all of them are scaled to what their targets
    add up to, up within their supply, down to their own targets at most. Margins of subjects and behaviors can pull
    against each other, so each step goes half the way; the sum of all is met as far as there are
    records. Cells without a target get none.
    """
    size = max((x["sample_size"] for x in lines), default=0)
    share: dict = {}
    for x in lines:
        c = (x["subject"], x["behavior"])
        share[c] = max(share.get(c, 0.0), x["share"] if 0 < x["share"] < math.inf else 0.0)
    whole = sum(share.values())
    want = {c: v / max(1.0, whole) * size for c, v in share.items()}
    room = {(x["subject"], x["behavior"]): float(x["supply"]) for x in lines}
    base = {c: min(room[c], want[c]) for c in want}
    got = dict(base)
    margins: dict = {}
    for c in want:
        for m in (("subject", c[0]), ("behavior", c[1]), ("whole", "")):
            margins.setdefault(m, []).append(c)
    for _ in range(FITTING):
        before = dict(got)
        for (kind, _), cells in sorted(margins.items(), key=lambda m: m[0][0] == "whole"):
            goal, have, least = (sum(x[c] for c in cells) for x in (want, got, base))
            step = (goal - have) * (1.0 if kind == "whole" else 0.5)
            if step < 0:  # have - least is more than nothing, as no margin's targets are below its cells'
                got |= {c: base[c] + (got[c] - base[c]) * (have + step - least) / (have - least) for c in cells}
            # full cells stay; the others share what is lacking in proportion, again where this fills some
            open_ = [c for c in cells if 0 < got[c] < room[c]]
            while open_ and step > 1e-9:
                factor = 1 + step / sum(got[c] for c in open_)
                for c in open_:
                    new = min(room[c], got[c] * factor)
                    step -= new - got[c]
                    got[c] = new
                open_ = [c for c in open_ if got[c] < room[c]]
        if sum(abs(got[c] - before[c]) for c in got) < 1e-3:
            break
    return got


def _fit(lines: DataFrame) -> DataFrame:
    """The lines with ``quota`` (records) and ``weight`` (quota over supply)."""
    rows = [r.asDict() for r in lines.collect()]  # a plan's lines
    quota: dict = {}
    for name in sorted({r["sample_name"] for r in rows}, key=str):
        quota[name] = rake([r for r in rows if r["sample_name"] == name])
    out = []
    for r in rows:
        q = int(round(quota[r["sample_name"]][r["subject"], r["behavior"]]))
        out.append((r["sample_name"], r["subject"], r["behavior"], float(r["share"]), int(r["sample_size"]), int(r["minimum"]), int(r["supply"]), q, q / r["supply"] if r["supply"] else 0.0))
    return lines.sparkSession.createDataFrame(out, "sample_name string, subject string, behavior string, share double, sample_size long, minimum long, supply long, quota long, weight double")


def _state(inventory: DataFrame, lines: DataFrame) -> DataFrame:
    """(sample_name, record_no, subject, kind, first, h): every record once for each sample that has cells for it.

    kind: its cells in the sample, sorted; first: of those with a weight the one with the smallest exponential key,
    -ln(u) / weight with u from a hash, so a cell is chosen in proportion to its weight; h: a 30-bit number
    that grows with this key. All from the row itself and the plan's lines, without a shuffle.
    """
    wanted = lines.where("supply > 0 and (minimum > 0 or quota > 0)").select("sample_name", "subject", "behavior", "weight").distinct()
    cells = wanted.groupBy("sample_name", "subject").agg(F.map_from_entries(F.collect_list(F.struct("behavior", "weight"))).alias("cells"))  # behaviors of a plan
    own = F.array_sort(F.array_distinct(F.filter(F.transform("eligible_behaviors", behavior_name), lambda b: b.isNotNull())))
    rows = inventory.select(F.col("record_no").cast("long").alias("record_no"), common.subject_name(F.col("subject")).alias("subject"), own.alias("own")).where("size(own) > 0")
    met = rows.join(small(cells), "subject").withColumn("kind", F.filter("own", lambda b: F.map_contains_key("cells", b))).where("size(kind) > 0")
    unit = lambda b: (F.pmod(F.xxhash64("sample_name", "record_no", b), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    keyed = F.transform("kind", lambda b: F.struct(F.when(F.col("cells")[b] > 0, -F.log(unit(b)) / F.col("cells")[b]).alias("key"), b.alias("behavior")))
    best = F.array_min(F.filter(keyed, lambda k: k["key"].isNotNull()))
    h = F.least(F.floor((1 - F.exp(-F.col("best.key"))) * float(1 << budgets.BITS)).cast("long"), F.lit((1 << budgets.BITS) - 1))
    return met.withColumn("best", best).select("sample_name", "record_no", "subject", "kind", F.col("best.behavior").alias("first"), h.alias("h"))


def _cell(behavior: str):
    return F.concat_ws("\u001f", "sample_name", "subject", behavior)


def exchange(counts: dict, least: dict, goal: dict) -> dict:
    """{(kind, cell): {cell: n}}: the moves that bring cells, first up to ``least``, then up to ``goal``,
    as far as records allow.

    counts: {(kind, cell): n} of the records of one sample and subject; a kind is the tuple of the
    cells its records may have, cell is the one they have, or None. A cell below its least takes
    records not drawn, else those of cells above their least, over any number of cells that pass a
    record on; one below its goal takes records not drawn only, so no other cell loses.
    """
    x, kinds = {k: n for k, n in counts.items() if n}, sorted({k for k, _ in counts})
    have = {c: sum(n for (_, at), n in x.items() if at == c) for c in goal}

    def move(kind, old, new, n):
        x[kind, old] -= n
        x[kind, new] = x.get((kind, new), 0) + n

    def push(c: str, need: int, take: bool) -> bool:
        """Bring c up to need more records by one path; take: from cells above their least too."""
        before, queue, ends = {c: None}, [c], []
        for a in queue:
            free = [k for k in kinds if a in k and x.get((k, None), 0)]
            if free:
                ends = [(a, free)]
                break
            for k in kinds:
                for b in k if a in k else ():
                    if b not in before and x.get((k, b), 0):
                        before[b] = (a, k)
                        queue.append(b)
        if ends:
            at, free = ends[0]
            k = max(free, key=lambda k: x[k, None])
            n, steps = min(need, x[k, None]), [(k, None, at)]
        else:
            spare = {b: have[b] - least.get(b, 0) for b in queue[1:]}
            at = max(spare, key=lambda b: spare[b], default=None)
            if not take or at is None or spare[at] <= 0:
                return False
            n, steps = min(need, spare[at] // 4 + 1), []  # the next part may come from another cell
        end = at
        while before[at]:
            to, k = before[at]
            steps.append((k, at, to))
            at = to
        n = min(n, *(x[k, old] for k, old, _ in steps))
        for k, old, new in steps:
            move(k, old, new, n)
        have[c] += n
        if not ends:
            have[end] -= n
        return True

    for aim, take in ((least, False), (least, True), (goal, False)):
        for c in sorted(goal, key=lambda c: (sum(n for (k, _), n in counts.items() if c in k) / max(1, aim.get(c, 0)), c)):
            # of the records not drawn each kind gives in proportion, before any path
            free = {k: x[k, None] for k in kinds if c in k and x.get((k, None), 0)}
            need, whole = aim.get(c, 0) - have[c], sum(free.values())
            for k, n in free.items():
                part = max(0, min(need, whole)) * n // whole
                move(k, None, c, part)
                have[c] += part
            while have[c] < aim.get(c, 0) and push(c, aim[c] - have[c], take):
                pass
    moves: dict = {}
    for k in kinds:
        diff = {c: x.get((k, c), 0) - counts.get((k, c), 0) for c in (*k, None)}
        gives = [[c, -n] for c, n in diff.items() if n < 0]
        for c, n in diff.items():
            while n > 0:
                part = min(n, gives[0][1])
                moves.setdefault((k, gives[0][0]), {})[c] = part
                n -= part
                gives[0][1] -= part
                if not gives[0][1]:
                    gives.pop(0)
    return moves


def _group(kind, at):
    return F.concat_ws("\u001f", "sample_name", "subject", F.concat_ws("\u001e", kind), F.coalesce(at, F.lit("")))


def _moved(state: DataFrame, moves: dict, salt: int) -> DataFrame:
    """The state with so many records of each group, by a hash, in other cells; moves: {group: {cell: n}}."""
    h = F.pmod(F.xxhash64(F.lit(salt), "sample_name", "record_no"), F.lit(1 << budgets.BITS))
    keyed = state.withColumns({"cell": _group(F.col("kind"), F.col("behavior")), "h": h})
    lines, names = [], {}
    for group, of in moves.items():
        upto = 0
        for to, n in of.items():
            upto += n
            names[f"{len(lines)}"] = (group, to)
            lines.append((f"{len(lines)}", group, upto))
    budget = state.sparkSession.createDataFrame(lines, "line string, cell string, budget long")  # plan lines x kinds
    items = stored(keyed.join(F.broadcast(budget.select("cell").distinct()), "cell", "left_semi").select("cell", "h", F.lit(1).alias("size")), "exchanged")
    cuts, last = [], {}
    for r in sorted(budgets.thresholds(items, budget).collect(), key=lambda r: int(r.line)):
        group, to = names[r.line]
        cuts.append((group, last.get(group, 0), r.threshold, to))
        last[group] = r.threshold
    cut = F.broadcast(state.sparkSession.createDataFrame(cuts, "at string, lo long, hi long, new string"))
    met = keyed.join(cut, (keyed["cell"] == cut["at"]) & (keyed["h"] >= cut["lo"]) & (keyed["h"] < cut["hi"]), "left")
    return met.select("sample_name", "record_no", "subject", "kind", F.coalesce("new", "behavior").alias("behavior"))


def _drawn(plan: DataFrame, cells: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fitted lines, sample)."""
    lines = _fit(supply(plan, cells, inventory))
    least, goal = {}, {}
    for r in lines.where("supply > 0 and (minimum > 0 or quota > 0)").collect():  # a plan's lines
        of = (r.sample_name, r.subject)
        least.setdefault(of, {})[r.behavior] = min(r.minimum, r.supply)
        goal.setdefault(of, {})[r.behavior] = min(max(r.minimum, r.quota), r.supply)
    chosen = stored(_state(inventory, lines), "sample-choices")
    # cells take the smallest keys up to their quota
    budget = budgets._few(lines.select(_cell("behavior").alias("line"), _cell("behavior").alias("cell"), F.col("quota").alias("budget")).where("budget > 0").distinct())
    items = chosen.where("first is not null").select(_cell("first").alias("cell"), "h", F.lit(1).alias("size"))
    cut = F.broadcast(budgets._few(budgets.thresholds(items, budget)).select(F.col("line").alias("_cell"), "threshold"))  # a plan's lines
    met = chosen.join(cut, _cell("first") == F.col("_cell"), "left")
    state = met.select("sample_name", "record_no", "subject", "kind", F.when(F.col("h") < F.col("threshold"), F.col("first")).alias("behavior"))
    state = stored(state, "sample-state")
    salt = 0
    while True:
        counts: dict = {}
        for r in state.groupBy("sample_name", "subject", "kind", "behavior").agg(F.count(F.lit(1)).alias("n")).collect():  # plan lines x kinds
            counts.setdefault((r.sample_name, r.subject), {})[tuple(r.kind), r.behavior] = r.n
        moves = {}
        for of, n in counts.items():
            for (kind, at), to in exchange(n, least[of], goal[of]).items():
                moves["\u001f".join([*(x for x in of if x is not None), "\u001e".join(kind), at or ""])] = to  # as _group has it
        if not moves:
            break
        salt += 1  # the rare records that share all bits of a hash are apart in the next round
        state = stored(_moved(state, moves, salt), "sample-state")
    return lines, state.where("behavior is not null").select("sample_name", "record_no", "subject", "behavior")


def draw(plan: DataFrame, cells: DataFrame, inventory: DataFrame) -> DataFrame:
    """(sample_name, record_no, subject, behavior): each record at most once in a sample."""
    return _drawn(plan, cells, inventory)[1]


def _reached(plan: DataFrame, cells: DataFrame, inventory: DataFrame) -> DataFrame:
    """The fitted lines with ``drawn``, the records that their cell has in its sample."""
    lines, sample = _drawn(plan, cells, inventory)
    by = ["sample_name", "subject", "behavior"]
    n = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("drawn"))
    return lines.join(F.broadcast(n), by, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))


def found(plan: DataFrame, cells: DataFrame, inventory: DataFrame) -> DataFrame:
    """(sample_name, subject, behavior) of the cells that cannot be met: what is drawn for them is below their minimum or
    target, and with all records of the cell, also those that other cells have taken, it still were."""
    need = F.greatest(F.col("minimum").cast("double"), F.col("share") * F.col("sample_size"))
    return _reached(plan, cells, inventory).where((F.col("drawn") < need) & (F.col("supply") < need)).select("sample_name", "subject", "behavior")


def gaps(plan: DataFrame, cells: DataFrame, inventory: DataFrame) -> DataFrame:
    """(sample_name, subject, behavior, target_share, share, drawn, minimum, missing): what a sample
    reaches; missing: records below the larger of minimum and target."""
    out = _reached(plan, cells, inventory)
    need = F.ceil(F.greatest(F.col("minimum").cast("double"), F.round(F.col("share") * F.col("sample_size"), 6)))
    return out.select("sample_name", "subject", "behavior", F.col("share").alias("target_share"), F.round(F.when(F.col("sample_size") > 0, F.col("drawn") / F.col("sample_size")), 6).alias("share"), "drawn", "minimum", F.greatest(need - F.col("drawn"), F.lit(0)).alias("missing"))
