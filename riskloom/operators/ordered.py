"""Ordered operators that never put a whole group into one task.

* ``prefix_sums``: running sums over an ordered value. Values are cut into many ranges, each range is one window
  partition, and the totals of the lower ranges are added back. Range bounds come from a small deterministic sample, so
  they only affect balance, never results.
* ``group_quantiles``: exact interpolated quantiles of any number of columns in long form. Stored mergeable sketches
  bracket each quantile; only values inside the bracket are ranked.
* ``hashed_rank`` / ``assign_by_cuts``: ranks in a hash order, and rank cuts turned into hash thresholds, so that the
  big table is labelled by comparison; only rows near a cut are shuffled and sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise


def _range_count(df: DataFrame) -> int:
    """Power of two near the shuffle width, so that one range stays about one task's work."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = 16
    while n < width and n < 4096:
        n *= 2
    return n


def sampled_bounds(df: DataFrame, groups: Sequence[str], value: str, ranges: int) -> Column:
    """Scalar subquery with ranges-1 ascending bounds from the rows with the smallest key hashes. The sample has a fixed
    size and depends only on the data, so every evaluation gives the same bounds. Any orderable type."""
    sample = (
        df.select(*groups, F.col(value).alias("_v"))
        .filter(F.col("_v").isNotNull())
        .orderBy(F.xxhash64(*groups, "_v"), "_v")
        .limit(16 * ranges)
    )
    ordered = sample.agg(F.array_sort(F.collect_list("_v")).alias("a"))
    return ordered.select(
        F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("a", F.floor(i * F.size("a") / ranges).cast("int"))).alias("b")
    ).scalar()


def range_index(value: Column, bounds: Column, ranges: int) -> Column:
    """Number of bounds below the value, by binary search."""
    steps, s = [], ranges // 2
    while s:
        steps.append(s)
        s //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda i, s: i + F.when(F.get(bounds, i + s - F.lit(1)) < value, s).otherwise(F.lit(0)),
    )


def prefix_sums(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    sums: Sequence[str],
    descending: bool = False,
    ranges: int | None = None,
    next_value: str | None = None,
) -> DataFrame:
    """``df`` has one row per (groups, value). Adds ``<s>_cum`` (running sum including the row) and ``<s>_total`` for
    every column in ``sums``; with ``next_value`` also the following value of the group in order."""
    groups = list(groups)
    ranges = ranges or _range_count(df)
    cut = (
        df.withColumn("_bounds", sampled_bounds(df, groups, value, ranges))
        .withColumn("_range", range_index(F.col(value), F.col("_bounds"), ranges))
        .drop("_bounds")
    )
    keys = [*groups, "_range"]
    in_order = F.col("_range").desc() if descending else F.col("_range").asc()
    per_range = cut.groupBy(*keys).agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums], F.min(value).alias("_first"), F.max(value).alias("_last")
    )
    over_ranges = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = over_ranges.orderBy(in_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(over_ranges).alias(f"{s}_total") for s in sums],
        F.lead("_last" if descending else "_first").over(over_ranges.orderBy(in_order)).alias("_following"),
    )
    inside = Window.partitionBy(*keys).orderBy(F.col(value).desc() if descending else F.col(value).asc())
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        *cut.columns,
        *[F.sum(s).over(running).alias(f"_c_{s}") for s in sums],
        *([F.lead(value).over(inside).alias("_lead")] if next_value else []),
    )
    joined = local.join(offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"{s}_cum") for s in sums],
        *[f"{s}_total" for s in sums],
        *([F.coalesce("_lead", "_following").alias(next_value)] if next_value else []),
    )


def csr_offsets(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """(key, n_children, ptr): children sorted by parent key occupy [ptr, ptr + n_children)."""
    counts = children.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias("n_children"))
    dense = parents.select(key).join(counts, key, "left").select(key, F.coalesce("n_children", F.lit(0)).alias("n_children"))
    run = prefix_sums(dense, [], key, ["n_children"])
    return run.select(key, "n_children", (F.col("n_children_cum") - F.col("n_children")).alias("ptr"))


def sort_children(children: DataFrame, fk: str) -> DataFrame:
    """Children in parent order over the whole table. The range also uses a row hash, so the children of one very large
    parent fill several consecutive partitions instead of one."""
    salted = children.withColumn("_salt", F.xxhash64(*children.columns))
    return salted.repartitionByRange(fk, "_salt").sortWithinPartitions(fk).drop("_salt")


# ---------------------------------------------------------------------------------------------------------- quantiles
#: Items a sketch keeps at its base, and the rank error that its brackets allow for (about twice the likely one).
SKETCH_ITEMS = 2000
RANK_ERROR = 0.005
#: Columns of a row that are sketched together.
SKETCHED = 64


def value_sketches(work: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, _i, _n, _sketch): a mergeable sketch of every column of the array ``_x`` of that size, one row per cell with a
    value, in long form. Rows are unfolded to blocks of columns only: few groups, which the tasks aggregate without a sort,
    and a plan that has the same size for any number of columns."""
    wide = min(size, SKETCHED)
    parts = f"transform(sequence(0, {(size - 1) // SKETCHED}), b -> slice(_x, b * {SKETCHED} + 1, {SKETCHED}))"
    named = [f"`{k}`" for k in keys]
    long = work.selectExpr(*named, f"posexplode({parts}) as (_part, _c)")
    sums = [e for i in range(wide) for e in (f"count(get(_c, {i})) as n{i}", f"kll_sketch_agg_double(get(_c, {i}), {SKETCH_ITEMS}) as s{i}")]
    cells = ", ".join(f"struct(_part * {SKETCHED} + {i} as _i, n{i} as _n, s{i} as _sketch)" for i in range(wide))
    return long.groupBy(*keys, "_part").agg(*map(F.expr, sums)).selectExpr(*named, f"inline(array({cells}))").filter("_n > 0")


def _against_brackets(work: DataFrame, cells: DataFrame, keys: list[str], size: int, probs: int) -> DataFrame:
    """(keys, _i, _v, _b): every value beside its column's brackets, a struct with a field (_low, _high) per quantile, NULL where
    none is asked for. The brackets of a group are one row, which meets the wide rows before these are unfolded."""
    brackets = [F.max(F.when(F.col("_j") == j, F.struct("_low", "_high"))).alias(f"j{j}") for j in range(probs)]
    of_column = cells.groupBy(*keys, "_i").agg(*brackets).select(*keys, F.struct("_i", F.struct(*[f"j{j}" for j in range(probs)])).alias("_e"))
    listed = of_column.groupBy(*keys).agg(F.map_from_entries(F.collect_list("_e")).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("_m", i))
    per_group = materialise(listed.select(*keys, dense.alias("_b")), "brackets")  # its size is known to the planner
    both = work.join(per_group, keys).select(*keys, F.posexplode(F.arrays_zip("_x", "_b")).alias("_i", "_c"))
    return both.filter("_c._x is not null and _c._b is not null").select(*keys, "_i", F.col("_c._x").alias("_v"), F.col("_c._b").alias("_b"))


def group_quantiles(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], probs: Sequence[float], rank_error: float = RANK_ERROR
) -> DataFrame:
    """Exact linear-interpolation quantiles, long form (groups, column, prob, value, n); NULL ignored, no value -> NULL
    and 0. ``n`` counts the non-missing values.

    The plan has the same size for any number of columns: columns are one array, unfolded to (group, column, value). Stored
    sketches bracket each quantile; the values below a bracket are counted, those inside counted by value and ranked. The
    ranks that a quantile interpolates lie inside the bracket or are its direct neighbours, which are kept; a cell of which
    that turns out false (a sketch may err more) is done again over all its values, so the result is exact for any sketch."""
    groups, columns, probs = list(groups), list(columns), [float(p) for p in probs]
    keys = groups or ["_all"]
    named = [f"`{g}`" for g in groups] or ["0 as _all"]
    cells_sql = ", ".join(f"cast(`{c}` as double)" for c in columns)
    work = df.selectExpr(*named, f"array({cells_sql}) as _x")
    for g in groups:
        work = work.filter(F.col(g).isNotNull())
    edges = ", ".join(f"{max(0.0, min(1.0, p + d))!r}d" for p in probs for d in (-rank_error, rank_error))
    facts = ", ".join(f"struct({j} as _j, {p!r}d as prob, _q[{2 * j}] as _low, _q[{2 * j + 1}] as _high)" for j, p in enumerate(probs))
    sketches = value_sketches(work, keys, len(columns)).selectExpr(*[f"`{k}`" for k in keys], "_i", "_n", f"kll_sketch_get_quantile_double(_sketch, array({edges})) as _q")
    # written, so that both passes below see the same brackets
    cells = materialise(sketches.selectExpr(*[f"`{k}`" for k in keys], "_i", "_n", f"inline(array({facts}))"), "quantile-cells")
    cell = [*keys, "_i", "_j"]
    h = F.col("prob") * (F.col("_n") - 1)

    def passes(cells: DataFrame) -> DataFrame:
        beside = _against_brackets(work, cells, keys, len(columns), len(probs))
        v = F.col("_v")

        def at_bracket(j: int) -> Column:
            low, high = F.col(f"_b.j{j}._low"), F.col(f"_b.j{j}._high")
            counts = F.count(low).alias("_asked"), F.count_if(v < low).alias("_below"), F.count_if(v.between(low, high)).alias("_within")
            return F.struct(F.lit(j).alias("_j"), *counts, F.max(F.when(v < low, v)).alias("_prev"), F.min(F.when(v > high, v)).alias("_next"))

        # a row per value, not one per value and quantile; written, because it is read twice
        found = beside.groupBy(*keys, "_i").agg(F.array(*[at_bracket(j) for j in range(len(probs))]).alias("_f"))
        around = materialise(found.select(*keys, "_i", F.inline("_f")).filter("_asked > 0").drop("_asked"), "around")
        inside = [v.between(F.col(f"_b.j{j}._low"), F.col(f"_b.j{j}._high")) for j in range(len(probs))]
        of = F.explode(F.array(*[F.when(hit, F.lit(j)) for j, hit in enumerate(inside)])).alias("_j")  # of the few values inside any
        near = beside.filter(reduce(or_, [F.coalesce(hit, F.lit(False)) for hit in inside])).select(*keys, "_i", "_v", of)
        values = near.filter("_j is not null").groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = values.withColumn("_upto", F.sum("_c").over(upto)).join(around, cell).join(cells.select(*cell, "prob", "_n"), cell)
        last = F.col("_below") + F.col("_upto") - 1
        first = last - F.col("_c") + 1
        picked = ranked.groupBy(*cell).agg(
            F.max(F.when((first <= F.floor(h)) & (F.floor(h) <= last), v)).alias("_lo"),
            F.max(F.when((first <= F.ceil(h)) & (F.ceil(h) <= last), v)).alias("_hi"),
        )
        known = cells.join(around, cell).join(picked, cell, "left")

        def at_rank(rank: Column, hit: str) -> Column:
            return F.coalesce(hit, F.when(rank < F.col("_below"), F.col("_prev")).otherwise(F.col("_next")))

        held = (F.floor(h) >= F.col("_below") - 1) & (F.ceil(h) <= F.col("_below") + F.col("_within"))
        low_value, high_value = at_rank(F.floor(h), "_lo"), at_rank(F.ceil(h), "_hi")
        value = low_value + (high_value - low_value) * (h - F.floor(h))
        return materialise(known.select(*cell, "prob", "_n", value.alias("value"), held.alias("_held")), "quantiles")

    found = passes(cells)
    if not found.filter("not _held").isEmpty():
        everything = {"_low": F.lit(float("-inf")), "_high": F.lit(float("inf"))}
        again = cells.join(found.filter("not _held").select(*cell), cell, "left_semi").withColumns(everything)
        found = found.filter("_held").unionByName(passes(again))
    names = F.array(*[F.lit(c) for c in columns])
    asked = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(p).alias("prob")) for j, p in enumerate(probs)])
    every = work.select(*keys).distinct().select(*keys, F.posexplode(names).alias("_i", "column"), asked.alias("_a")).select(*keys, "_i", "column", F.inline("_a"))
    return every.join(found.select(*cell, "value", "_n"), cell, "left").select(*groups, "column", "prob", "value", F.coalesce("_n", F.lit(0)).alias("n"))


# ----------------------------------------------------------------------------------------------------- hash-order rank
HASH_RANGES = 4096


def _hash_range(u: str, n: int) -> Column:
    return F.least(F.floor(F.col(u) * n), F.lit(n - 1)).cast("int")


def _range_offsets(df: DataFrame, strata: list[str]) -> DataFrame:
    counts = df.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_n"))
    part = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    upto = part.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(
        *strata, "_range", "_n", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(part).alias("_size")
    )


def hashed_rank(df: DataFrame, strata: Sequence[str], u: str, tie: str, out: str = "rank", ranges: int = HASH_RANGES) -> DataFrame:
    """1-based rank by (u, tie) inside each stratum; ``u`` is a uniform hash, so equal-width ranges are balanced."""
    strata = list(strata)
    cut = df.withColumn("_range", _hash_range(u, ranges))
    offsets = _range_offsets(cut, strata).select(*strata, "_range", "_before")
    inside = Window.partitionBy(*strata, "_range").orderBy(u, tie)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*strata, "_range"])
        .withColumn(out, F.col("_rn") + F.col("_before"))
        .drop("_range", "_rn", "_before")
    )


def hashed_prefix(df: DataFrame, u: str, tie: str, weight: str, out: str = "start", ranges: int = HASH_RANGES) -> DataFrame:
    """Sum of ``weight`` over the rows before each row in (u, tie) order."""
    cut = df.withColumn("_range", _hash_range(u, ranges))
    per = cut.groupBy("_range").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_range", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(u, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("_upto", F.sum(weight).over(inside))
    return local.join(offsets, "_range").withColumn(out, F.col("_before") + F.col("_upto") - F.col(weight)).drop("_range", "_upto", "_before")


def cut_thresholds(df: DataFrame, stratum: str, u: str, tie: str, cuts: DataFrame, ranges: int = HASH_RANGES) -> DataFrame:
    """Per stratum an ascending array of (u, tie) thresholds, one per row of ``cuts`` (stratum, slot, upto): the row whose
    rank is ``upto``. ``upto`` may also come as ``cum_share``: the rank is then floor(cum_share * stratum size).

    Two scans: one counts rows by stratum and hash range, the second keeps the rows of ranges that hold a cut, by a
    literal predicate of at most one value per cut, so only about (cuts / ranges) of the rows are shuffled and ranked."""
    cut = df.select(stratum, u, tie).withColumn("_range", _hash_range(u, ranges))
    offsets = materialise(_range_offsets(cut, [stratum]), "range-counts")
    sized = offsets.groupBy(stratum).agg(F.max("_size").alias("_size"))
    wanted = cuts.join(sized, stratum)
    if "upto" not in cuts.columns:
        wanted = wanted.withColumn("upto", F.floor(F.col("cum_share") * F.col("_size")))
    wanted = wanted.select(stratum, "slot", "upto")
    at = materialise(
        offsets.join(wanted, stratum).filter((F.col("upto") > F.col("_before")) & (F.col("upto") <= F.col("_before") + F.col("_n"))), "cut-ranges"
    )
    boundary = at.select(stratum, "_range", "_before").distinct()
    place = f"xxhash64(`{stratum}`, _range)"
    held = ", ".join(f"{r['h']}L" for r in boundary.selectExpr(f"{place} as h").distinct().collect())  # at most a row per cut
    near = cut.filter(f"{place} in ({held})" if held else "false")
    ranked = near.join(boundary, [stratum, "_range"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_range").orderBy(u, tie))
    )
    found = ranked.join(at.select(stratum, "_range", "slot", "upto"), [stratum, "_range"]).filter("_rank = upto")
    low = F.struct(F.lit(-1.0).alias("u"), F.lit(None).cast(df.schema[tie].dataType).alias("tie"))
    return (
        wanted.join(found.select(stratum, "slot", F.struct(F.col(u).alias("u"), F.col(tie).alias("tie")).alias("t")), [stratum, "slot"], "left")
        .groupBy(stratum)
        .agg(F.array_sort(F.collect_list(F.coalesce("t", low))).alias("_thresholds"))
    )


def assign_by_cuts(df: DataFrame, stratum: str, u: str, tie: str, cuts: DataFrame, out: str, ranges: int = HASH_RANGES) -> DataFrame:
    """Slot of each row: how many of its stratum's cuts lie strictly below it in (u, tie) order. Same result as ranking
    the whole stratum, but the table itself is only compared with the thresholds (one row per stratum, written first so
    that Spark knows their size and broadcasts them only when small)."""
    thresholds = materialise(cut_thresholds(df, stratum, u, tie, cuts, ranges), "cut-thresholds")
    me = F.struct(F.col(u).alias("u"), F.col(tie).alias("tie"))
    return (
        df.join(thresholds, stratum, "left")
        .withColumn(out, F.coalesce(F.size(F.filter("_thresholds", lambda t: t < me)), F.lit(0)).cast("int"))
        .drop("_thresholds")
    )


# ------------------------------------------------------------------------------------------------------------- argmax
def argmax_first(value: str | Column, order: str | Column, take: str | Column) -> Column:
    """``take`` of the row with the largest value; among equals the smallest ``order`` wins. NULL values never win."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    return F.max_by(take, F.when(v.isNotNull(), F.struct(v, -o)))


def top_k(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The k largest values with their rank; a distributed top-k, then a rank over k rows."""
    best = df.orderBy(F.col(value).desc(), F.col(tie).asc()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(value).desc(), F.col(tie).asc())))


def sorted_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, position): sorted distinct values with 0-based positions, without gathering them in one task."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("_one", F.lit(1))
    return prefix_sums(values, [], "value", ["_one"]).select("value", (F.col("_one_cum") - 1).alias("position"))


def early_stop(history: DataFrame, groups: Sequence[str], step: str, value: str, patience: int) -> DataFrame:
    """Scan of a training history (one row per group and step): best step so far under strict improvement, and the step
    at which ``patience`` steps in a row have not improved (NULL when training ran to its end)."""
    groups = list(groups)
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    w = part.orderBy(step)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scan = (
        history.withColumn("_improved", F.coalesce(F.col(value) > F.max(value).over(prior), F.col(value).isNotNull()))
        .withColumn("_pos", F.row_number().over(w))
        .withColumn("_best_pos", F.coalesce(F.max(F.when(F.col("_improved"), F.col("_pos"))).over(so_far), F.lit(0)))
        .withColumn("_halt", (F.col("_pos") - F.col("_best_pos")) >= patience)
        .withColumn("_stop", F.min(F.when(F.col("_halt"), F.col(step))).over(part))
        .filter(F.col("_stop").isNull() | (F.col(step) <= F.col("_stop")))
    )
    last_best = F.when(F.col("_improved"), F.struct(F.col(step)))
    return scan.groupBy(*groups).agg(
        F.max_by(step, last_best).alias("best_step"),
        F.max_by(value, last_best).alias("best_value"),
        F.max("_stop").alias("stop_step"),
    )
