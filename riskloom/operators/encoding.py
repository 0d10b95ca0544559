"""Feature encoders fitted on training rows only. Fitted state is a few numbers per column plus the category lists, all
bounded (a kept category holds at least ``min_frequency`` of the rows), so applying an encoder is a plain projection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators.contracts import ContractError
from riskloom.operators.ordered import group_quantiles, prefix_sums
from riskloom.operators.rollup import quoted, vocabularies
from riskloom.session import materialise

OTHER, MISSING, INFREQUENT = "__OTHER__", "__MISSING__", "infrequent_sklearn"
FILL = "MISSING"
MAX_CLIENTS = 10_000


def category_counts(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, column, value, n) for all columns in one pass; value NULL counts missing cells."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*groups, F.inline(cells)).groupBy(*groups, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def double(x: float | None) -> str:
    return "cast(null as double)" if x is None else f"double('{x!r}')"


def finite_sql(name: str) -> str:
    """NaN and infinities as NULL, as SQL text (encoders have hundreds of columns; text is cheap to build)."""
    c = f"cast(`{name}` as double)"
    return f"if(isnan({c}) or abs({c}) = double('infinity'), null, {c})"


def clip_sql(name: str, low: float | None, high: float | None) -> str:
    """Finite value clipped to [low, high]; a missing limit does not clip, a missing value stays missing."""
    x = finite_sql(name)
    bounded = x
    if low is not None:
        bounded = f"greatest({bounded}, {double(low)})"
    if high is not None:
        bounded = f"least({bounded}, {double(high)})"
    return f"if({x} is null, null, {bounded})"


# ----------------------------------------------------------------------------------------------------- pooled encoder
@dataclass(frozen=True)
class NumericStats:
    name: str
    low: float | None
    high: float | None
    median: float | None
    missing: bool
    mean: float = 0.0
    scale: float = 1.0
    indicator_mean: float = 0.0
    indicator_scale: float = 1.0

    def clipped(self) -> Column:
        return F.expr(clip_sql(self.name, self.low, self.high))

    def filled_sql(self) -> str:
        return f"coalesce({clip_sql(self.name, self.low, self.high)}, {double(self.median)})"

    def filled(self) -> Column:
        return F.expr(self.filled_sql())


@dataclass(frozen=True)
class CategoryStats:
    name: str
    kept: tuple[str, ...]
    has_infrequent: bool


@dataclass(frozen=True)
class PooledEncoder:
    """Clip to training quantiles -> median with missing indicator -> standardise; one-hot with a missing category, rare
    values pooled, unknown values treated as rare when there are rare values and as all zeros otherwise."""

    numeric: tuple[NumericStats, ...]
    categorical: tuple[CategoryStats, ...]

    def named(self) -> list[tuple[str, str]]:
        """(name, SQL text) of every encoded column, in order: numbers, indicators, categories."""
        out = []
        for s in self.numeric:
            if s.median is not None:
                out.append((s.name, f"({s.filled_sql()} - {double(s.mean)}) / {double(s.scale)}"))
        for s in self.numeric:
            if s.missing:
                flag = f"cast({finite_sql(s.name)} is null as double)"
                out.append((f"missingindicator_{s.name}", f"({flag} - {double(s.indicator_mean)}) / {double(s.indicator_scale)}"))
        for c in self.categorical:
            value = f"coalesce(cast(`{c.name}` as string), {quoted(FILL)})"
            out += [(f"{c.name}_{v}", f"cast({value} = {quoted(v)} as double)") for v in c.kept]
            if c.has_infrequent:
                known = ", ".join(quoted(v) for v in c.kept)
                out.append((f"{c.name}_{INFREQUENT}", f"cast({value} not in ({known}) as double)" if c.kept else "1d"))
        return out

    def names(self) -> list[str]:
        return [n for n, _ in self.named()]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.selectExpr(*keep, *[f"{e} as `{n}`" for n, e in self.named()])

    def transform_array(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        cells = ", ".join(f"cast({e} as float)" for _, e in self.named())
        return df.selectExpr(*keep, f"array({cells}) as `{out}`")


def filled_cells(df: DataFrame, stats: Sequence[NumericStats | SharedNumeric], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, i, v): every cell clipped and filled, in long form; limits are literal arrays, so the plan does not grow."""
    known = lambda x: x is not None and abs(x) != S.INF
    limits = {n: ", ".join(double(v if known(v) else None) for v in (getattr(s, n) for s in stats)) for n in ("low", "high", "median")}
    cells = ", ".join(f"cast(`{s.name}` as double)" for s in stats)
    arrays = [f"array({cells}) as _x", *(f"array({v}) as _{n}" for n, v in limits.items())]
    long = df.selectExpr(*keep, *arrays).selectExpr(*keep, "posexplode(arrays_zip(_x, _low, _high, _median)) as (i, c)")
    # greatest and least skip a missing limit
    missing = "c._x is null or isnan(c._x) or abs(c._x) = double('infinity')"
    return long.selectExpr(*keep, "i", f"if({missing}, c._median, least(greatest(c._x, c._low), c._high)) as v")


def filled_moments(df: DataFrame, stats: Sequence[NumericStats]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column after clipping and filling, a row per column from one aggregation."""
    if not stats:
        return {}
    rows = filled_cells(df, stats).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    return {stats[r["i"]].name: (r["m"], r["s"]) for r in rows}


def fit_pooled(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], clip=(0.01, 0.99), min_frequency: float = 0.005, stored: bool = False
) -> PooledEncoder:
    """Fitting makes several passes, so the needed columns are written once first, unless ``df`` is ``stored`` already."""
    num = list(numeric)
    x = df.selectExpr(*[f"{finite_sql(c)} as `{c}`" for c in num], *[f"`{c}`" for c in categorical])
    x = x if stored else materialise(x, "fit")
    stats: list[NumericStats] = []
    n_rows = 0
    if num:
        n_rows = x.count()
        q: dict[str, dict] = {c: {} for c in num}
        nonnull = dict.fromkeys(num, 0)
        for r in group_quantiles(x, [], num, [clip[0], 0.5, clip[1]]).collect():
            q[r["column"]][r["prob"]], nonnull[r["column"]] = r["value"], r["n"]
        bare = [NumericStats(c, q[c].get(clip[0]), q[c].get(clip[1]), q[c].get(0.5), nonnull[c] < n_rows) for c in num]
        moments = filled_moments(x, [s for s in bare if s.median is not None])
        for s in bare:
            share = 1.0 - nonnull[s.name] / n_rows if n_rows else 0.0
            m, sd = moments.get(s.name, (0.0, 1.0))
            ind = math.sqrt(share * (1.0 - share))
            stats.append(NumericStats(s.name, s.low, s.high, s.median, s.missing, m, sd or 1.0, share, ind or 1.0))
    cats: list[CategoryStats] = []
    if categorical:
        n_rows = n_rows or x.count()
        counted = category_counts(x, categorical).withColumn("value", F.coalesce("value", F.lit(FILL)))
        counted = counted.groupBy("column", "value").agg(F.sum("n").alias("n"))
        frequent = F.col("n") >= F.lit(min_frequency * n_rows)
        found = counted.groupBy("column").agg(
            F.array_sort(F.collect_list(F.when(frequent, F.col("value")))).alias("kept"), F.coalesce(F.bool_or(~frequent), F.lit(False)).alias("rare")
        )
        by = {r["column"]: r for r in found.collect()}
        cats = [CategoryStats(c, tuple(by[c]["kept"]) if c in by else (), bool(c in by and by[c]["rare"])) for c in categorical]
    return PooledEncoder(tuple(stats), tuple(cats))


def encode_nodes(nodes, train_ids: DataFrame, columns, **fit) -> dict:
    """One pooled encoder per node type, fitted on all nodes whose root customer is in training."""
    out = {}
    for kind, df in nodes.items():
        num, cat = columns(kind, df)
        train = df.join(train_ids.select(F.col("SK_ID_CURR").alias("root_id")), "root_id", "left_semi")
        stored = materialise(train.select(*num, *cat), f"fit-{kind}")
        out[kind] = fit_pooled(stored, num, cat, stored=True, **fit)
    return out


# ------------------------------------------------------------------------------------------------- ordered categories
#: Values per column that are looked up in the plan itself; all others are joined.
FREQUENT = 64


def fit_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code, n), written: every value's 0-based position in its column's order and its count. Any number of
    values; positions are running sums over ranges, no column is ordered in one task."""
    counted = category_counts(df, columns).filter(F.col("value").isNotNull()).withColumn("_one", F.lit(1))
    placed = prefix_sums(materialise(counted, "values"), ["column"], "value", ["_one"])
    return materialise(placed.select("column", "value", (F.col("_one_cum") - 1).cast("int").alias("code"), "n"), "dictionary")


def encode_with_dictionary(df: DataFrame, dictionary: DataFrame, columns: Sequence[str], key: str, frequent: int = FREQUENT) -> DataFrame:
    """Category codes, unseen values NULL; infinities NULL. ``key`` names each row. The most frequent values of a column are
    literals, so hot values are never shuffled; cells with other values are joined in long form and come back as one row a
    key."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    often: dict[str, dict[str, int]] = {c: {} for c in columns}
    heads = dictionary.filter(F.col("column").isin(list(columns))).withColumn("_r", rank).filter(F.col("_r") <= frequent)
    for r in heads.collect():  # at most ``frequent`` rows a column
        often[r["column"]][r["value"]] = r["code"]
    rest = F.array(*[
        F.when(~F.col(c).cast("string").isin(list(often[c])), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c in columns
    ])
    cells = df.select(key, F.inline(F.array_compact(rest)))
    found = cells.join(dictionary.select("column", "value", "code"), ["column", "value"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("column", "code"))).alias("_codes"))
    codes = {}
    for c in columns:
        table = F.create_map(*[F.lit(x) for pair in often[c].items() for x in pair]) if often[c] else None
        known = F.lit(None).cast("int") if table is None else F.try_element_at(table, F.col(c).cast("string"))
        codes[c] = F.coalesce(known, F.try_element_at("_codes", F.lit(c)))
    return S.finite_all(df).join(found, key, "left").withColumns(codes).drop("_codes")


def fit_domains(df: DataFrame, columns: Sequence[str], max_values: int = 100_000) -> dict[str, list[str]]:
    return vocabularies(df, columns, max_values)


def encode_domains(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Category codes by position in the fitted domain, unseen values NULL; infinities NULL."""
    codes = {}
    for c, values in domains.items():
        table = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]) if values else None
        codes[c] = F.lit(None).cast("int") if table is None else F.try_element_at(table, F.col(c))
    return S.finite_all(df).withColumns(codes)


# -------------------------------------------------------------------------------------------------- shared encoder
def round1_numeric(df: DataFrame, client: str, numeric: Sequence[str], clip=(0.01, 0.99)) -> DataFrame:
    """Per client and column: n, non-missing count, quantiles (low, median, high), has_missing. All clients at once."""
    x = df.selectExpr(f"`{client}`", *[f"{finite_sql(c)} as `{c}`" for c in numeric])
    rows = materialise(x.groupBy(client).agg(F.count(F.lit(1)).alias("n_rows")), "client-rows")
    q = group_quantiles(x, [client], numeric, [clip[0], 0.5, clip[1]])

    def at(p):
        return F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value")))

    wide = q.groupBy(client, "column").agg(F.max("n").alias("nonnull"), at(clip[0]).alias("q_low"), at(0.5).alias("q_median"), at(clip[1]).alias("q_high"))
    out = wide.join(rows, client).select(client, F.col("n_rows").alias("n"), "column", "nonnull", "q_low", "q_median", "q_high")
    return out.select(client, "n", "column", "nonnull", (F.col("nonnull") < F.col("n")).alias("has_missing"), "q_low", "q_median", "q_high")


def round1_categories(df: DataFrame, client: str, categorical: Sequence[str]) -> DataFrame:
    return category_counts(df, categorical, [client]).filter(F.col("value").isNotNull())


def merge_round1_numeric(stats: DataFrame) -> DataFrame:
    """(column, low, median, high, missing): quantiles averaged by non-missing counts; nothing known -> -inf, 0, +inf."""

    def merged(q: str) -> Column:
        w = F.when(F.col(q).isNotNull(), F.col("nonnull").cast("double"))
        return F.try_divide(F.sum(F.col(q) * w), F.sum(w))

    return stats.groupBy("column").agg(
        F.coalesce(merged("q_low"), F.lit(-S.INF)).alias("low"),
        F.coalesce(merged("q_median"), F.lit(0.0)).alias("median"),
        F.coalesce(merged("q_high"), F.lit(S.INF)).alias("high"),
        F.bool_or("has_missing").alias("missing"),
    )


def merge_round1_categories(counts: DataFrame, total_rows: Column | int, min_frequency: float = 0.005) -> DataFrame:
    """(column, value, n) of the values holding at least ``min_frequency`` of all rows, missing ones included."""
    total = F.lit(total_rows) if isinstance(total_rows, int) else total_rows
    pooled = counts.groupBy("column", "value").agg(F.sum("n").alias("n")).withColumn("_total", total)
    return pooled.filter(F.col("n") / F.col("_total") >= F.lit(min_frequency)).drop("_total")


@dataclass(frozen=True)
class SharedNumeric:
    name: str
    low: float
    median: float
    high: float
    missing: bool
    mean: float = 0.0
    std: float = 1.0

    def filled_sql(self) -> str:
        low = None if self.low == -S.INF else self.low
        high = None if self.high == S.INF else self.high
        return f"coalesce({clip_sql(self.name, low, high)}, {double(self.median)})"


@dataclass(frozen=True)
class SharedEncoder:
    """Encoder every institution can apply, built from their statistics only."""

    numeric: tuple[SharedNumeric, ...]
    vocab: dict[str, list[str]]

    def named(self) -> list[tuple[str, str]]:
        """(name, SQL text) in fixed order: numbers, raw 0/1 indicators, categories with other and missing."""
        out = [(s.name, f"({s.filled_sql()} - {double(s.mean)}) / {double(s.std)}") for s in self.numeric]
        out += [(f"{s.name}_missingindicator", f"cast({finite_sql(s.name)} is null as double)") for s in self.numeric if s.missing]
        for c, values in self.vocab.items():
            v = f"cast(`{c}` as string)"
            out += [(f"{c}_{x}", f"cast({v} <=> {quoted(x)} as double)") for x in values]
            known = f" and {v} not in ({', '.join(quoted(x) for x in values)})" if values else ""
            out.append((f"{c}_{OTHER}", f"cast(({v} is not null{known}) as double)"))
            out.append((f"{c}_{MISSING}", f"cast({v} is null as double)"))
        return out

    def names(self) -> list[str]:
        return [n for n, _ in self.named()]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.selectExpr(*keep, *[f"{e} as `{n}`" for n, e in self.named()])

    def transform_array(self, df: DataFrame, keep: Sequence[str] = (), out: str = "features") -> DataFrame:
        cells = ", ".join(f"cast({e} as float)" for _, e in self.named())
        return df.selectExpr(*keep, f"array({cells}) as `{out}`")


def round2(df: DataFrame, client: str, numeric: Sequence[SharedNumeric]) -> DataFrame:
    """Per client and column: n, sum and sum of squares after clipping and filling."""
    names = F.array(*[F.lit(s.name) for s in numeric])
    cells = filled_cells(df, numeric, [f"`{client}`"])
    per = cells.groupBy(client, "i").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sumsq"))
    return per.select(client, "n", F.element_at(names, F.col("i") + 1).alias("column"), "sum", "sumsq")


def merge_round2(stats: DataFrame) -> DataFrame:
    """(column, mean, std): pooled moments; a deviation below 1e-8 becomes 1."""
    pooled = stats.groupBy("column").agg(F.sum("n").alias("n"), F.sum("sum").alias("s"), F.sum("sumsq").alias("q"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return pooled.select("column", mean.alias("mean"), F.when(std < 1e-8, F.lit(1.0)).otherwise(std).alias("std"))


def fit_shared(
    df: DataFrame,
    client: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    clip=(0.01, 0.99),
    min_frequency: float = 0.005,
    stored: bool = False,
) -> SharedEncoder:
    """Both statistics rounds over training rows; only merged numbers reach the driver. The needed columns are written
    once first, unless ``df`` is ``stored`` already."""
    if not stored:
        df = materialise(df.select(client, *dict.fromkeys([*numeric, *categorical])), "fit")
    num: list[SharedNumeric] = []
    if numeric:
        merged = {r["column"]: r for r in merge_round1_numeric(round1_numeric(df, client, numeric, clip)).collect()}
        num = [SharedNumeric(c, merged[c]["low"], merged[c]["median"], merged[c]["high"], merged[c]["missing"]) for c in numeric]
        moments = {r["column"]: r for r in merge_round2(round2(df, client, num)).collect()}
        num = [SharedNumeric(s.name, s.low, s.median, s.high, s.missing, moments[s.name]["mean"], moments[s.name]["std"]) for s in num]
    vocab: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        kept = merge_round1_categories(round1_categories(df, client, categorical), df.count(), min_frequency)
        for r in kept.collect():
            vocab[r["column"]].append(r["value"])
        vocab = {c: sorted(v) for c, v in vocab.items()}
    return SharedEncoder(tuple(num), vocab)


def require_few_clients(df: DataFrame, client: str = "client") -> list:
    rows = df.select(client).distinct().limit(MAX_CLIENTS + 1).collect()
    if len(rows) > MAX_CLIENTS:
        raise ContractError(f"more than {MAX_CLIENTS} institutions")
    return sorted(r[0] for r in rows)
