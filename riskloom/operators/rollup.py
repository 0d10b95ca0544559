"""Spec-driven rollup of a child table to one row per key: everything one table needs is a single ``groupBy().agg()``.

Null rules: group sums of all-missing cells are 0, means/min/max/var are NULL, rows with a NULL key are dropped, and a
subset (``ACTIVE``, ``REFUSED`` ...) without any row in a group is NULL in all its statistics, sums included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskloom.functions.scalar import clean_name, keep_first_names
from riskloom.session import materialise

Spec = Mapping[str, Sequence[str]]


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stat_sql(column: str, stat: str, where: str | None = None) -> str:
    """One aggregate as SQL text (a wide rollup has hundreds; parsing text is far cheaper than building each expression
    call by call). Mean is written as sum/count, so that a shared sum and count are computed once."""
    c = f"`{column}`"
    x = c if where is None else f"if({where}, {c}, null)"
    number = f"cast({x} as double)"
    if stat in ("min", "max"):
        return f"cast({stat}({x}) as double)"
    if stat == "mean":
        return f"try_divide(sum({number}), cast(count({x}) as double))"
    if stat == "var":
        return f"var_samp({number})"
    by_stat = {
        "sum": f"coalesce(sum({number}), 0d)",
        "size": "count(1)" if where is None else f"count_if({where})",
        "count": f"count({x})",
        "nunique": f"count(distinct {x})",
    }
    if stat not in by_stat:
        raise ValueError(f"unknown statistic: {stat}")
    return by_stat[stat] if where is None else f"if(count_if({where}) > 0, {by_stat[stat]}, null)"


def share_sql(column: str, value: str | None) -> str:
    """Share of the group's rows holding ``value`` (None: missing); missing rows count in the denominator."""
    hit = f"`{column}` is null" if value is None else f"`{column}` <=> {quoted(value)}"
    return f"sum(cast({hit} as int)) / count(1)"


@dataclass(frozen=True)
class Rollup:
    key: str
    prefix: str
    spec: Spec
    categories: Mapping[str, Sequence[str]] = field(default_factory=dict)
    count_name: str | None = None
    subsets: Mapping[str, str] = field(default_factory=dict)  # name -> SQL condition
    subset_spec: Spec | None = None

    def named_sql(self) -> list[tuple[str, str]]:
        out = [(f"{self.prefix}_{c}_{s}", stat_sql(c, s)) for c, stats in self.spec.items() for s in stats]
        for c, values in self.categories.items():
            out += [(f"{self.prefix}_{c}_{v}_MEAN", share_sql(c, v)) for v in values]
            out.append((f"{self.prefix}_{c}_nan_MEAN", share_sql(c, None)))
        if self.count_name:
            out.append((self.count_name, "count(1)"))
        spec = self.spec if self.subset_spec is None else self.subset_spec
        for name, cond in self.subsets.items():
            out += [(f"{self.prefix}_{name}_{c}_{s}", stat_sql(c, s, cond)) for c, stats in spec.items() for s in stats]
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        named = keep_first_names(self.named_sql())
        return df.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(*[F.expr(f"{e} as `{n}`") for n, e in named])


def vocabularies(df: DataFrame, columns: Sequence[str], max_values: int = 5000) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, from one scan of these columns: sets are gathered and merged inside the
    tasks, no row is unfolded. A value becomes a column, so more than ``max_values`` are an error; sizes are looked at in the
    written sets, before any of them reaches the driver."""
    if not columns:
        return {}
    found = materialise(df.agg(*[F.collect_set(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)]), "vocabularies")
    sizes = found.select(*[F.size(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    over = [c for i, c in enumerate(columns) if sizes[i] > max_values]
    if over:
        raise ValueError(f"too many categories to one-hot, give a vocabulary: {over}")
    row = found.first()
    return {c: sorted(row[i]) for i, c in enumerate(columns)}


def gathered(df: DataFrame, key: str) -> DataFrame:
    """The rows of each key in one partition, rows without a key dropped; a rollup or join by the key then needs no other
    shuffle. For wide rollups, whose partial sums (hundreds of numbers a key and task) are far larger than the rows: what is
    shuffled grows with the rows, however the keys lie in the file, and a task holds the sums of its own keys only."""
    return df.filter(F.col(key).isNotNull()).repartition(key)


def generic_spec(columns: Sequence[str], stats: Sequence[str] = ("min", "max", "mean")) -> dict[str, list[str]]:
    return {c: list(stats) for c in columns}


def attach(parent: DataFrame, rolled: DataFrame, key: str) -> DataFrame:
    """Left join of a rollup to its parent; parents without children keep NULL."""
    return parent.join(rolled, key, "left")


def varying_columns(df: DataFrame, keep: Sequence[str] = ("TARGET",)) -> list[str]:
    """Columns with at least two distinct non-null values, from one min/max pass over all columns."""
    names = df.columns
    row = df.agg(*[_constant(c).alias(f"k{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if c in keep or not row[f"k{i}"]]


def _constant(column: str) -> Column:
    return F.min(F.col(f"`{column}`")).eqNullSafe(F.max(F.col(f"`{column}`")))


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ("TARGET",)) -> DataFrame:
    """The table without constant columns. It is evaluated once: written, with each column's least and greatest value
    observed on the way, and read back without the columns that turned out constant."""
    watch = Observation()
    stored = materialise(df.observe(watch, *[_constant(c).alias(f"k{i}") for i, c in enumerate(df.columns)]), "observed")
    found = watch.get
    return stored.select([f"`{c}`" for i, c in enumerate(df.columns) if c in keep or not found[f"k{i}"]])


def column_name(prefix: str, column: str, stat: str) -> str:
    return clean_name(f"{prefix}_{column}_{stat}")
