"""Row-level expressions. Missing is always NULL here: NaN and infinities become NULL at the boundary (``finite``)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
FLOATING = (T.FloatType, T.DoubleType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and +-infinity -> NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def finite_all(df: DataFrame) -> DataFrame:
    """``finite`` on every float/double column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    text = "if(isnan(`{0}`) or abs(`{0}`) = double('infinity'), null, `{0}`)"
    return df.withColumns({n: F.expr(text.format(n)) for n in names}) if names else df


def sentinel_flag(c: str | Column, sentinel) -> Column:
    return F.coalesce(col(c) == F.lit(sentinel), F.lit(False)).cast("int")


def null_if(c: str | Column, *placeholders) -> Column:
    """Any of the placeholder values -> NULL."""
    c = col(c)
    for p in placeholders:
        c = F.nullif(c, F.lit(p))
    return c


def yes_no(c: str | Column) -> Column:
    """Y -> 1, N -> 0, anything else NULL."""
    c = col(c)
    return F.when(c == "Y", F.lit(1.0)).when(c == "N", F.lit(0.0))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b in double; NULL when b is 0 or either side is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: str | Column, lower=None, upper=None) -> Column:
    """Clip that keeps NULL (``greatest``/``least`` alone would skip it)."""
    c = col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, lower if isinstance(lower, Column) else F.lit(lower))
    if upper is not None:
        out = F.least(out, upper if isinstance(upper, Column) else F.lit(upper))
    return F.when(c.isNotNull(), out)


def is_positive(c: str | Column) -> Column:
    """1 when c > 0, else 0, also 0 when missing."""
    return F.coalesce(col(c) > 0, F.lit(False)).cast("int")


def is_missing(c: str | Column) -> Column:
    return col(c).isNull().cast("int")


def _add(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def row_count(cols: Iterable[str]) -> Column:
    return _add([F.col(c).isNotNull().cast("int") for c in cols])


def row_sum(cols: Iterable[str]) -> Column:
    """Sum over columns skipping NULL; no column or all NULL gives 0."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    return _add(parts) if parts else F.lit(0.0)


def row_mean(cols: list[str]) -> Column:
    return F.try_divide(row_sum(cols), row_count(cols).cast("double"))


def row_std(cols: list[str]) -> Column:
    """Sample deviation (ddof 1) over the non-NULL cells; NULL below two."""
    mean, n = row_mean(cols), row_count(cols)
    square = _add([F.coalesce((F.col(c) - mean) * (F.col(c) - mean), F.lit(0.0)) for c in cols])
    return F.when(n > 1, F.sqrt(square / (n - 1)))


def row_min(cols: list[str]) -> Column:
    return F.least(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])


def row_product(cols: list[str]) -> Column:
    """Product, NULL unless every cell is present."""
    out = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        out = out * F.col(c)
    return out


def remap(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Literal dictionary lookup; unmapped -> NULL (see ``contracts.require_no_null``)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))


def age_years(days: str | Column) -> Column:
    return -col(days) / F.lit(365.25)


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    q = clip(col(p).cast("double"), eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def tie_safe_round(x: str | Column, digits: int) -> Column:
    """Round once at the end with a small offset, so that exact halves fall the same way in every engine."""
    return F.round(col(x) + F.lit(3.7e-4 * 10.0**-digits), digits)


def clean_name(name: str) -> str:
    """Upper-case, every run outside [A-Z0-9_] becomes one underscore."""
    return re.sub(r"[^A-Z0-9_]+", "_", name.upper())


def keep_first_names(named: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Cleaned names with their expressions, dropping later ones whose cleaned name is already taken."""
    seen: dict[str, str] = {}
    for name, expr in named:
        seen.setdefault(clean_name(name), expr)
    return list(seen.items())


def downcast(df: DataFrame, id_prefix: str = "SK_ID") -> DataFrame:
    """double -> float for a sink; bigint -> int except ids. Integer width is not narrowed further: Parquet stores
    every width below 32 bits as INT32 anyway."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = c.cast("float")
        elif isinstance(f.dataType, T.LongType) and not f.name.startswith(id_prefix):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(out)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def split_feature_types(df: DataFrame, exclude: Iterable[str] = ("SK_ID_CURR", "TARGET")) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by type; ids and target left out."""
    return numeric_columns(df, exclude), string_columns(df, exclude)
