"""Paired bootstrap of AUC with Poisson(1) row weights.

A row's weights follow from its key alone, so every method sees the same resample and no resampled row is ever written
or shuffled. Rows are spread over score ranges; inside a task the weighted rank sums of all rounds are accumulated in one
sweep over sorted batches with constant memory. Ranges are then combined with ordinary window sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import bootstrap_seeds, poisson_weights
from riskloom.operators.metrics import auc, pair_rows
from riskloom.operators.ordered import _range_count, range_index, sampled_bounds

CHUNK = 2048


class _RangeSums:
    """Weighted rank sums of one score range; the last tie block stays open until the next score or range."""

    def __init__(self, rounds: int):
        self.num = np.zeros(rounds)
        self.pos = np.zeros(rounds)
        self.neg = np.zeros(rounds)
        self.open_score: float | None = None
        self.open_pos = self.open_neg = self.num

    def add_blocks(self, scores: np.ndarray, wp: np.ndarray, wn: np.ndarray) -> None:
        if self.open_score is not None:
            if scores[0] == self.open_score:
                wp[0] += self.open_pos
                wn[0] += self.open_neg
            else:
                self._close(self.open_pos, self.open_neg)
        if len(scores) > 1:
            before = np.cumsum(wn[:-1], axis=0) - wn[:-1] + self.neg
            self.num += (wp[:-1] * (before + 0.5 * wn[:-1])).sum(axis=0)
            self.pos += wp[:-1].sum(axis=0)
            self.neg += wn[:-1].sum(axis=0)
        self.open_score, self.open_pos, self.open_neg = float(scores[-1]), wp[-1].copy(), wn[-1].copy()

    def _close(self, wp: np.ndarray, wn: np.ndarray) -> None:
        self.num += wp * (self.neg + 0.5 * wn)
        self.pos += wp
        self.neg += wn

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._close(self.open_pos, self.open_neg)
        return self.num, self.pos, self.neg


def _sweep(keys: Sequence[str], rounds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums = None, None

        def emit():
            num, pos, neg = sums.finish()
            return pd.DataFrame([[*current, num, pos, neg]], columns=[*keys, "num", "pos", "neg"])

        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                score = part["score"].to_numpy(float)
                y = part["y"].to_numpy(np.float64)[:, None]
                w = poisson_weights(part["s1"].to_numpy(), part["s2"].to_numpy(), rounds).astype(np.float64)
                key_cols = [part[k].to_numpy() for k in keys]
                change = np.zeros(len(part), dtype=bool)
                change[0] = True
                for c in key_cols:
                    change[1:] |= c[1:] != c[:-1]
                key_start = np.flatnonzero(change)
                change[1:] |= score[1:] != score[:-1]
                starts = np.flatnonzero(change)
                wp = np.add.reduceat(w * y, starts, axis=0)
                wn = np.add.reduceat(w * (1.0 - y), starts, axis=0)
                ends = [*key_start[1:], len(part)]
                for lo, hi in zip(key_start, ends):
                    key = tuple(c[lo] for c in key_cols)
                    if key != current:
                        if sums is not None:
                            yield emit()
                        current, sums = key, _RangeSums(rounds)
                    a, b = np.searchsorted(starts, [lo, hi])
                    sums.add_blocks(score[starts[a:b]], wp[a:b], wn[a:b])
        if sums is not None:
            yield emit()

    return run


def _tie_sums(keys: Sequence[str], rounds: int, most: int = 4096):
    """Weighted class totals of single-score groups, added up inside each task; totals are additive, so rows need not
    meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}

        def emit():
            return pd.DataFrame([[*k, v[0], v[1]] for k, v in acc.items()], columns=[*keys, "pos", "neg"])

        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at : at + CHUNK]
                w = poisson_weights(part["s1"].to_numpy(), part["s2"].to_numpy(), rounds).astype(np.float64)
                y = part["y"].to_numpy(np.float64)
                for key, idx in part.groupby(list(keys), sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    cell = acc.setdefault(key, np.zeros((2, rounds)))
                    cell[0] += y[idx] @ w[idx]
                    cell[1] += (1.0 - y[idx]) @ w[idx]
                if len(acc) > most:
                    yield emit()
                    acc.clear()
        if acc:
            yield emit()

    return run


def bootstrap_auc(
    df: DataFrame, groups: Sequence[str], rounds: int, seed: int = 42, key: str = "SK_ID_CURR", score: str = "prob", target: str = "TARGET"
) -> DataFrame:
    """(groups, round, roc_auc) per resample; resamples with one class are left out.

    A score shared by more than one range's worth of rows gets a place of its own between the ranges: its rows are only
    added up (no shuffle, no order needed), so that neither a large group nor a frequent score ends in one task."""
    groups = list(groups)
    s1, s2 = bootstrap_seeds(seed, key)
    rows = df.filter(F.col(score).isNotNull()).select(
        *groups, F.col(score).cast("double").alias("score"), F.col(target).cast("double").alias("y"), s1.alias("s1"), s2.alias("s2")
    )
    ranges = _range_count(df)
    per_score = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    limit = per_score.agg(F.sum("n") / F.lit(ranges)).scalar()
    frequent = per_score.withColumn("_limit", limit).filter(F.col("n") > F.col("_limit")).agg(F.array_sort(F.collect_list("score"))).scalar()
    cut = (
        rows.withColumns({"_b": sampled_bounds(rows, groups, "score", ranges), "_f": frequent})
        .withColumns(
            {
                "range": range_index(F.col("score"), F.col("_b"), ranges),
                "lower": F.size(F.filter("_f", lambda f: f < F.col("score"))),
                "alone": F.array_contains("_f", F.col("score")).cast("int"),
            }
        )
        .drop("_b", "_f")
    )
    place = ["range", "lower", "alone"]
    keys = [*groups, *place]
    kinds = ", ".join(f"`{k}` {cut.schema[k].dataType.simpleString()}" for k in keys)
    swept = (
        cut.filter("alone = 0").repartition(*keys).sortWithinPartitions(*keys, "score")
        .mapInPandas(_sweep(keys, rounds), f"{kinds}, num array<double>, pos array<double>, neg array<double>")
    )
    per_round = swept.select(*keys, F.posexplode(F.arrays_zip("num", "pos", "neg")).alias("round", "v")).select(*keys, "round", "v.*")
    ties = cut.filter("alone = 1").mapInPandas(_tie_sums(keys, rounds), f"{kinds}, pos array<double>, neg array<double>")
    tied = (
        ties.select(*keys, F.posexplode(F.arrays_zip("pos", "neg")).alias("round", "v"))
        .groupBy(*keys, "round").agg(F.sum("v.pos").alias("pos"), F.sum("v.neg").alias("neg"))
        .select(*keys, "round", (F.lit(0.5) * F.col("pos") * F.col("neg")).alias("num"), "pos", "neg")
    )
    below = Window.partitionBy(*groups, "round").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    joined = per_round.unionByName(tied).withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return (
        joined.groupBy(*groups, "round")
        .agg(
            F.sum(F.col("num") + F.col("pos") * F.col("below")).alias("num"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
        )
        .filter((F.col("p") > 0) & (F.col("n") > 0))
        .select(*groups, "round", (F.col("num") / (F.col("p") * F.col("n"))).alias("roc_auc"))
    )


def paired_bootstrap(
    long: DataFrame,
    pairs: Sequence[tuple[str, str]],
    rounds: int = 1000,
    seed: int = 42,
    client: str = "client",
    method: str = "method",
    key: str = "SK_ID_CURR",
    score: str = "prob",
    target: str = "TARGET",
) -> DataFrame:
    """(a, b, client, delta_auc, ci_low, ci_high, p_delta_le_0): all pairs and clients from one resampling."""
    used = sorted({m for p in pairs for m in p})
    rows = long.filter(F.col(method).isin(used))
    resampled = pair_rows(bootstrap_auc(rows, [method, client], rounds, seed, key, score, target), pairs, [client, "round"])
    interval = (
        resampled.filter(F.col("delta").isNotNull())
        .groupBy("a", "b", client)
        .agg(
            F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"),
            F.avg((F.col("delta") <= 0).cast("double")).alias("p_delta_le_0"),
        )
        .select("a", "b", client, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "p_delta_le_0")
    )
    point = pair_rows(auc(rows, [method, client], score, target), pairs, [client]).withColumnRenamed("delta", "delta_auc")
    return point.join(interval, ["a", "b", client], "left")
