"""Concept shift between institutions, calibration tests, and blending of shared and local scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.functions.hashing import bootstrap_seeds, poisson_weights
from riskloom.functions.stats import chi2_sf
from riskloom.operators.metrics import auc
from riskloom.operators.ordered import argmax_first
from riskloom.session import materialise, small_table

# Blend weights 0, 0.05, ..., 1.
GRID = [i / 20 for i in range(21)]
MAX_CLIENTS = 10_000


# ------------------------------------------------------------------------------------------------------- cross matrix
def cross_matrix(long: DataFrame, model: str = "model", client: str = "client", score: str = "prob", target: str = "TARGET") -> DataFrame:
    """(model, client, roc_auc): every model on every institution's rows."""
    return auc(long, [model, client], score, target)


def wide_matrix(matrix: DataFrame, clients: Sequence, model: str = "model", client: str = "client") -> DataFrame:
    return matrix.groupBy(model).agg(*[F.max(F.when(F.col(client) == k, F.col("roc_auc"))).alias(f"C{k}") for k in clients])


def cross_summary(matrix: DataFrame, model: str = "model", client: str = "client") -> DataFrame:
    """Per institution j: its own model, the mean and best of the others, and how much the others lose against their home
    ground. ``model`` and ``client`` hold the same ids."""
    home = matrix.filter(F.col(model) == F.col(client)).select(model, F.col("roc_auc").alias("_home"))
    other = F.col(model) != F.col(client)
    foreign = F.avg(F.when(other, F.col("roc_auc")))
    own = F.max(F.when(~other, F.col("roc_auc")))
    return matrix.join(home, model).groupBy(client).agg(
        own.alias("own"), foreign.alias("foreign_mean"), F.max(F.when(other, F.col("roc_auc"))).alias("foreign_best"),
        (own - foreign).alias("own_minus_foreign_mean"), F.avg(F.when(other, F.col("roc_auc") - F.col("_home"))).alias("drop_when_applied_here"),
    )


def own_predictions(long: DataFrame, model: str = "model", client: str = "client") -> DataFrame:
    return long.filter(F.col(model) == F.col(client))


# ------------------------------------------------------------------------------------------------------ calibration fits
def _fit_sums(data: DataFrame, client: str, table: DataFrame, models: int) -> DataFrame:
    """Gradient, curvature and log-likelihood sums of ``models`` logistic fits per client, one aggregation."""
    row = data.join(table, client)
    parts = []
    for m in range(models):
        eta = F.col(f"a{m}") + F.col(f"b{m}") * F.col("s")
        mu = S.sigmoid(eta)
        w = mu * (F.lit(1.0) - mu)
        r = F.col("y") - mu
        loss = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        for name, e in [("g0", r), ("g1", r * F.col("s")), ("h00", w), ("h01", w * F.col("s")), ("h11", w * F.col("s") * F.col("s")), ("ll", F.col("y") * eta - loss)]:
            parts.append(F.sum(e).alias(f"{name}_{m}"))
    return row.groupBy(client).agg(*parts)


def _solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    step = np.linalg.lstsq(h, g, rcond=None)[0]
    size = np.abs(step).max(initial=0.0)
    return step * min(1.0, 5.0 / size) if size > 0 else step


def _solve_arrow(diagonal: np.ndarray, border: np.ndarray, corner: float, g: np.ndarray, last: float) -> np.ndarray:
    """Newton step of own intercepts and one shared slope: the diagonal block is eliminated, so it is linear in clients."""
    d = np.maximum(diagonal, 1e-300)
    rest = corner - (border**2 / d).sum()
    slope = (last - (border * g / d).sum()) / rest if rest > 1e-12 * max(corner, 1e-300) else 0.0
    step = np.append((g - border * slope) / d, slope)
    size = np.abs(step).max(initial=0.0)
    return step * min(1.0, 5.0 / size) if size > 0 else step


def calibration_rates(df: DataFrame, client: str = "client", score: str = "prob", target: str = "TARGET") -> DataFrame:
    """Observed and mean predicted rate per client."""
    known = df.filter(F.col(score).isNotNull())
    return known.groupBy(client).agg(F.avg(F.col(target).cast("double")).alias("observed_rate"), F.avg(score).alias("mean_predicted"), F.count(F.lit(1)).alias("n"))


def calibration_test(df: DataFrame, client: str = "client", score: str = "prob", target: str = "TARGET", steps: int = 40, tol: float = 1e-9) -> tuple[dict, list[dict]]:
    """Three nested logistic fits of the outcome on logit(score): shared line, own intercepts, own slopes. Returns the two
    likelihood-ratio tests and the per-client line with observed and predicted rate. Every Newton step of all three fits
    is one grouped aggregation; the driver sees six numbers per client and fit. A client with one class has no finite
    own line: its coefficients are missing and its own-line log-likelihood is the limit 0."""
    cols = df.filter(F.col(score).isNotNull()).select(
        client, F.col(target).cast("double").alias("y"), F.col(score).cast("double").alias("p"), S.logit(score).alias("s")
    )
    data = materialise(cols, "calibration")
    info = (
        data.groupBy(client)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.avg("p").alias("mean_predicted"))
        .limit(MAX_CLIENTS + 1).collect()
    )
    if len(info) > MAX_CLIENTS:
        raise ValueError("too many institutions")
    info.sort(key=lambda r: r[client])
    ids = [r[client] for r in info]
    k = len(ids)
    two = np.array([0 < r["pos"] < r["n"] for r in info])
    a, b = np.zeros((3, k)), np.ones((3, k))
    kind = df.schema[client].dataType.simpleString()
    ll = np.zeros(3)
    for _ in range(steps):
        table = small_table(
            df.sparkSession, [(ids[i], *[float(v) for m in range(3) for v in (a[m, i], b[m, i])]) for i in range(k)],
            f"`{client}` {kind}, a0 double, b0 double, a1 double, b1 double, a2 double, b2 double",
        )
        sums = {r[client]: r for r in _fit_sums(data, client, table, 3).collect()}

        def get(name, m):
            return np.array([sums[i][f"{name}_{m}"] for i in ids])

        ll = np.array([get("ll", 0).sum(), get("ll", 1)[two].sum(), get("ll", 2)[two].sum()])
        moved = 0.0
        h = np.array([[get("h00", 0).sum(), get("h01", 0).sum()], [get("h01", 0).sum(), get("h11", 0).sum()]])
        d = _solve(h, np.array([get("g0", 0).sum(), get("g1", 0).sum()]))
        a[0] += d[0]
        b[0] += d[1]
        moved = max(moved, np.abs(d).max())
        on = np.flatnonzero(two)
        if len(on):
            m = len(on)
            d = _solve_arrow(get("h00", 1)[on], get("h01", 1)[on], get("h11", 1)[on].sum(), get("g0", 1)[on], get("g1", 1)[on].sum())
            a[1, on] += d[:m]
            b[1] += d[m]
            moved = max(moved, np.abs(d).max())
            for i in on:
                h = np.array([[get("h00", 2)[i], get("h01", 2)[i]], [get("h01", 2)[i], get("h11", 2)[i]]])
                d = _solve(h, np.array([get("g0", 2)[i], get("g1", 2)[i]]))
                a[2, i] += d[0]
                b[2, i] += d[1]
                moved = max(moved, np.abs(d).max())
        if moved < tol:
            break
    else:
        raise RuntimeError(f"the calibration fits did not converge in {steps} steps")
    n = sum(r["n"] for r in info)
    first, second = 2 * (ll[1] - ll[0]), 2 * (ll[2] - ll[1])
    test = {
        "stat_intercepts": float(first), "p_intercepts": chi2_sf(first, k - 1),
        "stat_slopes": float(second), "p_slopes": chi2_sf(second, k - 1), "df": k - 1,
        "logloss_gain_per_sample_intercepts": float((ll[1] - ll[0]) / n), "logloss_gain_per_sample_slopes": float((ll[2] - ll[1]) / n),
    }
    per = [
        {
            client: ids[i], "intercept": float(a[2, i]) if two[i] else None, "slope": float(b[2, i]) if two[i] else None,
            "observed_rate": info[i]["pos"] / info[i]["n"], "mean_predicted": info[i]["mean_predicted"], "n": info[i]["n"],
        }
        for i in range(k)
    ]
    return test, per


def _slope_sums(ids: list, params: np.ndarray, rounds: int):
    index = {c: i for i, c in enumerate(ids)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((len(ids), 7, rounds))
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                w = poisson_weights(part["s1"].to_numpy(), part["s2"].to_numpy(), rounds).astype(np.float64)
                s = part["s"].to_numpy(float)[:, None]
                y = part["y"].to_numpy(float)[:, None]
                who = part["client"].map(index).to_numpy()
                for i in np.unique(who):
                    m = who == i
                    eta = params[i, 0] + params[i, 1] * s[m]
                    mu = 1.0 / (1.0 + np.exp(-eta))
                    r = w[m] * (y[m] - mu)
                    v = w[m] * mu * (1.0 - mu)
                    acc[i] += np.stack([r.sum(0), (r * s[m]).sum(0), v.sum(0), (v * s[m]).sum(0), (v * s[m] ** 2).sum(0), w[m].sum(0), (w[m] * y[m]).sum(0)])
        yield pd.DataFrame({"i": np.arange(len(ids)), "sums": [x.ravel() for x in acc]})

    return run


def bootstrap_slopes(
    df: DataFrame, rounds: int, seed: int = 42, client: str = "client", score: str = "prob", target: str = "TARGET", key: str = "SK_ID_CURR", steps: int = 40, tol: float = 1e-7
) -> list[dict]:
    """95% interval of each client's calibration slope over Poisson resamples. Rows stay where they are: a Newton step for
    all clients and rounds is one pass that returns seven sums per client and round. ``rounds_used`` counts the resamples
    whose line converged."""
    s1, s2 = bootstrap_seeds(seed, key)
    data = materialise(
        df.filter(F.col(score).isNotNull()).select(
            F.col(client).alias("client"), F.col(target).cast("double").alias("y"), S.logit(score).alias("s"), s1.alias("s1"), s2.alias("s2")
        ),
        "slopes",
    )
    ids = sorted(r[0] for r in data.select("client").distinct().limit(MAX_CLIENTS + 1).collect())
    if len(ids) > MAX_CLIENTS:
        raise ValueError("too many institutions")
    params = np.zeros((len(ids), 2, rounds))
    params[:, 1] = 1.0
    live = np.ones((len(ids), rounds), dtype=bool)
    for _ in range(steps):
        swept = data.mapInPandas(_slope_sums(ids, params, rounds), "i int, sums array<double>")
        added = swept.select("i", F.posexplode("sums").alias("pos", "v")).groupBy("i", "pos").agg(F.sum("v").alias("v"))
        total = np.zeros((len(ids), 7 * rounds))
        for r in added.collect():
            total[r["i"], r["pos"]] = r["v"]
        g0, g1, h00, h01, h11, n, pos = (total.reshape(len(ids), 7, rounds)[:, j] for j in range(7))
        live = (pos > 0) & (pos < n)
        det = h00 * h11 - h01 * h01
        safe = np.where(np.abs(det) > 1e-300, det, 1.0)
        d0 = np.where(live, (h11 * g0 - h01 * g1) / safe, 0.0)
        d1 = np.where(live, (h00 * g1 - h01 * g0) / safe, 0.0)
        shrink = np.minimum(1.0, 5.0 / np.maximum(np.maximum(np.abs(d0), np.abs(d1)), 1e-12))
        params[:, 0] += d0 * shrink
        params[:, 1] += d1 * shrink
        if max(np.abs(d0).max(initial=0.0), np.abs(d1).max(initial=0.0)) < tol:
            break
    live &= np.maximum(np.abs(d0), np.abs(d1)) < 1e-6  # a resample without a finite line never settles; it is not used
    out = []
    for i, c in enumerate(ids):
        slopes = params[i, 1, live[i]]
        low, high = (np.percentile(slopes, [2.5, 97.5]).tolist()) if len(slopes) else (None, None)
        out.append({client: c, "slope_low": low, "slope_high": high, "rounds_used": int(live[i].sum())})
    return out


# ------------------------------------------------------------------------------------------------------------- blending
def blend_grid(df: DataFrame, a: str, b: str, grid: Sequence[float] = GRID) -> DataFrame:
    """Rows once per blend weight ``w`` with the blended logit ``score``; the grid is exploded from literals."""
    pairs = F.explode(F.array(*[F.lit(w) for w in grid]))
    wide = df.withColumns({"_la": S.logit(a), "_lb": S.logit(b)}).withColumn("w", pairs)
    return wide.withColumn("score", F.col("w") * F.col("_la") + (F.lit(1.0) - F.col("w")) * F.col("_lb")).drop("_la", "_lb")


def hybrid_name(a: str, b: str) -> str:
    return f"hyb_{a}_{b}"


def choose_blend_weights(wide: DataFrame, pairs: Sequence[tuple[str, str]], client: str = "client", prefix: str = "prob_", grid: Sequence[float] = GRID) -> DataFrame:
    """(hybrid, client, w): validation AUC decides, the smallest weight wins ties (also where a client's validation rows
    have one class and no AUC). All pairs, clients and weights together."""
    options = F.array(
        *[
            F.struct(F.lit(hybrid_name(a, b)).alias("hybrid"), S.logit(prefix + a).alias("_la"), S.logit(prefix + b).alias("_lb"))
            for a, b in pairs
        ]
    )
    # few input tasks hold many customers each, and a row becomes pairs x weights cells: rows are spread before that
    parts = 4 * wide.sparkSession.sparkContext.defaultParallelism
    val = wide.filter("split = 'val'").repartition(parts).select(client, "TARGET", F.inline(options))
    scored = val.withColumn("w", F.explode(F.array(*[F.lit(w) for w in grid]))).withColumn(
        "score", F.col("w") * F.col("_la") + (F.lit(1.0) - F.col("w")) * F.col("_lb")
    )
    aucs = auc(scored, ["hybrid", client, "w"], "score")
    return aucs.groupBy("hybrid", client).agg(F.coalesce(argmax_first("roc_auc", "w", "w"), F.min("w")).alias("w"), F.max("roc_auc").alias("val_auc"))


def add_hybrids(wide: DataFrame, pairs: Sequence[tuple[str, str]], client: str = "client", prefix: str = "prob_") -> tuple[DataFrame, DataFrame]:
    """(wide with prob_hyb_<a>_<b>, weights)."""
    weights = materialise(choose_blend_weights(wide, pairs, client, prefix), "blend-weights")
    per = weights.groupBy(client).agg(
        *[F.max(F.when(F.col("hybrid") == hybrid_name(a, b), F.col("w"))).alias(f"_w_{a}_{b}") for a, b in pairs]
    )
    out = wide.join(materialise(per, "client-weights"), client, "left")
    for a, b in pairs:
        w = F.col(f"_w_{a}_{b}")
        out = out.withColumn(prefix + hybrid_name(a, b), S.sigmoid(w * S.logit(prefix + a) + (F.lit(1.0) - w) * S.logit(prefix + b)))
    return out.drop(*[f"_w_{a}_{b}" for a, b in pairs]), weights
