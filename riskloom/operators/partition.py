"""Stratified split and institution assignment.

Random draws are two kinds: a few Dirichlet numbers per stratum from numpy on the driver, and a hash of the customer key
that fixes each customer's place in its stratum. Cutting a stratum at floor(cumulative share * size) of that order is
done by thresholds, so only customers near a cut are sorted and shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import hash_bucket, uniform
from riskloom.operators.contracts import ContractError
from riskloom.operators.ordered import assign_by_cuts, hashed_rank
from riskloom.operators.summaries import dense_counts
from riskloom.session import materialise, small_table

KEY, TARGET = "SK_ID_CURR", "TARGET"
SPLITS = ["train", "val", "test"]
MAX_GROUPS = 100_000


def small_counts(df: DataFrame, keys: Sequence[str], limit: int = MAX_GROUPS) -> list:
    """Grouped counts for the driver; more groups than ``limit`` is an error."""
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ContractError(f"more than {limit} groups in {list(keys)}")
    return rows


# ----------------------------------------------------------------------------------------------------------- the split
def largest_remainder(counts: Mapping, draws: int) -> dict:
    """Proportional allocation of ``draws`` to classes; leftovers go to the largest fractions."""
    total = sum(counts.values())
    exact = {c: n * draws / total for c, n in counts.items()}
    out = {c: math.floor(x) for c, x in exact.items()}
    rest = draws - sum(out.values())
    for c in sorted(exact, key=lambda c: (out[c] - exact[c], c))[:rest]:
        out[c] += 1
    return out


def split_quotas(counts: Mapping, test_size: float = 0.15, val_size: float = 0.15) -> dict:
    """{class: (n_test, n_val, n_train)}: the test part is taken first, validation from the rest, both rounded up."""
    n = sum(counts.values())
    kept = largest_remainder(counts, n - math.ceil(test_size * n))
    n_rest = sum(kept.values())
    train = largest_remainder(kept, n_rest - math.ceil(val_size / (1 - test_size) * n_rest))
    return {c: (counts[c] - kept[c], kept[c] - train[c], train[c]) for c in counts}


def stratified_split(
    df: DataFrame, key: str = KEY, target: str = TARGET, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42
) -> DataFrame:
    """(key, target, split) with exact per-class sizes."""
    counts = {r[target]: r["n"] for r in small_counts(df, [target])}
    cuts = [(c, i, upto) for c, (te, va, _) in split_quotas(counts, test_size, val_size).items() for i, upto in enumerate([te, te + va])]
    kind = df.schema[target].dataType.simpleString()
    cut_table = small_table(df.sparkSession, cuts, f"{target} {kind}, slot int, upto bigint")
    work = df.select(key, target).withColumn("_u", uniform(f"split{seed}", key))
    slotted = assign_by_cuts(work, target, "_u", key, cut_table, "_slot")
    label = F.when(F.col("_slot") == 0, "test").when(F.col("_slot") == 1, "val").otherwise("train")
    return slotted.select(key, target, label.alias("split"))


# ---------------------------------------------------------------------------------------------------- share partitions
def dirichlet_shares(strata: Sequence, clients: int, alpha: float, rng: np.random.Generator, floor: float = 0.0) -> dict:
    """{stratum: shares}: (1 - floor) * Dirichlet(alpha) + floor / clients."""
    return {s: ((1 - floor) * rng.dirichlet(alpha * np.ones(clients)) + floor / clients).tolist() for s in sorted(strata)}


def share_partition(df: DataFrame, stratum: str, shares: Mapping, salt: str, key: str = KEY, out: str = "client") -> DataFrame:
    """Each stratum in hash order, cut at floor(cumulative share * size)."""
    cuts = [(s, i, float(c)) for s, p in shares.items() for i, c in enumerate(np.cumsum(p)[:-1])]
    kind = df.schema[stratum].dataType.simpleString()
    cut_table = small_table(df.sparkSession, cuts, f"`{stratum}` {kind}, slot int, cum_share double")
    return assign_by_cuts(df.withColumn("_u", uniform(salt, key)), stratum, "_u", key, cut_table, out).drop("_u")


def rank_once(splits: DataFrame, stratum: str, salt: str, key: str = KEY) -> DataFrame:
    """(stratum, split, TARGET, rank) in the hash order of ``share_partition``, written for all attempts of a search."""
    columns = dict.fromkeys([key, stratum, "split", TARGET])
    work = splits.select(*columns).withColumn("_u", uniform(salt, key))
    return materialise(hashed_rank(work, [stratum], "_u", key).drop(key, "_u"), "ranked")


def cut_ranks(ranked: DataFrame, stratum: str, shares: Mapping, sizes: Mapping, out: str = "client") -> DataFrame:
    """The clients that ``share_partition`` would give, from the ranks."""
    kind = ranked.schema[stratum].dataType.simpleString()
    cuts = [(s, [math.floor(float(c) * sizes[s]) for c in np.cumsum(p)[:-1]]) for s, p in shares.items()]
    table = small_table(ranked.sparkSession, cuts, f"`{stratum}` {kind}, _cuts array<bigint>")
    return ranked.join(table, stratum).withColumn(out, F.size(F.filter("_cuts", lambda c: c < F.col("rank")))).drop("_cuts", "rank")


# ----------------------------------------------------------------------------------------------------------- territories
def fill_territories(regions: Sequence[tuple], targets: Sequence[float]) -> dict:
    """Client of each (region, customers), taken in the given order: the one that lacks most customers at that time, the
    first of equals. The lacks are kept in a heap."""
    lacks = [(-float(t), client) for client, t in enumerate(targets)]
    heapq.heapify(lacks)
    owner = {}
    for region, customers in regions:
        lack, owner[region] = lacks[0]
        heapq.heapreplace(lacks, (lack + customers, owner[region]))
    return owner


def apply_owners(df: DataFrame, region: str, owner: Mapping, out: str = "client") -> DataFrame:
    """Client of the region each customer lives in. The map has at most ``MAX_GROUPS`` rows and is a local
    relation, so the planner knows its size and broadcasts it when small."""
    kind = df.schema[region].dataType.simpleString()
    table = small_table(df.sparkSession, list(owner.items()), f"`{region}` {kind}, `{out}` int")
    return df.join(table, region, "left")


def drawn_shares(clients: int, alpha: float, rng: np.random.Generator) -> list[float]:
    """Each client's share of all customers, one Dirichlet draw."""
    return rng.dirichlet([alpha] * clients).tolist()


def draw_order(regions: Sequence, salt: str) -> list:
    """Regions in the order of a hash, the same on every run and in SQL."""
    return sorted(regions, key=lambda r: (hashlib.sha256(f"{salt}|{r}".encode()).hexdigest(), r))


def draw_territories(sizes: Mapping, shares: Sequence[float], salt: str) -> dict:
    """{region: client}: whole regions, drawn order, each to the client furthest below its share of the customers."""
    total = sum(sizes.values())
    return fill_territories([(r, sizes[r]) for r in draw_order(sizes, salt)], [q * total for q in shares])


def territory_partition(df: DataFrame, region: str, shares: Sequence[float], salt: str, out: str = "client") -> DataFrame:
    """Count the regions, draw their order, fill the clients, and give every customer its region's client."""
    sizes = {r[region]: r["n"] for r in small_counts(df, [region])}
    return apply_owners(df, region, draw_territories(sizes, shares, salt), out)


# ------------------------------------------------------------------------------------------------------- semantic hash
def semantic_hash_partition(
    df: DataFrame, columns: Sequence[str], clients: int, missing: str = "UNKNOWN", out: str = "client_id"
) -> DataFrame:
    """All customers with equal key columns go to one client: SHA-256 of the joined key, modulo the number of clients."""
    if clients < 2:
        raise ValueError("clients must be at least 2")
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise KeyError(f"missing partition columns: {absent}")
    group = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns])
    return df.withColumn("partition_group", group).withColumn(out, hash_bucket("partition_group", clients))


# ---------------------------------------------------------------------------------------------------------- constraints
def constraint_counts(assigned: DataFrame, clients: int, client: str = "client") -> DataFrame:
    """(client, split, TARGET, n) over the full product."""
    return dense_counts(assigned, {client: range(clients), "split": SPLITS, TARGET: [0, 1]})


def constraint_check(assigned: DataFrame, clients: int, min_share: float, min_cell: int, client: str = "client") -> DataFrame:
    """One row: smallest client share, smallest client x split x class count, and whether both limits hold."""
    cells = constraint_counts(assigned, clients, client)
    per = cells.groupBy(client).agg(F.sum("n").alias("size"), F.min("n").alias("cell"))
    return per.agg((F.min("size") / F.sum("size")).alias("min_share"), F.min("cell").alias("min_cell")).withColumn(
        "satisfied", (F.col("min_share") >= min_share) & (F.col("min_cell") >= min_cell)
    )


def _holds(counts: Mapping[tuple, int], clients: int, min_share: float, min_cell: int) -> bool:
    total = sum(counts.values())
    sizes = [sum(n for (k, _, _), n in counts.items() if k == c) for c in range(clients)]
    cells = [counts.get((c, s, y), 0) for c in range(clients) for s in SPLITS for y in (0, 1)]
    return min(sizes) / total >= min_share and min(cells) >= min_cell


def partition_clients(
    splits: DataFrame,
    method: str,
    clients: int,
    alpha: float,
    seed: int,
    attribute: str | None = None,
    floor: float = 0.0,
    min_share: float = 0.03,
    min_cell: int = 30,
    max_tries: int = 1000,
) -> tuple[DataFrame, dict]:
    """Draw until the constraints hold. ``splits`` has the key, TARGET, split and, unless the method is
    ``dirichlet_label``, the attribute column; the split column is never changed. Territories are decided entirely on a
    small count table. The other methods rank the customers once in a hash order; an attempt draws new shares and counts
    the ranks between their cuts."""
    rng = np.random.default_rng(seed)
    if method == "region_territory":
        cells = small_counts(splits, [attribute, "split", TARGET])
        sizes: dict = {}
        for r in cells:
            sizes[r[attribute]] = sizes.get(r[attribute], 0) + r["n"]
        for attempt in range(1, max_tries + 1):
            target = drawn_shares(clients, alpha, rng)
            owner = draw_territories(sizes, target, f"{method}{seed}-{attempt}")
            counts: dict = {}
            for r in cells:
                at = (owner[r[attribute]], r["split"], r[TARGET])
                counts[at] = counts.get(at, 0) + r["n"]
            if _holds(counts, clients, min_share, min_cell):
                return apply_owners(splits, attribute, owner), {"attempts": attempt, "target_share": target, "owner": owner}
    elif method in ("dirichlet_label", "segment_mix"):
        stratum = TARGET if method == "dirichlet_label" else attribute
        sizes = {r[stratum]: r["n"] for r in small_counts(splits, [stratum])}
        salt = f"{method}{seed}"
        ranked = rank_once(splits, stratum, salt)
        for attempt in range(1, max_tries + 1):
            shares = dirichlet_shares(sizes, clients, alpha, rng, floor if method == "segment_mix" else 0.0)
            rows = constraint_counts(cut_ranks(ranked, stratum, shares, sizes), clients).collect()
            if _holds({(r["client"], r["split"], r[TARGET]): r["n"] for r in rows}, clients, min_share, min_cell):
                return share_partition(splits, stratum, shares, salt), {"attempts": attempt, "shares": shares}
    else:
        raise ValueError(f"unknown partition method: {method}")
    raise RuntimeError("no assignment meets the constraints; relax them or raise alpha")
