"""Self-join of documents on the Jaccard similarity of their word shingles, with Bayesian pruning of candidates.

Texts with equal shingle sets become one representative. A representative has ``BANDS * ROWS`` MinHash values, of which
one mixed byte each is kept. Representatives that agree in all values of a band meet in a bucket; a pair is looked at only
in the first band it shares. Its values are compared ``STEP`` at a time: after m matches of n, with a uniform prior, the
posterior probability of a similarity of at least the threshold is known, and below ``TOLERANCE`` the pair is dropped.
What is left is verified exactly on the shingles of the texts themselves.

Hot buckets are dealt in square blocks of some ``BLOCK`` by ``BLOCK`` members, so no task holds a whole bucket, and a block
gives rows per member, not per pair: first the members with pairs to verify, then, beside the texts of these, each
member's number of links and its least linked member, which spans the block's links. So rows grow with members and blocks
while no link is lost: a pair of similarity 0.8 shares none of 32 bands of 5 values with probability 3e-6, and is pruned
with about ``TOLERANCE``.

Output per document: class id (least doc_id of its connected component of links), number of linked documents, size of the
class, and, as ids may be shared, the class's key and the checksum of the text. Copies are counted, not expanded.

Defined results: a text of fewer than five words, but not none, is one shingle; texts without words are linked only to
equal texts; a null text is linked to nothing (class of its own id); repeated rows count as copies; null ids count in
n_links but not for the class id, which is null if a class has null ids only; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Words, bounded, materialise, slices, text_array, word_shingles
from riskloom.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256

_rng = np.random.RandomState(20240229)
FACTORS = (_rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
TERMS = _rng.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of each MinHash value, a row per set; empty sets get zeros."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint8)
    used = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(used):  # as many sets as stay in the processor's cache
        part, size = [], 0
        while at < len(used) and (not part or size + len(sets[used[at]]) <= 1 << 15):
            part.append(used[at])
            size += len(sets[used[at]])
            at += 1
        values = np.concatenate([sets[i] for i in part])
        low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *(len(sets[i]) for i in part[:-1])])
        work = np.empty_like(low)
        least = np.empty((BANDS * ROWS, len(part)), np.uint32)
        for k in range(BANDS * ROWS):
            np.multiply(low, FACTORS[k], out=work)
            np.add(work, TERMS[k], out=work)
            least[k] = np.minimum.reduceat(work, starts)
        least ^= least >> np.uint32(15)
        out[part] = ((least * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).T
    return out


def sketch(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, sig, text_md5): digest of the shingle set (of the text if it has no words; null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            null = pc.is_null(batch.column(1)).to_pylist()
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                sets = word_shingles(Words(part), SHINGLE_WORDS)
                sig = signatures(sets)
                plain = part.to_pylist()
                digests = [
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None if n else hashlib.blake2b(b"text" + t.encode(), digest_size=16).digest()
                    for s, t, n in zip(sets, plain, null[a:b], strict=True)
                ]
                rows = [x.tobytes() if len(s) else None for x, s in zip(sig, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(rows, pa.binary()), batch.column(2).slice(a, b - a)], ["doc_id", "digest", "sig", "text_md5"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", F.md5("text").alias("text_md5")).mapInArrow(bounded(run), f"doc_id {kind}, digest binary, sig binary, text_md5 string")


def least_matches(threshold: float = SIMILARITY, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = 0, STEP, 2 STEP, ... compared values: the fewest matches with which a pair goes on."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    p = grid + (1 - grid) / 256  # bytes of different values agree by chance
    out = []
    for n in range(0, BANDS * ROWS + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-np.minimum(p, 1 - 1e-12))
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, grid >= threshold].sum(axis=1) / weight.sum(axis=1)
        out.append(int(np.argmax(posterior >= tolerance)))
    return np.array(out)


KEYS = ["band", "bucket", "lo", "hi"]


class Groups:
    """Members of whole blocks, in order of their keys: group number, block of the member, band and signature."""

    def __init__(self, table: pa.Table):
        self.table = table
        keys = [table[k].to_numpy() for k in KEYS]
        fresh = np.zeros(len(table), bool)
        fresh[0] = True
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
        self.start = np.flatnonzero(fresh)
        self.number = np.cumsum(fresh) - 1
        self.band, self.cross, self.block = keys[0], keys[2] != keys[3], table["block"].to_numpy()
        self.sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(table), BANDS * ROWS)

    def pairs(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j) of pairs in their first common band that survive all comparisons."""
        n, found = len(self.number), []
        largest = int(np.diff(np.append(self.start, n)).max())
        rows = np.arange(n)
        for d in range(1, largest):
            rows = rows[(rows + d < n)]
            rows = rows[self.number[rows] == self.number[rows + d]]  # a row without a partner at d has none at d + 1
            i = rows
            i = i[~self.cross[i] | (self.block[i] != self.block[i + d])]
            matched = np.zeros(len(i), np.int64)
            for s in range(BANDS * ROWS // STEP):
                if not len(i):
                    break
                part = slice(s * STEP, (s + 1) * STEP)
                matched = matched + (self.sig[i, part] == self.sig[i + d, part]).sum(axis=1)
                going = matched >= least[s + 1]
                i, matched = i[going], matched[going]
            if len(i):
                same = (self.sig[i] == self.sig[i + d]).reshape(len(i), BANDS, ROWS).all(axis=2)
                i = i[same.any(axis=1) & (same.argmax(axis=1) == self.band[i])]
                found.append((i, i + d))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def by_group(work: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hand over rows sorted by KEYS so that no block is cut: the last block of a batch waits for the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            last = [batch.column(k)[len(batch) - 1].as_py() for k in KEYS]
            cut = len(batch)
            while cut and [batch.column(k)[cut - 1].as_py() for k in KEYS] == last:
                cut -= 1
            ahead = [waiting[0].column(k)[0].as_py() for k in KEYS] if waiting else None
            if cut == 0 and (ahead is None or ahead == last):
                waiting.append(batch)
                continue
            whole = pa.Table.from_batches([*waiting, batch.slice(0, cut)] if cut else waiting)
            yield from work(whole).to_batches()
            waiting = [batch.slice(cut)]
        if waiting:
            yield from work(pa.Table.from_batches(waiting)).to_batches()

    return run


def survivors(table: pa.Table) -> pa.Table:
    """The members that have a pair to verify."""
    i, j = Groups(table).pairs(least_matches())
    return table.take(pa.array(np.unique(np.concatenate([i, j]))))


LINKS = pa.schema([("digest", pa.binary()), ("root", pa.binary()), ("linked", pa.int64())])


def verified(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        # a text of an id that several rows share may be another one; a repeated row is there once
        texts = text_array(table["text"])
        sets = [s for a, b in slices(texts) for s in word_shingles(Words(texts.slice(a, b - a)), SHINGLE_WORDS)]
        digests = table["digest"].to_pylist()
        seen: set[tuple] = set()
        keep = []
        for r, key in enumerate(zip(*(table[k].to_pylist() for k in KEYS), digests, strict=True)):
            if key not in seen and hashlib.blake2b(sets[r].tobytes(), digest_size=16).digest() == digests[r]:
                seen.add(key)
                keep.append(r)
        if not keep:
            return LINKS.empty_table()
        sets, digests = [sets[r] for r in keep], [digests[r] for r in keep]
        table = table.take(pa.array(keep))
        i, j = Groups(table).pairs(least_matches())
        copies = table["n_docs"].to_numpy()
        linked = np.zeros(len(keep), np.int64)
        root = list(range(len(keep)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                continue
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            if common >= threshold * (len(x) + len(y) - common) - 1e-9:
                linked[a] += copies[b]
                linked[b] += copies[a]
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        rows = np.flatnonzero(linked)
        return pa.table([pa.array([digests[r] for r in rows], pa.binary()), pa.array([digests[top(r)] for r in rows], pa.binary()), pa.array(linked[rows])], schema=LINKS)

    return work


def join(documents: DataFrame, threshold: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, class_size, class_key, text_md5) for each document; the key is null for a null text."""
    sketches = materialise(sketch(documents), "sketches")
    sets = sketches.where(F.col("digest").isNotNull())
    reps = materialise(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), F.min("sig").alias("sig")), "representatives")
    cut = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * ROWS + 1, F.lit(ROWS))))
    bands = reps.where(F.col("sig").isNotNull()).select("digest", F.posexplode(cut).alias("band", "bucket"))
    shared = bands.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.select(F.col("band").alias("b"), F.col("bucket").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = bands.join(shared, (F.col("band") == F.col("b")) & (F.col("bucket") == F.col("k")))
    members = members.select("digest", "band", "bucket", "blocks", F.expr("cast(pmod(xxhash64(digest), blocks) as int)").alias("block"))
    dealt = members.select("digest", "band", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        F.col("digest").alias("d"), "band", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block"
    )
    dealt = dealt.join(reps, F.col("d") == F.col("digest")).select(*KEYS, "block", "digest", "rep", "n_docs", "sig")
    grouped = dealt.repartition(*KEYS).sortWithinPartitions(*KEYS, "digest")
    to_verify = materialise(grouped.mapInArrow(bounded(by_group(survivors)), grouped.schema), "survivors")

    texts = documents.select(F.col("doc_id").alias("_id"), "text").where("text is not null")
    beside = to_verify.join(texts, F.col("rep").eqNullSafe(F.col("_id"))).select(*KEYS, "block", "digest", "n_docs", "sig", "text")
    beside = beside.repartition(*KEYS).sortWithinPartitions(*KEYS, "digest")
    links = materialise(beside.mapInArrow(bounded(by_group(verified(threshold))), "digest binary, root binary, linked bigint"), "links")

    near = links.groupBy("digest").agg(F.sum("linked").alias("linked"))
    of = components(links, "digest", "root")
    each = reps.select("digest", "rep", "n_docs").join(near.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left").drop("d")
    each = each.join(of, F.col("digest") == F.col("node"), "left").select("digest", "rep", "n_docs", "linked", F.coalesce("root", "digest").alias("root"))
    each = materialise(each, "members")
    classes = each.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n_docs").alias("class_size"))
    each = each.join(classes.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("digest").alias("d"), F.col("root").alias("class_key"), "class_id", "class_size", (F.coalesce("linked", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    out = sketches.select("doc_id", "digest", "text_md5").join(each, F.col("digest") == F.col("d"), "left")
    alone = F.col("digest").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "class_key", "text_md5",
    )
