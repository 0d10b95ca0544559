"""Toxicity by compression distance between two zstandard dictionaries.

Two dictionaries are trained: one on ordinary text, one on text of toxic documents that ordinary documents hardly ever
use (words and beginnings of words whose document frequency differs by a likelihood-ratio test, near copies counting once). The toxic
dictionary is the ordinary one followed by the toxic segments, the ordinary one is padded to equal length, so the two
compress ordinary text alike and differ only where toxic segments help. A window is one word between blanks, written
``REPEAT`` times: below some 25 bytes zstandard stores a block as it is and lengths would not differ. Its distance is
the length under the ordinary less the length under the toxic dictionary, the smallest of ``PAIRS`` such pairs.

A document's features are the shares and the counts of windows whose distance reaches each of the ``CUTS``; a logistic
regression turns them into a calibrated probability. It is fitted on labelled documents, each half of them measured with
dictionaries of the other half; the dictionaries that score are then trained on all of them.

Bounds, all of labelled rows for fitting: of each class the first rows in order of a hash of the id, at most ``FIT_ROWS``
and as many as have ``CLASS_CHARS`` characters together (one at least; no row is passed over for its length); the ordinary
dictionary is trained on ``SAMPLE_LINES`` lines of these. Rows weigh as many as they stand for, the labelled rows of their
class over those taken, so the probability and its threshold mean the same at every size. Every window of every text is
scored.

Defined results: null and empty texts have no window and get the probability of a document without hits; null labels are
unlabelled; a document labelled twice counts as toxic if any label says so; without both classes the score is the share of
toxic labels (0 without labels); repeated rows are scored each; extra columns pass through unread, but one named like a result is
replaced by it.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import bounded, materialise, text_array, without

WORD = re.compile(r"[^\W\d_]+")
REPEAT = 4
LEVEL = 3
CUTS = (3, 4, 5, 6)
BEGINNINGS = (4, 5, 7)
SAMPLE_LINES = 40_000
PAIRS = 2
FIT_ROWS = 3000
CLASS_CHARS = 12_000_000
ORDINARY_BYTES = 60_000
TOXIC_BYTES = 3_000
KEEP = 150_000
THRESHOLD = 0.7


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Distance:
    """Distances of words in one process; known words are kept in two bounded generations.

    A dictionary's hash table holds one place per slot, so a word may lose its match by chance. A distance that reaches the
    least cut is therefore held against the other pairs of dictionaries, and the smallest counts."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        self.pairs = [(self._of(ordinary), self._of(toxic)) for ordinary, toxic in pairs]
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @staticmethod
    def _of(content: bytes) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, word: str) -> int:
        window = (f" {word} " * REPEAT).encode("utf-8", "replace")
        least = 1 << 14
        for ordinary, toxic in self.pairs:
            least = min(least, len(ordinary.compress(window)) - len(toxic.compress(window)))
            if least < CUTS[0]:
                break
        return least

    def __call__(self, listed: list[str]) -> np.ndarray:
        new = self.new
        for w in listed:
            if w not in new:
                known = self.old.get(w)
                new[w] = self.of(w) if known is None else known
        out = np.fromiter((new[w] for w in listed), np.int16, len(listed))
        if len(new) > KEEP:
            self.old, self.new = new, {}
        return out


def features(distance: Distance, text: str) -> list[float]:
    got = distance(words(text))
    hits = [int((got >= c).sum()) for c in CUTS]
    n = max(len(got), 1)
    return [*(math.sqrt(h / n) for h in hits), *(math.log1p(h) for h in hits)]


def one_of_copies(texts: list[str]) -> list[str]:
    """One text per least checksum of three consecutive words, so near copies count about once."""
    seen: dict[int, str] = {}
    for t in texts:
        w = words(t)
        seen.setdefault(min((zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 2))), default=0), t)
    return list(seen.values())


def likelihood_ratio(x: int, y: int, nx: int, ny: int) -> float:
    part = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
    p = (x + y) / (nx + ny)
    return 2 * (part(x, nx, x / nx) + part(y, ny, y / ny) - part(x, nx, p) - part(y, ny, p))


def _trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; the end of the samples themselves where there are too few to train on."""
    try:
        content = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(samples)
    return content[-size * 29 // 30 :]


def units(text: str) -> set[str]:
    """Words, with the blank that ends them, and their beginnings of a few lengths."""
    found = set(words(text))
    return {f"{w} " for w in found} | {w[:k] for w in found for k in BEGINNINGS if len(w) > k}


def marked_units(toxic: list[str], ordinary: list[str]) -> dict[str, int]:
    """Units that toxic documents use significantly more often, with their document frequency there."""
    n, m = max(len(toxic), 1), max(len(ordinary), 1)
    mine = Counter(u for t in toxic for u in units(t))
    often = {u: k for u, k in mine.items() if k >= max(4, n // 200)} or dict(mine)
    other = Counter(u for t in ordinary for u in units(t) if u in often)
    found = {u: k for u, k in sorted(often.items()) if k / n > 3 * other[u] / m and likelihood_ratio(k, other[u], n, m) > 24}
    return found or {u: k for u, k in sorted(often.items()) if not other[u]}  # small fixtures: what only toxic documents have


def train(toxic: list[str], ordinary: list[str]) -> list[tuple[bytes, bytes]]:
    """``PAIRS`` pairs of ``(ordinary, toxic)`` dictionary contents of equal length, from other samples in another order."""
    draw = random.Random(1)
    toxic, ordinary = one_of_copies(toxic), one_of_copies(ordinary)
    marked = marked_units(toxic, ordinary)
    plain = []
    for t in ordinary:
        w = words(t)
        plain += [f" {' '.join(w[i : i + 8])} ".encode("utf-8", "replace") for i in range(0, len(w), 8)]
    used = [w for t in toxic for w in words(t) if f"{w} " in marked or any(w[:k] in marked for k in BEGINNINGS)]
    pairs = []
    for n in range(PAIRS):
        base = _trained(ORDINARY_BYTES, draw.sample(plain, min(len(plain), SAMPLE_LINES))) or b" "
        draw.shuffle(used)
        lines = [f" {' '.join(used[i : i + 8])} ".encode("utf-8", "replace") for i in range(0, len(used), 8)]
        extra = _trained(TOXIC_BYTES, lines) if lines else b""
        filler = (base * (len(extra) // len(base) + 1))[: len(extra)]
        pairs.append((filler + base, extra + base) if n % 2 else (base + filler, base + extra))
    return pairs


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps until they no longer move; ``weight`` is what a row counts."""
    x = np.hstack([x, np.ones((len(x), 1))])
    n = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (n * (y - p)) - penalty * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            return w
    raise RuntimeError("the calibration did not converge")


def sample(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = FIT_ROWS, chars: int = CLASS_CHARS) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """(doc_id, toxic, text) of the first documents of each class in order of a hash of the id, at most ``rows`` of them
    and ``chars`` characters a class (one at least); and how many documents of each class there are to learn from."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    sizes = documents.where(learn & F.col("text").isNotNull()).select("doc_id", F.length("text").alias("n")).join(marked, F.col("doc_id") == F.col("_id"))
    sizes = materialise(sizes.groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"), F.max("n").alias("n")), "labelled")
    there = {r["_toxic"]: r["count"] for r in sizes.groupBy("_toxic").count().collect()}  # two rows
    chosen: dict[int, int] = {}
    for label in there:
        left = chars
        for r in sizes.where(F.col("_toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect():
            left -= r["n"]
            if left < 0 and label in chosen.values():
                break
            chosen[r["doc_id"]] = label
    if not chosen:
        return [], there
    spark = documents.sparkSession
    ids = F.broadcast(spark.createDataFrame(list(chosen.items()), "id bigint, toxic int"))  # at most 2 * rows
    got = documents.where(learn & F.col("text").isNotNull()).join(ids, F.col("doc_id") == F.col("id")).select("doc_id", ids["toxic"], "text").dropDuplicates(["doc_id"]).collect()
    return sorted((r[0], r[1], r[2]) for r in got), there


def fit(documents: DataFrame, labels: DataFrame, learn: Column, **bounds) -> dict:
    rows, there = sample(documents, labels, learn, **bounds)
    y = np.array([r[1] for r in rows], float)
    if len(there) < 2:
        return {"prior": float(max(there, default=0))}
    counts = {c: there[c] / (y == c).sum() for c in (0, 1)}
    half = [zlib.crc32(f"fit{r[0]}".encode()) % 2 for r in rows]
    groups = [[r for r, h in zip(rows, half, strict=True) if h == side] for side in (0, 1)]
    if any(len({r[1] for r in g}) < 2 for g in groups):
        groups = [rows, rows]
    by_label = lambda group: ([r[2] for r in group if r[1]], [r[2] for r in group if not r[1]])
    folds = [train(*by_label(g)) for g in groups]
    spark = documents.sparkSession

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [Distance(f) for f in folds]
        for batch in batches:
            got = [features(distances[f], t) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], ["toxic", "x"])

    # each half is measured with the dictionaries of the other one
    marks = F.broadcast(spark.createDataFrame([(r[0], r[1], 1 - side) for side in (0, 1) for r in groups[side]], "id bigint, toxic int, fold int"))  # at most 4 * rows
    held = documents.where(learn).join(marks, F.col("doc_id") == F.col("id")).select(marks["toxic"], "fold", F.coalesce("text", F.lit("")).alias("text"))
    got = held.mapInArrow(bounded(measure), "toxic int, x array<double>").collect()  # eight numbers a row
    x = np.array([r["x"] for r in got])
    toxic = np.array([r["toxic"] for r in got], float)
    return {"pairs": train(*by_label(rows)), "weights": logistic(x, toxic, np.where(toxic == 1, counts[1], counts[0]))}


def score(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents with score (probability of being toxic) and predicted (0 or 1)."""
    documents = without(documents, ["score", "predicted"])
    place = documents.columns.index("text")
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        distance = Distance(known["pairs"]) if "weights" in known else None
        for batch in batches:
            if distance is None:
                p = np.full(len(batch), known["prior"])
            else:
                x = np.array([features(distance, t) for t in text_array(batch.column(place)).to_pylist()]).reshape(len(batch), -1)
                w = known["weights"]
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return documents.mapInArrow(bounded(run), schema)
