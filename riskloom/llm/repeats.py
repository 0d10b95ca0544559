"""Removal of byte strings that occur more than once in the corpus, by suffix arrays of content shards.

A window is ``LENGTH`` consecutive bytes. Its anchor is the least hash among its ``ANCHOR``-byte strings (the leftmost of
equals), so equal windows have equal anchors wherever they lie. Neighbouring windows of one anchor form a segment. One pass
over the texts writes a row per segment: text digest, place, anchor, digest of its bytes. Anchors that occur once are
dropped by counts. Segments of equal bytes become one with a count: all windows of a segment that occurs twice are
repeated, and a thousand copies of a text come down to one segment each. What is left are anchors with several different
segments; only their bytes are fetched.

Anchors are dealt to shards, the bytes of a shard are laid out one segment after another, and their suffix array is built
by induced sorting: suffixes are classed, the leftmost smaller ones' substrings sorted by one round of induction and
named, the string of names sorted recursively unless all differ, and the array induced from their order. Rounds of
induction go bucket by bucket on whole arrays. A string of too many names for that (the usual case after one round) is
sorted by doubling prefixes instead of another round: one by one, induction took most of the time. Permuted common prefixes follow from the places
where the preceding bytes differ; a window is repeated if it shares ``LENGTH`` bytes with a neighbour in the array.

An anchor of more than ``HOT_SEGMENTS`` different segments is not put into one shard: digests of its windows are counted
by Spark, with map-side sums, which gives the same result. So no task holds an unbounded group.

Defined results: null is the empty text; texts shorter than a window lose nothing; repeated rows and copies lose everything
(each window starts in the other one too); the kept columns come back in the struct ``row``, so no name can clash; an empty
table gives no rows. Kept bytes need not be valid UTF-8. Long texts are read in overlapping pieces of ``SLICE_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import BASE, BYTE_VALUE, _power, bounded, materialise, mix, prepare, slices, text_array

LENGTH = 400
ANCHOR = 64
SLICE_BYTES = 1 << 20
#: Bytes laid out for one suffix array, but always whole anchors.
SHARD_BYTES = 1 << 20
HOT_SEGMENTS = 8000
#: Symbols up to which the string of names is sorted by another round of induction: each symbol costs a step.
FEW_SYMBOLS = 1000
#: Symbols of a laid out shard: the end, a separator, and the bytes.
END, SEPARATOR, FIRST_BYTE = 0, 1, 2


# ------------------------------------------------------------------------------------------------ segments of windows
def window_anchors(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: place of its anchor; and the hash of each anchor-sized string."""
    n = len(data)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[data] * _power("up", BASE, n), dtype=np.uint64)])
    hashes = mix((total[anchor:] - total[:-anchor]) * _power("down", pow(BASE, -1, 1 << 64), n - anchor + 1))
    # the upper half decides, then the place: the same choice in any text
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    wide, width = length - anchor + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def segments_of(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start in the data, number of starts, anchor hash) of texts laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    places, hashes = window_anchors(data, length, anchor)
    starts = np.arange(len(places))
    text = np.searchsorted(ends, starts, side="right")
    inside = np.flatnonzero(starts + length <= ends[np.minimum(text, len(ends) - 1)])
    text, place = text[inside], places[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    return text[at], inside[at], np.diff(np.append(at, len(inside))), hashes[place[at]]


def pieces_of(texts: pa.Array, most: int, overlap: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """(bytes, first row, ends of the rows in the bytes, offset in the row): whole texts, a long one in overlapping pieces."""
    for a, b in slices(texts, most):
        part = texts.slice(a, b - a)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + b - a + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if len(data) <= most + overlap:
            yield data, a, offsets[1:] - offsets[0], 0
            continue
        for c in range(0, len(data) - overlap, most):
            piece = data[c : c + most + overlap]
            yield piece, a, np.array([len(piece)]), c


SEGMENT = "t binary, doc bigint, at bigint, starts int, key bigint, seg binary"


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def segments(documents: DataFrame, length: int, anchor: int) -> DataFrame:
    """A row per segment of (doc, t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, digests = batch.column(0), batch.column(1)
            for data, row, ends, offset in pieces_of(text_array(batch.column(2)), SLICE_BYTES, length - 1):
                text, at, starts, key = segments_of(data, ends, length, anchor)
                whole = data.tobytes()
                seg = [hashlib.blake2b(whole[a : a + n + length - 1], digest_size=16).digest() for a, n in zip(at.tolist(), starts.tolist(), strict=True)]
                begins = np.concatenate([[0], ends[:-1]])
                rows = pa.array(row + text)
                yield pa.RecordBatch.from_arrays(
                    [digests.take(rows), docs.take(rows), pa.array(offset + at - begins[text]), pa.array(starts.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(seg, pa.binary())],
                    ["t", "doc", "at", "starts", "key", "seg"],
                )

    return documents.mapInArrow(bounded(run), SEGMENT)


# ------------------------------------------------------------------------------------------------ suffix arrays
def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the least and occurs once."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
        out[:-1] = text[:-1] < text[1:]
        out[:-1] = out[np.minimum.accumulate(differs[::-1])[::-1]]
    return out


def induce_by_bucket(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array from the order of the leftmost smaller suffixes, a bucket at a time."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=symbols))
    begins = ends - np.bincount(text, minlength=symbols)
    out = np.zeros(n, np.int32)
    own = lms[np.argsort(text[lms], kind="stable")]
    cuts = np.searchsorted(text[own], np.arange(symbols + 1))

    def place(found: np.ndarray, fill: np.ndarray, step: int) -> None:
        """Put positions into the buckets of their symbols, in order, upwards or downwards."""
        symbol = text[found]
        by = np.argsort(symbol, kind="stable")
        found, symbol = found[by], symbol[by]
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        sizes = np.diff(np.append(first, len(found)))
        within = np.arange(len(found)) - np.repeat(first, sizes)
        out[fill[symbol] + (within if step > 0 else -1 - within)] = found
        fill[symbol[first]] += step * sizes

    fill = begins.copy()
    for c in range(symbols):
        done = begins[c]
        while done < fill[c]:
            before = out[done : fill[c]] - 1
            done = fill[c]
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                place(before, fill, 1)
        before = own[cuts[c] : cuts[c + 1]] - 1
        before = before[before >= 0]
        if len(before):
            place(before, fill, 1)
    larger_end, fill = fill, ends.copy()
    for c in range(symbols - 1, -1, -1):
        done = ends[c]
        while done > fill[c]:
            before = out[fill[c] : done][::-1] - 1
            done = fill[c]
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                place(before, fill, -1)
        before = out[begins[c] : larger_end[c]][::-1] - 1
        before = before[before >= 0]
        before = before[smaller[before]]
        if len(before):
            place(before, fill, -1)
    out[0] = n - 1
    return out


def order_of_names(text: np.ndarray) -> np.ndarray:
    """The suffix array of many symbols: the compared prefix doubles, and only suffixes still alike are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    slots, rank, width = np.arange(n), np.zeros(n, np.int64), 1
    found = text[order].astype(np.int64)
    while True:
        fresh = np.append(True, found[1:] != found[:-1])
        rank[order[slots]] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        if not len(slots):
            return order
        mine = order[slots]
        # the last symbol occurs once, so suffixes that are still alike do not reach it
        key = rank[mine] * n + rank[mine + width]
        by = np.argsort(key, kind="stable")
        order[slots], found = mine[by], key[by]
        width *= 2


def names_of(text: np.ndarray, order: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Number of each leftmost smaller substring in ``order``; equal ones, which are neighbours there, share it."""
    length = np.zeros(len(text), np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    going, offset = np.flatnonzero(same), 0
    while len(going):
        equal = text[a[going] + offset] == text[b[going] + offset]
        same[going[~equal]] = False
        going, offset = going[equal], offset + 1
        going = going[length[a[going]] > offset]
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Of symbols 0 to ``symbols - 1`` that end with the only 0."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    smaller = smaller_than_next(text)
    leftmost = np.zeros(len(text), bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(leftmost)
    order = induce_by_bucket(text, smaller, lms, symbols)
    order = order[leftmost[order]]
    names = names_of(text, order, lms)
    if names[-1] + 1 < len(lms):
        name = np.zeros(len(text), np.int32)
        name[order] = names
        few = names[-1] < FEW_SYMBOLS
        order = lms[suffix_array(name[lms], int(names[-1]) + 1) if few else order_of_names(name[lms])]
    return induce_by_bucket(text, smaller, order, symbols)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position, the symbols it has in common with the suffix before it in the array (0 for the first one)."""
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[array[1:]] = array[:-1]
    positions = np.arange(n, dtype=np.int32)
    has = before >= 0
    # where the preceding symbols are equal, the value is one less than that of the position before
    own = ~has | (positions == 0) | (before <= 0) | (text[positions - 1] != text[before - 1])
    # four symbols at a time; beyond the end, which is the only one of its kind, nothing can agree
    padded = np.concatenate([text.astype(np.uint64), np.zeros(4, np.uint64)])
    four = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    at = np.flatnonzero(own & has)
    length = np.zeros(n, np.int32)
    going = at
    while len(going):
        common = length[going]
        equal = four[going + common] == four[before[going] + common]
        going = going[equal]
        length[going] += 4
    for _ in range(3):
        common = length[at]
        equal = text[at + common] == text[before[at] + common]
        at = at[equal]
        length[at] += 1
    source = np.maximum.accumulate(np.where(own, positions, 0))
    return length[source] - (positions - source)


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts, per part, of windows that also start elsewhere in the parts."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(FIRST_BYTE)
    begins = np.cumsum(sizes + 1) - sizes - 1
    joined[begins + sizes] = SEPARATOR
    text = np.append(joined, np.uint16(END))
    array = suffix_array(text, 256 + FIRST_BYTE)
    enough = permuted_common_prefixes(text, array)[array] >= length
    repeated = np.zeros(len(text), bool)
    repeated[array] = enough | np.append(enough[1:], False)
    return [np.flatnonzero(repeated[b : b + s - length + 1]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Starts as ranges [lo, hi)."""
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(starts, cuts) if len(x)]


def in_shards(length: int):
    """Over rows (key, seg, n, piece) sorted by key and segment: rows (key, seg, lo, hi) of repeated starts."""

    def work(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (key, seg, n, _), starts in zip(held, repeated_starts([x[3] for x in held], length), strict=True):
            if n == 1:  # else all of it is repeated anyway
                rows += [(key, seg, lo, hi) for lo, hi in spans_of(starts)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["key", "seg", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] == last:  # the same piece, from a repeated row
                    continue
                if size > SHARD_BYTES and row[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[3])
        if held:
            yield work(held)

    return run


# ------------------------------------------------------------------------------------------------ the operator
def marks(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """``(places, found)``: (t, at, key, seg) of segments with a repeated anchor; (key, seg, lo, hi) of repeated starts."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc"), text_digest(F.col("text")).alias("t"), "text")
    each = materialise(segments(texts, length, anchor), "segments")
    often = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"))
    often = materialise(often, "often")  # written, so that the join has both sides shuffled and can split a hot anchor
    # the texts of a hot anchor are many: dealt by text too, they are no one task's
    rows = each.join(often, F.col("key") == F.col("k")).drop("k").repartition("key", "seg", "t")
    places = rows.groupBy("key", "seg", "t", "at", "starts").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"))
    places = materialise(places, "places")

    kinds = places.groupBy("key", "seg").agg(F.sum("copies").alias("n"), F.min(F.struct("t", "doc", "at", "starts")).alias("one"))
    kinds = materialise(kinds, "kinds")
    twice = kinds.where("n > 1").select("key", "seg", F.lit(0).alias("lo"), F.col("one.starts").alias("hi"))
    several = kinds.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("k"), "m")
    several = materialise(several, "several")
    open_ = kinds.join(several, F.col("key") == F.col("k")).select("key", "seg", "n", "m", "one.*")

    wanted = open_.groupBy(F.col("t").alias("u"), F.col("doc").alias("d")).agg(F.collect_list(F.struct("at", "starts", "key", "seg", "n", "m")).alias("parts"))  # of one text
    held = texts.join(wanted, (F.col("t") == F.col("u")) & F.col("doc").eqNullSafe(F.col("d"))).select(F.col("text").cast("binary").alias("raw"), F.explode("parts").alias("p"))
    piece = F.substring(F.col("raw"), (F.col("p.at") + 1).cast("int"), F.col("p.starts") + (length - 1))
    pieces = materialise(held.select("p.key", "p.seg", "p.n", "p.m", "p.starts", piece.alias("piece")), "pieces")

    cool = pieces.where(F.col("m") <= hot).select("key", "seg", "n", "piece")
    in_array = cool.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(bounded(in_shards(length)), "key bigint, seg binary, lo int, hi int")

    # hot anchors: digests of their windows are counted; pieces of repeated rows count once
    windows = pieces.where(F.col("m") > hot).select("key", "seg", "n", "piece", F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("lo"))
    windows = windows.select("key", "seg", "n", "lo", F.unhex(F.md5(F.substring("piece", F.col("lo") + 1, F.lit(length)))).alias("h"))
    known = windows.groupBy("h").agg(F.min(F.struct("seg", "lo")).alias("a"), F.max(F.struct("seg", "lo")).alias("b")).where("a != b").select(F.col("h").alias("g"))
    counted = windows.where("n = 1").join(known, F.col("h") == F.col("g")).select("key", "seg", "lo", (F.col("lo") + 1).alias("hi"))
    found = materialise(twice.unionByName(in_array).unionByName(counted), "marks")
    return places, found


def dedup(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(row, n_bytes, spans, kept): removed spans (start, stop) in bytes, and the remaining bytes."""
    prepare(documents.sparkSession)
    places, found = marks(documents, length, anchor, hot)
    found = found.select(F.col("key").alias("k"), F.col("seg").alias("s"), "lo", "hi")
    ranges = places.join(found, (F.col("key") == F.col("k")) & (F.col("seg") == F.col("s")))
    ranges = ranges.select(F.col("t").alias("u"), F.struct((F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + (length - 1)).alias("stop")).alias("span"))
    spans = materialise(ranges.groupBy("u").agg(F.collect_list("span").alias("spans")), "spans")  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes, removed, kept = [], [], []
            for text, listed in zip(texts, batch.column(2).to_pylist(), strict=True):
                raw = text.as_py() or b""
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["stop"]) for x in listed or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                sizes.append(len(raw))
                removed.append([{"start": a, "stop": b} for a, b in merged])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in merged)], [*(a for a, _ in merged), len(raw)], strict=True)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["row", "n_bytes", "spans", "kept"])

    rows = documents.select(F.struct(*keep).alias("row"), text_digest(F.col("text")).alias("t"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(spans, F.col("t") == F.col("u"), "left").select("row", "text", "spans")
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([rows.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", span_type), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(bounded(run), schema)
