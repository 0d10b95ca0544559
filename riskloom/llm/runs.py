"""Periodic runs of words, by descending-LCP Kruskal over the suffixes of each text.

A run is a stretch with a smallest period q, at least ``MIN_WORDS`` and ``MIN_EXPONENT * q`` words long, that no neighbouring
word extends. Suffixes of a text are sorted by doubling the compared prefix, only classes of several suffixes being sorted
again, and the common prefix of neighbours in that order is read off the classes of each doubling. The neighbours are the
edges of a tree: taken by decreasing common prefix, each unites two classes of a union-find. A class holds its positions in
order, the smaller class goes into the larger, and two positions that become neighbours have exactly that many words in
common. If their distance d is at most that, the stretch from the first one has period d and ends where the common words
end; it is a run if the word before breaks the period. Of a run with at least three periods its first word and the one a
period later do become neighbours: a position between them would give a smaller period. Edges of fewer common words than
the shortest run leaves beyond its period are not needed.

Texts are independent: tasks take whole texts in slices, and no row is shuffled. Classes never hold positions of two texts.

Defined results: null and empty texts have no words, no runs, and collapse to the empty text; repeated rows are done each;
the kept columns come back in the struct ``row``, so no name can clash; an empty table gives no rows. A text of n words
takes memory for about 8 log2(longest repeat) numbers a word and is never cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import bounded, prepare, slices, text_array

MIN_WORDS = 24
MIN_EXPONENT = 3
SLICE_BYTES = 1 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of characters other than blank and 9 to 13, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    count = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(full), count[ends]


def suffix_classes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All positions in suffix order, and per doubling k the class of each position by its first 2 ** k words (one more
    place at the end belongs to no class). A class is named by the first place it has in the order."""
    n = len(words)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = first[1:][text]
    key = text * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    slots, rank, classes, h = np.arange(n), np.full(n + 1, -1, np.int64), [], 1
    found = key[order]
    while True:
        fresh = np.ones(len(slots), bool)
        fresh[1:] = found[1:] != found[:-1]
        named = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[order[slots]] = named
        classes.append(rank.copy())
        several = ~(fresh & np.append(fresh[1:], True))
        slots = slots[several]
        if not len(slots):
            return order, classes
        mine = order[slots]
        beyond = mine + h
        second = np.where(beyond < end[mine], rank[np.minimum(beyond, n)], -1)
        key = rank[mine] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        order[slots], found = mine[by], key[by]
        h *= 2


def common_prefixes(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and j have in common."""
    length = np.zeros(len(i), np.int64)
    for k in range(len(classes) - 1, -1, -1):
        length += np.where(classes[k][i + length] == classes[k][j + length], 1 << k, 0)
    return length


class Positions:
    """An ordered set in short pieces, so that adding to a large one stays cheap."""

    __slots__ = ("heads", "pieces", "size")
    PIECE = 512

    def __init__(self, x: int):
        self.heads, self.pieces, self.size = [x], [[x]], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, x: int) -> tuple[int, int]:
        """Add x; its neighbours, -1 where there is none."""
        at = max(bisect_right(self.heads, x) - 1, 0)
        piece = self.pieces[at]
        k = bisect_left(piece, x)
        before = piece[k - 1] if k else self.pieces[at - 1][-1] if at else -1
        after = piece[k] if k < len(piece) else self.pieces[at + 1][0] if at + 1 < len(self.pieces) else -1
        piece.insert(k, x)
        self.size += 1
        if not k:
            self.heads[at] = x
        if len(piece) > self.PIECE:
            half = len(piece) // 2
            self.pieces.insert(at + 1, piece[half:])
            self.heads.insert(at + 1, piece[half])
            del piece[half:]
        return before, after


def seeds(i: np.ndarray, j: np.ndarray, common: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(first position, distance, common words) of positions that become neighbours and can begin a run."""
    out: list[tuple[int, int, int]] = []
    parent: dict[int, int] = {}
    members: dict[int, Positions] = {}

    def top(x: int) -> int:
        if x not in parent:
            parent[x] = x
            members[x] = Positions(x)
            return x
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by = np.argsort(-common, kind="stable")
    for a, b, l in zip(i[by].tolist(), j[by].tolist(), common[by].tolist(), strict=True):
        a, b = top(a), top(b)
        if members[a].size < members[b].size:
            a, b = b, a
        large, small = members[a], members.pop(b)
        parent[b] = a
        # two positions of the same old class that stay neighbours are not new, nor are those with another one between
        most = min(l // (min_exponent - 1), l)
        added = list(small)
        last = -1
        for x, following in zip(added, [*added[1:], 1 << 62], strict=True):
            before, after = large.add(x)
            if before >= 0 and before != last and x - before <= most and l + x - before >= min_words:
                out.append((before, x - before, l))
            if 0 <= after < following and after - x <= most and l + after - x >= min_words:
                out.append((x, after - x, l))
            last = x
    return out


def find_runs(words: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (text, start in the text, length, period), by text, start and period."""
    least = -(-min_words * (min_exponent - 1) // min_exponent)  # common words of a run's first two periods
    none = np.zeros((0, 4), np.int64)
    if len(words) < min_words:
        return none
    order, classes = suffix_classes(words, first)
    k = least.bit_length() - 1  # neighbours with fewer than 2 ** k common words cannot have enough
    if k >= len(classes):
        return none
    at = np.flatnonzero(classes[k][order[1:]] == classes[k][order[:-1]])
    i, j = order[at], order[at + 1]
    common = common_prefixes(classes, i, j)
    enough = common >= least
    got = np.array(seeds(i[enough], j[enough], common[enough], min_words, min_exponent), np.int64).reshape(-1, 3)
    start, period, length = got[:, 0], got[:, 1], got[:, 1] + got[:, 2]
    text = np.searchsorted(first, start, side="right") - 1
    widest = (start == first[text]) | (words[start - 1] != words[start + period - 1])
    rows = np.stack([text, start - first[text], length, period], axis=1)[widest]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


RUN_TYPE = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))


def detect(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(row, n_words, runs, collapsed): kept columns, words, runs (start, length, period) in order, and the words outside
    of all repetitions, that is without those after the first period of any run, joined by one blank."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, b in slices(texts, SLICE_BYTES):
                flat, first = split_words(texts.slice(a, b - a))
                coded = flat.dictionary_encode()
                words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs = find_runs(words, first, min_words, min_exponent)
                change = np.zeros(len(words) + 1, np.int64)
                start = first[runs[:, 0]] + runs[:, 1]
                np.add.at(change, start + runs[:, 3], 1)
                np.add.at(change, start + runs[:, 2], -1)
                kept = np.cumsum(change)[:-1] == 0
                ends = np.concatenate([[0], np.cumsum(kept)])[first]
                collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), flat.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
                each = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                cuts = pa.array(np.searchsorted(runs[:, 0], np.arange(b - a + 1)).astype(np.int32))
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.ListArray.from_arrays(cuts, each), collapsed.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "runs", "collapsed"])

    rows = documents.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUN_TYPE), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(bounded(run), schema)
