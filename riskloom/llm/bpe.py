"""Byte-level BPE by recursive DuckDB queries inside each task, and decoding by ordered aggregation.

A task cuts its texts into pieces and these into pre-tokens, encodes each distinct one once, and looks the rest up: a piece
met before is one lookup, only new pieces are matched against the pattern. Encoding is one recursive query over rows ``(word,
place, pair)``, a token and the one after it: pairs join the merge table, each word contracts its leftmost pair of least rank,
and words without a pair drop out, until none is left. The second row of a contracted pair takes the new token and the row
before the pair has it as its next one; the first row goes, and places before it close up, so no row looks for its neighbour.
The merge table holds every split of a token into two tokens, which is what ranking by joined bytes means.

Decoding joins token rows to the vocabulary and joins their bytes in order of position, per document.

A word of more than ``LONG_WORD`` bytes (a run of letters without any cut) would make the recursion keep a row per byte and
step, so it is contracted on its own, by the same rule, with a heap of its pairs: memory in proportion to the word.

Memory: texts are taken in slices; encoded words and pieces are kept in two generations of at most ``KEEP`` each, and a
slice's, so a task's memory does not grow with its input. Everything in Python is bounded by a slice; DuckDB runs on one thread with a memory limit and
no folder to spill to. The codec is closed at the end of its task.

Defined results: null is the empty text, with no tokens; repeated rows are encoded each; any text round-trips; extra
columns pass through, but one named like a result is replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.llm.common import bounded, slices, text_array, without

#: Words, and pieces, kept in each of two generations.
KEEP = 100_000
#: Words that one recursive query encodes.
WORDS_PER_QUERY = 25_000
#: Bytes of the longest word that goes into a recursive query, and bytes of all words in one.
LONG_WORD = 1000
BYTES_PER_QUERY = 250_000
SLICE_BYTES = 1 << 20
DUCKDB_MEMORY = "300MB"

#: Where a text may be cut: before a blank that follows no white space. No match of the pattern spans such a place.
CUT = re.compile(r"(?<=\S)(?= )")

#: The token after the last one of a word.
NONE = 0xFFFFFFFF

ENCODE = f"""
WITH RECURSIVE state(step, word, place, pair) AS (
  SELECT 0, word, place, pair FROM start
  UNION ALL
  SELECT s.step + 1, s.word, s.place + (s.place < b.at)::BIGINT, CASE s.place - b.at
    WHEN 1 THEN (b.merged << 32) | (s.pair & {NONE}) WHEN -1 THEN (s.pair >> 32 << 32) | b.merged ELSE s.pair END
  FROM state s JOIN (
    SELECT x.word, min((m.rank << 40) | x.place) & 1099511627775 AS at, min((m.rank << 40) | x.place) >> 40 AS merged
    FROM state x JOIN merges m USING (pair)
    GROUP BY x.word
  ) b ON b.word = s.word
  WHERE s.place <> b.at
)
SELECT word, pair >> 32 AS token FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
ORDER BY place
"""
DECODE = """
SELECT doc, string_agg(piece, '') AS text
FROM (SELECT t.doc, v.piece FROM tokens t JOIN vocabulary v ON v.id = t.id ORDER BY t.place) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Recent:
    """Token ids by text, in two generations: what was used since the last change, and what was before."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, texts: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each text; those not known are made, each once."""
        out = list(map(self.new.get, texts))
        lacking = dict.fromkeys([x for x, ids in zip(texts, out, strict=True) if ids is None])
        if lacking:
            known = {x: ids for x in lacking if (ids := self.old.get(x)) is not None}
            missing = [x for x in lacking if x not in known]
            self.new.update(known)
            self.new.update(zip(missing, make(missing), strict=True))
            out = list(map(self.new.__getitem__, texts))
        if len(self.new) > KEEP:
            self.old, self.new = self.new, {}
        return out


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "allocator_flush_threshold": "1MB", "temp_directory": ""})
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pairs = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self._table("merges", pa.table({"pair": pairs, "rank": np.array(merged, np.int64)}))
        # bytes as the characters of the same number: DuckDB joins text, not bytes
        self._table("vocabulary", pa.table({"id": np.array(list(ranks.values()), np.int64), "piece": [t.decode("latin-1") for t in ranks]}))
        self.words, self.pieces = Recent(), Recent()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian 32-bit) of each word."""
        out = [b""] * len(words)
        short: list[int] = []
        size = 0
        for i, word in enumerate(words):
            if len(word) > LONG_WORD:
                out[i] = self.contract(word)
                continue
            if len(short) == WORDS_PER_QUERY or size + len(word) > BYTES_PER_QUERY:
                self._encode_part(words, short, out)
                short, size = [], 0
            short.append(i)
            size += len(word)
        if short:
            self._encode_part(words, short, out)
        return out

    def _encode_part(self, words: list[bytes], wanted: list[int], out: list[bytes]) -> None:
        part = [words[i] for i in wanted]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        token = self.byte[np.frombuffer(b"".join(part), np.uint8)]
        following = np.append(token[1:], NONE)
        following[np.cumsum(sizes) - 1] = NONE
        self._table("start", pa.table({"word": np.repeat(np.arange(len(part)), sizes), "place": np.arange(len(token)), "pair": token << 32 | following}))
        got = self.db.sql(ENCODE).to_arrow_table()
        tokens = got["token"].to_numpy().astype("<u4").tobytes()
        ends = (4 * np.searchsorted(got["word"].to_numpy(), np.arange(len(part) + 1))).tolist()
        for i, a, b in zip(wanted, ends[:-1], ends[1:], strict=True):
            out[i] = tokens[a:b]

    def contract(self, word: bytes) -> bytes:
        """One word, whose leftmost pair of least rank is contracted until there is none."""
        n, rank = len(word), self.ranks.get
        following, previous = list(range(1, n + 2)), list(range(-1, n))
        heap = [(r, s, s + 1, s + 2) for s in range(n - 1) if (r := rank(word[s : s + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if following[start] != middle or following[middle] != end:
                continue  # one of the two is another token by now
            following[start], following[middle], previous[end] = end, -1, start
            for s, m in ((previous[start], start), (start, end)):
                if s >= 0 and m < n and (r := rank(word[s : following[m]])) is not None:
                    heapq.heappush(heap, (r, s, m, following[m]))
        tokens, at = [], 0
        while at < n:
            tokens.append(self.ranks[word[at : following[at]]])
            at = following[at]
        return np.array(tokens, "<u4").tobytes()

    def close(self) -> None:
        self.db.close()
        self.words, self.pieces = Recent(), Recent()

    def make_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out = [None if r is None else r.to_bytes(4, "little") for r in map(self.ranks.get, raw)]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(missing, self.encode_words([raw[i] for i in missing]), strict=True):
            out[i] = ids
        return out

    def make_pieces(self, pieces: list[str]) -> list[bytes]:
        words: list[str] = []
        ends = []
        for p in pieces:
            if (p[1:] if p[:1] == " " else p).isalpha():
                words.append(p)
            else:
                words += self.pattern.findall(p)
            ends.append(len(words))
        ids = self.words.get(words, self.make_words)
        return [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in pairwise([0, *ends])]

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Pieces cut before single blanks that follow no white space, which no match of the pattern spans: number of the
        distinct piece at each place, distinct pieces, pieces per text."""
        if pc.any(pc.match_substring_regex(texts, r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] ")).as_py():
            lists = [CUT.split(x) for x in texts.to_pylist()]
            flat = pa.array([p for x in lists for p in x], pa.large_string()).dictionary_encode()
            return flat.indices.to_numpy().astype(np.int64), flat.dictionary, np.fromiter(map(len, lists), np.int64, len(lists))
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        numbers, pieces = flat.indices.to_numpy().astype(np.int64), flat.dictionary
        # the first piece of a text has no blank before it, all others have
        first = np.zeros(len(numbers), bool)
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pieces, pa.scalar("", pa.large_string()))
        return np.where(first, numbers, numbers + len(pieces)), pa.concat_arrays([pieces, spaced]), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and tokens per text."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        numbers, pieces, counts = self.chunks(texts)
        used, numbers = np.unique(numbers, return_inverse=True)
        tokens = self.pieces.get(pieces.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist(), self.make_pieces)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        starts = np.cumsum(sizes) - sizes
        every = np.frombuffer(b"".join(tokens), "<u4")
        length = sizes[numbers]
        total = int(length.sum())
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        text = np.repeat(np.arange(len(counts)), counts)
        return every[np.repeat(starts[numbers], length) + within], np.bincount(text, weights=length, minlength=len(counts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        out = [b""] * len(counts)
        if len(ids):
            self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(counts)), counts), "place": np.arange(len(ids)), "id": ids.astype(np.int64)}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("tokens")
            for doc, text in zip(got["doc"].to_pylist(), got["text"].to_pylist(), strict=True):
                out[doc] = text.encode("latin-1")
        return out


def tokenize(documents: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """All columns of the documents with n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids themselves."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    documents = without(documents, names)
    place = documents.columns.index("text")
    sent = documents.sparkSession.sparkContext.broadcast(ranks)  # the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        try:
            for batch in batches:
                own = own or Codec(sent.value, pattern)
                texts = text_array(batch.column(place))
                for a, b in slices(texts, SLICE_BYTES):
                    part = texts.slice(a, b - a)
                    ids, counts = own.encode(part)
                    ends = np.cumsum(counts)
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    new = [
                        pa.array(counts),
                        pa.array([hashlib.sha256(raw[4 * (e - c) : 4 * e]).hexdigest() for e, c in zip(ends, counts, strict=True)]),
                        pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids, counts)]),
                    ]
                    if with_ids:
                        new.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                    rows = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, *names])
        finally:
            if own:
                own.close()

    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.LongType())]
    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=False))])
    return documents.mapInArrow(bounded(run), schema)
