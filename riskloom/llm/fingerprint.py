"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

Pieces are runs of words ending at a content-defined place (a blank or line end whose last letters hash to 0 modulo
``PIECE``), so an edit changes only pieces near it. A paragraph is a line; a section ends at an empty line or after a
paragraph whose digest is 0 modulo ``SECTION``. Every node's digest covers its children's in order, up to the root: equal
roots mean equal texts, and ``differing`` descends into differing branches only and gives the byte ranges that were edited.
``dump`` and ``load`` store a whole tree, with full digests and sizes, for comparisons without the texts.

The printed form is ``root;section/paragraph,paragraph/...`` reduced to what a comparison needs: the root, then per
section its digest, per paragraph its digest and its pieces' digests. Likeness walks two trees: equal roots give 1, equal
sections and paragraphs count whole, and in the others pieces are matched as multisets, each with its number of words;
it is the matched share of the words of both texts.

The next document (descending id) comes from a range partition sorted by id; the last row of each range gets the first
row of the next one as an extra row, so nothing but one text shuffle is needed and no task holds more than a few texts.

Defined results: null is the empty text; two empty texts have likeness 1, an empty and another one 0; repeated rows are
each a document, ordered by a hash of the text among equal ids (interchangeable if equal); null ids come last; a table of
one document is its own next document; extra columns are ignored.
"""

from __future__ import annotations

import base64
import difflib
import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import bounded, text_array

PIECE = 4
SECTION = 8


class Tree:
    """Digests of a text: ``root``, and sections of (digest, words, paragraphs), paragraphs of (digest, words, pieces), pieces
    of (digest, words, bytes)."""

    __slots__ = ("root", "sections", "words")

    def __init__(self, root: bytes, sections: list):
        self.root, self.sections = root, sections
        self.words = sum(s[1] for s in sections)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places after which a piece ends: blanks chosen by the four bytes before them, and all line ends."""
    if len(data) < 5:
        return np.flatnonzero(data == 10)
    wide = data.astype(np.uint32)
    h = wide[:-4] | (wide[1:-3] << 8) | (wide[2:-2] << 16) | (wide[3:-1] << 24)
    h = (h * np.uint32(2654435761)) >> np.uint32(16)
    here = (data[4:] == 32) & (h % np.uint32(PIECE) == 0)
    return np.flatnonzero(np.concatenate([np.zeros(4, bool), here]) | (data == 10))


def tree(text: bytes) -> Tree:
    data = np.frombuffer(text, np.uint8)
    ends = cuts(data) + 1
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    spaces = np.concatenate([[0], np.cumsum((data == 32) | (data == 10))])
    words = np.diff(spaces[ends], prepend=0) if len(data) else np.zeros(len(ends), np.int64)
    sections, paragraphs, pieces = [], [], []
    start = 0
    count = 0

    def close_section() -> None:
        if paragraphs:
            digest = hashlib.blake2b(b"s" + b"".join(p[0] for p in paragraphs), digest_size=16).digest()
            sections.append((digest, sum(p[1] for p in paragraphs), list(paragraphs)))
            paragraphs.clear()

    for end, n in zip(ends.tolist(), words.tolist(), strict=True):
        piece = text[start:end]
        start = end
        pieces.append((xxhash.xxh3_128_digest(piece), max(n, 1), len(piece)))
        count += 1
        if piece.endswith(b"\n") or end == len(text):
            digest = hashlib.blake2b(b"p" + b"".join(p[0] for p in pieces), digest_size=16).digest()
            paragraphs.append((digest, sum(p[1] for p in pieces), pieces))
            pieces = []
            if piece == b"\n" or digest[0] % SECTION == 0:
                close_section()
    close_section()
    return Tree(hashlib.blake2b(b"r" + b"".join(s[0] for s in sections), digest_size=16).digest(), sections if len(data) else [])


def printed(t: Tree) -> str:
    """Root in hex; then sections by ``;``, paragraphs by ``/`` as digest and pieces, shortened to 24 bits each."""
    short = lambda d: base64.b64encode(d[:3], b"-_").decode()
    body = ";".join(short(s[0]) + "".join("/" + short(p[0]) + "".join(short(x[0]) for x in p[2]) for p in s[2]) for s in t.sections)
    return f"{t.root.hex()}:{body}"


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    if not a.words or not b.words:
        return 0.0
    shared = 0
    left, right = a.sections, b.sections
    for level in (0, 1):  # match whole sections, then whole paragraphs of the unmatched sections
        have: dict[bytes, int] = Counter(x[0] for x in right)
        rest_left = []
        for x in left:
            if have.get(x[0], 0):
                have[x[0]] -= 1
                shared += x[1]
            else:
                rest_left.append(x)
        rest_right = []
        for x in reversed(right):
            if have.get(x[0], 0):
                have[x[0]] -= 1
                rest_right.append(x)
        if level == 0:
            left, right = [p for s in rest_left for p in s[2]], [p for s in reversed(rest_right) for p in s[2]]
        else:
            left, right = [q for p in rest_left for q in p[2]], [q for p in reversed(rest_right) for q in p[2]]
    have = Counter(x[0] for x in right)
    for digest, n, _ in left:
        if have.get(digest, 0):
            have[digest] -= 1
            shared += n
    return min(1.0, 2.0 * shared / (a.words + b.words))


def dump(t: Tree) -> str:
    """The whole tree as JSON: per section and paragraph the pieces' digests, words and bytes; the inner nodes follow."""
    return json.dumps([t.root.hex(), [[[[d.hex(), n, size] for d, n, size in p[2]] for p in s[2]] for s in t.sections]], separators=(",", ":"))


def load(stored: str) -> Tree:
    root, listed = json.loads(stored)
    sections = []
    for s in listed:
        paragraphs = []
        for p in s:
            pieces = [(bytes.fromhex(d), n, size) for d, n, size in p]
            paragraphs.append((hashlib.blake2b(b"p" + b"".join(x[0] for x in pieces), digest_size=16).digest(), sum(x[1] for x in pieces), pieces))
        sections.append((hashlib.blake2b(b"s" + b"".join(x[0] for x in paragraphs), digest_size=16).digest(), sum(x[1] for x in paragraphs), paragraphs))
    return Tree(bytes.fromhex(root), sections)


def _bytes(node: tuple) -> int:
    return sum(_bytes(x) for x in node[2]) if isinstance(node[2], list) else node[2]


def differing(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """Byte ranges ``(start, stop)`` of a and of b, in order, that stand for each other and differ (one may be empty). Equal
    branches are passed by; unequal sections are opened to paragraphs, unequal paragraphs to pieces."""
    out: list[tuple[int, int, int, int]] = []

    def walk(left: list, right: list, at: int, other: int, level: int) -> None:
        ends = [np.cumsum([0, *map(_bytes, x)]).tolist() for x in (left, right)]
        match = difflib.SequenceMatcher(None, [x[0] for x in left], [x[0] for x in right], autojunk=False)
        for kind, i, j, k, l in match.get_opcodes():
            if kind == "equal":
                continue
            if level < 2:
                walk([y for x in left[i:j] for y in x[2]], [y for x in right[k:l] for y in x[2]], at + ends[0][i], other + ends[1][k], level + 1)
            else:
                out.append((at + ends[0][i], at + ends[0][j], other + ends[1][k], other + ends[1][l]))

    if a.root != b.root:
        walk(a.sections, b.sections, 0, 0, 0)
    return out


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_next(documents: DataFrame, ranges: int) -> DataFrame:
    """(range_no, extra, doc_id, text) sorted so that each row's successor follows it; extra rows only end a range.

    Range bounds are quantiles of the ids; the first id of each range is read from the table, a row per range."""
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    slim = documents.select(id_.alias("id"))
    bounds = sorted(set(slim.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.001))) if ranges > 1 else []
    limits = F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>")
    number = F.size(F.filter(limits, lambda b: F.col("id") <= b))  # descending ids: range 0 holds the greatest
    firsts = slim.withColumn("range_no", number).groupBy("range_no").agg(F.max("id").alias("first")).orderBy("range_no").collect()  # a row per range
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), id_.alias("id")).withColumn("range_no", number)
    own = F.array(F.struct(F.col("range_no").alias("range_no"), F.lit(False).alias("extra")))
    targets = own
    if firsts:  # the range before each first id; before the first range: the last one, for what follows the last document
        order = [r["range_no"] for r in firsts]
        before = F.create_map(*[x for i, r in enumerate(firsts) for x in (F.lit(r["first"]), F.lit(order[i - 1]))])
        at = F.try_element_at(before, F.col("id"))
        targets = F.when(at.isNull(), own).otherwise(F.concat(own, F.array(F.struct(at.alias("range_no"), F.lit(True).alias("extra")))))
    return rows.select("doc_id", "text", "id", F.explode(targets).alias("t")).select(F.col("t.range_no").alias("range_no"), F.col("t.extra").alias("extra"), "doc_id", "text", "id")


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text; as many ranges as shuffle partitions unless given."""
    ranges = ranges or max(2, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = with_next(documents, ranges)
    placed = rows.repartitionById(ranges, F.col("range_no")).sortWithinPartitions(F.col("range_no"), F.col("extra"), F.col("id").desc(), F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, id, text, tree) whose successor is still to come
        out: list[tuple] = []

        def finish(row: tuple, text: str, t: Tree) -> None:
            new = edited(row[2], text).encode()
            changed = tree(new)
            out.append((row[1], len(row[2]), hashlib.sha256(new).hexdigest(), printed(row[3]), printed(changed), likeness(row[3], changed), likeness(row[3], t)))

        for batch in batches:
            texts = text_array(batch.column(3)).to_pylist()
            for no, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts, strict=True):
                t = tree(text.encode()) if waiting is not None or not extra else None
                if waiting is not None and waiting[0] == no:
                    finish(waiting, text, t)
                waiting = None if extra else (no, doc_id, text, t)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])
                out = []

    return placed.select("range_no", "extra", "doc_id", "text").mapInArrow(bounded(run), RESULT)
