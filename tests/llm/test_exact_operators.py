"""Periodic runs, the Merkle manifest and repeated bytes against plain Python on whole tables and on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import manifest, repeats, runs
from riskloom.llm import queries as q
from riskloom.llm.common import prepare

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, None), (2, ""), (3, "One two"), (3, "One two"), (4, LONG), (5, LONG), (6, "..!? \n\n --"), (None, "A null id with a few more words here " * 20),
    (7, "  lead  two   blanks\n\n \ttabs nbsp Ünïcode ÀÉ 12345 don't we'll 🙂🙂 x\x0b\x0c"), (8, "a" * 3000 + "\n" * 500), (9, "\x1c \x85   \r\n \x00"),
    (10, "na " * 900), (11, "x" + "na " * 900), (12, "0" * 399), (12, "0" * 400), (13, "é" * 700), (None, None),
]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def table(spark, name, folder=SF):
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that the operators use as names of their own are the user's here."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i != 7 else None, len(t or ""), "mine", 1, "mine") for i, t in AWKWARD]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key int, spans string"
    return prepare(spark).createDataFrame(rows, names)


# -------------------------------------------------------------------------------------------------- periodic runs
def brute_runs(w, min_words=24, exponent=3):
    n, found = len(w), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(min_words, exponent * p):
                found.append((s, i + p - s, p))
            i += 1
    return sorted((s, n, p) for s, n, p in found if not any(r < p and t <= s and t + m >= s + n for t, m, r in found))


def collapsed(w, found):
    drop = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_of_a_whole_table(spark):
    want = collections.Counter()
    for r in table(spark, "documents").select("doc_id", "text").collect():
        w = planted(r.doc_id, split(r.text))
        found = brute_runs(w)
        b = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        best = (b[0], b[1], b[2], 1000 * b[1] // b[2]) if b else (None,) * 4
        want[r.doc_id, len(found), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(collapsed(w, found))] += 1
    got = collections.Counter(tuple(r) for r in q.op11_periodic_runs(spark, SF).collect())
    assert got == want and sum(k[1] > 0 for k in want) > 5


def test_runs_of_awkward_rows(spark, docs):
    got = runs.detect(docs, keep=("doc_id", "row", "spans")).collect()
    assert collections.Counter((r.row.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == collections.Counter(
        (i, len(split(t)), tuple(f), collapsed(split(t), f)) for i, t in AWKWARD for f in [brute_runs(split(t)) if t != LONG else brute_runs_of_long()]
    )
    assert {(r.row.row, r.row.spans) for r in got} == {("mine", "mine")}
    assert runs.detect(docs.where("1 = 0")).count() == 0


def brute_runs_of_long():
    # the period of the two counters is over a third of the text
    assert 977 * 31 > 10_000
    return []


def test_runs_of_random_words():
    draw = random.Random(1)
    for _ in range(400):
        listed = []
        for _ in range(draw.randint(1, 4)):
            w = [draw.randrange(draw.choice([1, 2, 3, 10])) for _ in range(draw.randint(0, 70))]
            for _ in range(draw.randint(0, 3) if len(w) > 4 else 0):
                a, p = draw.randrange(len(w)), draw.randint(1, 9)
                for i in range(a, min(len(w), a + draw.randint(0, 40))):
                    w[i] = w[a + (i - a) % p]
            listed.append(w)
        first = np.cumsum([0, *map(len, listed)])
        words = np.array([x for w in listed for x in w], np.int64)
        least, exponent = draw.choice([(24, 3), (6, 3), (12, 3), (9, 4)])
        got = [tuple(x) for x in runs.find_runs(words, first, least, exponent).tolist()]
        assert got == [(k, *x) for k, w in enumerate(listed) for x in brute_runs(w, least, exponent)]


def test_very_long_runs():
    for p in (1, 7, 1000):
        assert runs.find_runs(np.arange(60_000) % p, np.array([0, 60_000])).tolist() == [[0, 0, 60_000, p]]


# ------------------------------------------------------------------------------------------------------- manifest
def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def on_the_way(tree, i):
    for nodes in tree[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        yield run, i % 16
        i //= 16


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = collections.defaultdict(list)
    for r in rows:
        leaf = sha("".join(map(field, r)))
        hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf, sha("".join(map(field, (*r[:4], r[4].translate(low))))) if hit else leaf, r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = collections.Counter()
    for k, s in enumerate(names):
        for i, (_, _, leaf, acc, doc_id) in enumerate(sorted(by[s])):
            siblings = []
            for run, p in itertools.chain(on_the_way(trees[s], i), on_the_way(top, k)):
                siblings += run[:p] + run[p + 1 :]
                acc = sha("".join([*run[:p], acc, *run[p + 1 :]]))
            out[doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join(siblings)), acc, acc == top[-1][0]] += 1
    return out


def test_manifest_of_a_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = collections.Counter(tuple(r) for r in q.op12_merkle_manifest(spark, SF).collect())
    assert got == brute_manifest(rows) and 0 < sum(k[-1] for k in got) < len(got)


def proofs(frame, **options):
    leaf = manifest.digest(*(manifest.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    got = manifest.prove(frame.withColumn("leaf", leaf), "source", "doc_id", "leaf", **options)
    folded = manifest.fold(F.col("row.leaf"), F.col("places"), F.col("siblings"))
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256)
    return got.select("row.doc_id", "row.leaf", "subroot", "root", proof.alias("proof"), folded.alias("folded"), (folded == F.col("root")).alias("ok"))


@pytest.mark.parametrize(("partitions", "part_bits"), [(1, 12), (5, 3), (3, 0)])
def test_manifest_of_awkward_rows(spark, docs, partitions, part_bits):
    """Leaf partitions of 4096, 8 and 1 leaves; over 256 leaves in a group, over 16 groups, many equal rows."""
    same = spark.range(300).select(F.lit(77).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    many = spark.range(40).select((F.col("id") % 23).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.concat(F.lit("Ü"), F.col("id") % 19).alias("source"), "id")
    many = many.select("doc_id", "text", "lang", "source", F.col("id").alias("n_chars"))
    more = [F.lit("mine").alias(c) for c in ("tree", "hash", "part", "n")]
    frame = docs.drop("row", "key", "spans").unionByName(same).unionByName(many).select("*", *more)
    rows = [tuple(r) for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = collections.Counter()
    for (doc_id, leaf, subroot, root, proof, _, _), n in brute_manifest(rows).items():
        want[doc_id, leaf, subroot, root, proof, root, True] += n
    assert collections.Counter(tuple(r) for r in proofs(frame, partitions=partitions, part_bits=part_bits).collect()) == want


def test_manifest_of_one_row_and_of_none(spark, docs):
    one = proofs(docs.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded and one[0].proof == sha("")
    assert proofs(docs.where("1 = 0")).count() == 0


# -------------------------------------------------------------------------------------------------- repeated bytes
def brute_repeats(documents, length):
    count = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in documents]
    for _, b in raw:
        count.update(hashlib.md5(b[k : k + length]).digest() for k in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in raw:
        spans = []
        for k in range(len(b) - length + 1):
            if count[hashlib.md5(b[k : k + length]).digest()] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in spans)], [*(x for x, _ in spans), len(b)], strict=True))
        out[i, len(b), sum(y - x for x, y in spans), len(spans), sha(kept)] += 1
    return out


def removed(frame, **options):
    got = repeats.dedup(frame, **options).collect()
    return collections.Counter((r.row.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.spans), len(r.spans), sha(bytes(r.kept))) for r in got)


def test_repeated_bytes_of_a_whole_table(spark):
    d = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    got = collections.Counter(tuple(r) for r in q.op13_repeated_bytes(spark, SF).collect())
    assert got == brute_repeats(d, 400) and any(k[2] for k in got)


def passages(n=60):
    """A passage in many different surroundings, more of it in some, cut at other places in others."""
    draw = random.Random(9)
    junk = lambda k: "".join(draw.choices("abcdefghij ", k=k))
    shared = junk(700)
    return [(5000 + i, junk(draw.randrange(300)) + shared[draw.randrange(0, 200) : 700 - draw.randrange(0, 200)] + junk(draw.randrange(300))) for i in range(n)]


@pytest.mark.parametrize(("hot", "slice_bytes"), [(8000, 1 << 20), (1, 1 << 20), (8000, 1500)])
def test_repeated_bytes_of_awkward_rows(spark, docs, monkeypatch, hot, slice_bytes):
    """With one shard, with every anchor counted as a hot one, and with long texts read in pieces."""
    monkeypatch.setattr(repeats, "SLICE_BYTES", slice_bytes)
    short = [(i, t[:9000] if t else t) for i, t in AWKWARD] + passages()
    frame = spark.createDataFrame(short, "doc_id bigint, text string").withColumns({c: F.lit("mine") for c in ("t", "u", "at", "key", "seg", "lo", "row", "n")})
    assert removed(frame, hot=hot) == brute_repeats(short, 400)


def test_repeated_bytes_of_short_windows_and_of_none(spark, docs):
    texts = [(i, "".join(random.Random(i).choices("ab", k=60 + i))) for i in range(40)]
    frame = prepare(spark).createDataFrame(texts, "doc_id bigint, text string")
    assert removed(frame, length=14, anchor=5) == brute_repeats(texts, 14)
    assert repeats.dedup(docs.where("1 = 0")).count() == 0


def test_suffix_arrays_and_common_prefixes():
    draw = random.Random(3)
    for _ in range(600):
        k, n = draw.choice([1, 2, 3, 5, 40]), draw.randint(1, 60)
        x = [draw.randint(1, k) for _ in range(n)]
        x = np.array(x * draw.choice([1, 1, 2]) + [0])
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        smaller = repeats.smaller_than_next(x)
        lms = np.flatnonzero(np.append(False, smaller[1:] & ~smaller[:-1]))
        order = np.array([i for i in want if i in set(lms.tolist())])
        assert repeats.suffix_array(x, k + 1).tolist() == repeats.induce_by_bucket(x, smaller, order, k + 1).tolist() == repeats.order_of_names(x).tolist() == want
        common = [0] * len(x)
        for a, b in itertools.pairwise(want):
            while max(a, b) + common[b] < len(x) and x[a + common[b]] == x[b + common[b]]:
                common[b] += 1
        assert repeats.permuted_common_prefixes(x, np.array(want)).tolist() == common
