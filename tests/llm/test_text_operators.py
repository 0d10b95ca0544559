"""Operators on documents against plain Python on whole tables and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, fingerprint, jaccard, langid, shards, toxicity
from riskloom.llm import queries as q
from riskloom.llm.common import prepare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
AWKWARD = [
    (1, None), (2, ""), (3, "One two"), (3, "One two"), (4, LONG), (5, LONG), (6, "..!? \n\n --"), (None, "A null id with a few more words here"),
    (7, "  lead  two   blanks\n\n \ttabs nbsp Ünïcode ÀÉ 12345 don't we'll 🙂🙂 x"), (8, "a" * 300 + "\n" * 5), (9, "\x1c \x85   \r\n \x00"),
]


def words(text):
    return WORD.findall((text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "w", 1) for i, t in AWKWARD]
    return prepare(spark).createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, w string, word int")


def table(spark, name, folder=SF):
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def empty(spark, name):
    return table(spark, name).where("1 = 0")


# ------------------------------------------------------------------------------------------------ decontamination
def hits(documents, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc_id, text in documents:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        out.append((doc_id, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return out


def test_decontamination_finds_what_brute_force_finds(spark):
    d = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    want = {(i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), c) for i, n, h, x, c in hits(d, items)}
    got = [tuple(r) for r in q.op1_decontamination(spark, SF).collect()]
    assert sorted(got) == sorted(want) and any(r[-1] for r in want)


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_decontamination_of_awkward_rows(spark, docs, broadcast_rows):
    texts = ["One two", "word5x5", "", None, "a few", LONG[3000:3100], "lead two BLANKS tabs", "one", LONG[3000:3100]]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").withColumnRenamed("x", "y")
    got = decontaminate.contamination(docs, items, broadcast_rows=broadcast_rows).drop("rid").collect()
    want = sorted(((i, n, h, tuple(x), c) for i, n, h, x, c in hits(AWKWARD, list(enumerate(texts)))), key=str)
    assert sorted(((a, b, c, tuple(x), e) for a, b, c, x, e in got), key=str) == want


def test_decontamination_of_empty_tables(spark, docs):
    clean = decontaminate.contamination(docs, empty(spark, "benchmark")).collect()
    assert len(clean) == len(AWKWARD) and not any(r.contaminated for r in clean)
    assert decontaminate.contamination(empty(spark, "documents"), table(spark, "benchmark")).count() == 0


# ---------------------------------------------------------------------------------------------------- language id
def test_kneser_ney_probabilities_sum_to_one(spark):
    rows = table(spark, "documents").select("lang", "text").limit(60)
    model = langid.fit(rows)
    import numpy as np

    letters = [int(x) & 0xFFFF for x in model["keys"][1]]
    for context in ([32, 32, 32], [ord("t"), ord("h"), ord("e")], [ord("q"), ord("z"), ord("x")]):
        keys = np.array([(context[0] << 48) | (context[1] << 32) | (context[2] << 16) | c for c in letters], np.uint64)
        total = np.exp2(langid.log_probabilities(model, keys).astype(float)).sum(axis=0)
        assert (total > 0.97).all() and (total < 1.0001).all()  # the rest is for characters never seen


def test_counts_equal_a_plain_count(spark):
    rows = [("a", "Ab ab."), ("a", None), ("b", "ÀB-c"), ("a", "")]
    got = {(r.lang, r.key & (2**64 - 1)): r.n for r in langid.count_ngrams(prepare(spark).createDataFrame(rows, "lang string, text string")).collect()}
    want = collections.Counter()
    for lang, text in rows:
        flat = "   " + re.sub(r"\W+", " ", (text or "").lower()).lstrip()
        for i in range(len(flat) - 3):
            want[lang, sum(ord(c) << (48 - 16 * j) for j, c in enumerate(flat[i : i + 4]))] += 1
    assert got == dict(want)


def brute_kneser_ney(rows):
    """A function (lang, four characters) -> probability of the last one, from dictionaries."""
    count = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        flat = "   " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).lstrip()
        for i in range(len(flat) - 3):
            count[4, lang][flat[i : i + 4]] += 1
    langs = sorted({lang for _, lang in count})
    for k in (3, 2, 1):
        for lang in langs:
            for gram in count[k + 1, lang]:
                count[k, lang][gram[1:]] += 1
    discount, alphabet = {}, len({g for lang in langs for g in count[1, lang]})
    for k in (1, 2, 3, 4):
        values = [n for lang in langs for n in count[k, lang].values()]
        ones, twos = values.count(1), values.count(2)
        discount[k] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(lang, gram):
        if not gram:
            return 1 / (alphabet + 1)
        k = len(gram)
        own = {g: n for g, n in count[k, lang].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(lang, gram[1:])
        total = sum(own.values())
        return max(own.get(gram, 0) - discount[k], 0) / total + discount[k] * len(own) / total * p(lang, gram[1:])

    return langs, p


def test_kneser_ney_against_dictionaries(spark):
    import numpy as np

    draw = random.Random(4)
    rows = [(x, " ".join("".join(draw.choices(a, k=draw.randint(1, 5))) for _ in range(30))) for x, a in (("x", "abcde"), ("y", "cdefgé")) for _ in range(3)]
    langs, p = brute_kneser_ney(rows)
    learn = prepare(spark).createDataFrame(rows, "lang string, text string")
    grams = ["".join(draw.choices(" abcdefgéz", k=4)) for _ in range(300)]
    keys = np.array([sum(ord(c) << (48 - 16 * j) for j, c in enumerate(g)) for g in grams], np.uint64)
    want = np.log2([[p(lang, g) for lang in langs] for g in grams])
    assert np.abs(langid.log_probabilities(langid.fit(learn), keys) - want).max() < 1e-4
    tables = langid.fit(learn, max_ngrams=0)
    parts = [t.withColumn("gram", F.lit(g)) for t, g in ((tables.grams, True), (tables.contexts, False))]
    got = parts[0].unionByName(parts[1]).toPandas()
    lang = got["lang"].map(langs.index).to_numpy()
    model = tables.assemble(got["k"].to_numpy(), got["key"].to_numpy().view(np.uint64), lang, got["v"].to_numpy(), got["gram"].to_numpy())
    assert np.abs(langid.log_probabilities(model, keys) - want).max() < 1e-4


@pytest.mark.parametrize("block_chars", [1 << 24, 100_000])
def test_a_model_in_tables_predicts_the_same(spark, docs, block_chars):
    learn = table(spark, "documents").where("doc_id % 3 != 0").select("lang", "text")
    small, large = langid.fit(learn), langid.fit(learn, max_ngrams=100)
    assert isinstance(small, dict) and isinstance(large, langid.Tables)
    frame = table(spark, "documents").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    key = lambda r: (str(r.doc_id), hashlib.md5((r.text or "").encode()).hexdigest())
    a = sorted(langid.predict(frame, small).collect(), key=key)
    schema = langid.predict(frame, small).schema
    b = sorted(langid.predict_in_blocks(frame, large, schema, block_chars).collect(), key=key)
    assert len(a) == len(b) == frame.count()
    for x, y in zip(a, b, strict=True):
        assert (x.doc_id, x.lang_pred, x.n_letters) == (y.doc_id, y.lang_pred, y.n_letters)
        assert abs(x.score - y.score) < 1e-4 and abs(x.cross_entropy - y.cross_entropy) < 1e-4
    assert langid.predict(empty(spark, "documents"), large).count() == 0


def test_language_of_held_out_documents(spark):
    rows = q.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in table(spark, "documents", "/root/testdata/sf0.01").collect()}
    held = [r for r in rows if r.held_out]
    print(sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held), [r for r in rows if r.rejected])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in rows) <= len(rows) * 0.002


def test_language_of_awkward_rows(spark, docs):
    model = langid.fit(table(spark, "documents").where("doc_id < 100"))
    out = langid.reject(langid.predict(docs, model), F.col("doc_id") < 0).select("doc_id", "text", "lang_pred", "score", "rejected", "word").collect()
    assert len(out) == len(AWKWARD)
    for r in out:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.rejected and r.score == 0))
    assert langid.fit(empty(spark, "documents")) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty(spark, "documents"), model).count() == 0


def test_unlearnt_languages_are_rejected_beside_very_long_texts(spark):
    """Letters of the unlearnt texts are known, their sequences are not; clean texts are up to 200,000 letters long."""
    draw = random.Random(7)
    stems = {x: ["".join(draw.choices(a, k=2)) for _ in range(12)] for x, a in (("a", "abcdefghijklm"), ("b", "klmnopqrstuvwxyz"))}
    foreign = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=2)) for _ in range(300)]
    text = lambda s, n: " ".join("".join(draw.choices(s, k=3)) for _ in range(n // 7))

    def own(x, n, i):  # long documents differ from each other, as some have words that others lack
        return text([*stems[x], *draw.choices(foreign, k=1 + i % 2)], n)

    rows = [(i, x, own(x, 200_000 if i % 25 == 0 else 400 + 40 * (i % 50), i)) for x in "ab" for i in range(1000 * (x == "b"), 1000 * (x == "b") + 300)]
    rows += [(5000 + i, None, text(foreign, n)) for i, n in enumerate([400, 600, 1000, 3000, 20_000, 100_000] * 3)]
    frame = prepare(spark).createDataFrame(rows, "doc_id bigint, lang string, text string")
    calibrates = F.col("lang").isNotNull() & (F.col("doc_id") % 5 == 0)
    model = langid.fit(frame.where(F.col("lang").isNotNull() & ~calibrates))
    out = langid.reject(langid.predict(frame, model).drop("text"), calibrates).collect()
    assert len(out) == len(rows)
    assert all(r.rejected for r in out if r.lang is None)
    assert sum(r.rejected for r in out if r.lang) <= 1


# ------------------------------------------------------------------------------------------------------- toxicity
def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, "labels", folder).collect()}
    rows = [r for r in q.op3_toxicity(spark, folder).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    order = sorted(held)
    toxic = sum(y for _, y in held)
    rank = sum(i for i, (_, y) in enumerate(order, 1) if y)
    auc = (rank - toxic * (toxic + 1) / 2) / (toxic * (len(held) - toxic))
    caught = sum(s >= 0.7 for s, y in held if y) / toxic
    wrong = sum(s >= 0.7 for s, y in held if not y) / (len(held) - toxic)
    print("auc", auc, "caught", caught, "wrong", wrong)
    assert auc > 0.95 and caught > 0.55 and wrong < 0.01  # under 300 toxic documents in four languages to learn from


def test_toxicity_of_awkward_rows(spark, docs):
    draw = random.Random(3)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(i, " ".join(draw.choices([*plain, *(["horribilis", "abominus"] * 12 if i % 2 else [])], k=80)), i % 2) for i in range(200)]
    known = prepare(spark).createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = known.select("doc_id", "toxic").union(known.select("doc_id", known["toxic"] * 0))  # labelled twice
    model = toxicity.fit(known.drop("toxic"), labels, known["doc_id"].isNotNull())
    scores = {r.doc_id: r.score for r in toxicity.score(known.select("doc_id", "text"), model).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(AWKWARD) and len({r.score for r in out if not words(r.text)}) == 1
    none = toxicity.fit(docs, empty(spark, "labels"), docs["doc_id"].isNotNull())
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty(spark, "documents"), model).count() == 0


def test_long_toxic_texts_leave_ordinary_ones_to_learn_from(spark):
    """Toxic texts that use up any common budget of characters; the score means the same with few and with many rows."""
    draw = random.Random(5)
    plain = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    marked = ["horribilis", "abominus", "detestor"]
    text = lambda n, bad: " ".join(draw.choice(marked) if bad and draw.random() < 0.1 else draw.choice(plain) for _ in range(n))
    rows = [(i, text(3000, True), 1) for i in range(40)] + [(1000 + i, text(60, False), 0) for i in range(600)]
    known = prepare(spark).createDataFrame(rows, "doc_id bigint, text string, toxic int")
    learn = known["doc_id"].isNotNull()
    taken, there = toxicity.sample(known.drop("toxic"), known.select("doc_id", "toxic"), learn, rows=100, chars=100_000)
    of = collections.Counter(y for _, y, _ in taken)
    assert there == {0: 600, 1: 40} and of[0] == 100 and 1 <= of[1] < 40
    assert sum(len(t) for _, y, t in taken if y) <= 100_000
    model = toxicity.fit(known.drop("toxic"), known.select("doc_id", "toxic"), learn, rows=100, chars=100_000)
    got = toxicity.score(known, model).collect()
    assert all(r.predicted == r.toxic for r in got)


# --------------------------------------------------------------------------------------------------- fingerprints
def check_fingerprints(rows, documents):
    order = sorted(documents, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    following = {order[i][0]: order[(i + 1) % len(order)][1] or "" for i in range(len(order))}
    prints = collections.defaultdict(set)
    for r, text in rows:
        n = len(text) // 3
        new = text[: len(text) - n] + following[r.doc_id][:n]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (following[r.doc_id] == text)
        prints[text].add(r.fingerprint)
        prints[new].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len({y for x in prints.values() for y in x}) == len(prints)


def test_fingerprints_of_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    rows = [(r, texts[r.doc_id]) for r in q.op5_fingerprints(spark, SF).collect()]
    assert len(rows) == len(texts)
    check_fingerprints(rows, list(texts.items()))
    long = [r for r, t in rows if len(t) > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > 10 * sum(r.near_next for r in long) / len(long)


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_fingerprints_of_awkward_rows(spark, docs, ranges):
    unique = docs.dropDuplicates(["doc_id"])
    got = fingerprint.fingerprints(unique, ranges).collect()
    texts = dict(AWKWARD)
    assert len(got) == len(texts)
    check_fingerprints([(r, texts[r.doc_id] or "") for r in got], list(texts.items()))
    assert fingerprint.fingerprints(docs, ranges).count() == len(AWKWARD)
    assert fingerprint.fingerprints(empty(spark, "documents"), ranges).count() == 0


def test_an_edit_is_found_in_its_branch():
    lines = [f"line {i} has some words of its own number {i * 7}\n" for i in range(60)]
    a = fingerprint.tree("".join(lines).encode())
    before = len("".join(lines[:30]))
    lines[30] = "another line altogether with quite other words in it\n"
    b = fingerprint.tree("".join(lines).encode())
    spans = fingerprint.differing(a, b)
    assert a.root != b.root and 0.95 < fingerprint.likeness(a, b) < 1
    assert spans and all(before <= x and before <= y for x, _, y, _ in spans) and max(y for _, _, _, y in spans) <= before + len(lines[30])
    assert fingerprint.differing(a, a) == []


def test_differing_ranges_of_random_edits_and_stored_trees():
    draw = random.Random(8)
    for n in range(60):
        words_ = [draw.choice(["some", "wörd", "here\n", "and", "there", "\n\n", "x"]) for _ in range(draw.randrange(400))]
        old = " ".join(words_)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(words_) + 1)
            words_[at : at + draw.randrange(3)] = [f"new{draw.randrange(99)}"] * draw.randrange(3)
        new = " ".join(words_) if n % 5 else ""
        a, b = old.encode(), new.encode()
        left, right = fingerprint.tree(a), fingerprint.tree(b)
        spans = fingerprint.differing(left, right)
        assert (spans == []) == (a == b)
        i = j = 0
        for x, y, u, v in [*spans, (len(a), len(a), len(b), len(b))]:  # what lies between the ranges is equal
            assert i <= x <= y and j <= u <= v and a[i:x] == b[j:u]
            i, j = y, v
        again = [fingerprint.load(fingerprint.dump(t)) for t in (left, right)]
        assert fingerprint.differing(*again) == spans and fingerprint.likeness(*again) == fingerprint.likeness(left, right)
        assert [fingerprint.printed(t) for t in again] == [fingerprint.printed(left), fingerprint.printed(right)]


# ---------------------------------------------------------------------------------------------------- jaccard join
def brute_links(documents):
    sets = []
    for _, text in documents:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None if text is None else {("text", text)})
    n = len(documents)
    near = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near[i].add(j)
                near[j].add(i)
    out, root = [], list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [documents[j][0] for j in seen if documents[j][0] is not None]
        root[i] = min(ids, default=None)
        out.append((documents[i][0], root[i], len(near[i]), len(seen)))
    return sorted(out, key=str)


def variants(n=120):
    """A dense group of near copies, in which links end at different distances."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(500)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(draw.randrange(6)):
            w[draw.randrange(len(w))] = f"new{draw.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_jaccard_join_of_a_whole_table(spark):
    d = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert sorted((tuple(r) for r in q.op6_jaccard_join(spark, SF).collect()), key=str) == brute_links(d)


@pytest.mark.parametrize("block", [16, 256])
def test_jaccard_join_of_awkward_rows_and_dense_groups(spark, docs, block):
    d = AWKWARD + variants()
    more = docs.select("doc_id", "text").union(spark.createDataFrame(variants(), "doc_id bigint, text string"))
    assert sorted((tuple(r)[:4] for r in jaccard.join(more, block=block).collect()), key=str) == brute_links(d)


def test_jaccard_join_of_an_empty_table(spark):
    assert jaccard.join(empty(spark, "documents")).count() == 0


def test_pruning_keeps_similar_pairs():
    least = jaccard.least_matches()
    assert least[0] == 0 and all(k <= 0.8 * jaccard.STEP * i for i, k in enumerate(least)) and least[-1] > 80


# -------------------------------------------------------------------------------------------------------- byte bpe
def reference_encoding():
    import tiktoken

    ranks, pattern = q.tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def check_tokens(rows, texts):
    own = reference_encoding()
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_tokens_of_a_whole_table(spark):
    rows = q.op9_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in table(spark, "documents", "/root/testdata/sf0.01").collect()}
    assert len(rows) == len(texts)
    check_tokens(rows, texts)


def test_tokens_of_awkward_rows(spark, docs):
    out = bpe.tokenize(docs, *q.tokenizer(), with_ids=True).collect()
    assert len(out) == len(AWKWARD)
    check_tokens(out, dict(AWKWARD))
    own = reference_encoding()
    assert all(r.ids == own.encode_ordinary(r.text or "") for r in out)
    assert bpe.tokenize(empty(spark, "documents"), *q.tokenizer()).count() == 0


def test_very_long_words():
    """Runs of up to 100,000 letters, of many and of few kinds, beside short ones, with the ids of the tokenizer library."""
    draw = random.Random(3)
    ranks, pattern = q.tokenizer()
    codec, own = bpe.Codec(ranks, pattern), reference_encoding()
    letters = "abcdefghijklmnopqrstuvwxyz"
    listed = ["a" * 100_000, "".join(draw.choices(letters, k=100_000)), "abc" * 2000, "é" * 3000, "".join(draw.choices("αβγδ漢字", k=2000)), "".join(draw.choices("etaoin", k=999)), "hello"]
    for word, ids in zip(listed, codec.encode_words([w.encode() for w in listed]), strict=True):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == own.encode_ordinary(word)
    codec.close()


def test_pieces_met_before_are_only_looked_up(monkeypatch):
    ranks, pattern = q.tokenizer()
    codec, own = bpe.Codec(ranks, pattern), reference_encoding()
    found, encoded = [], []

    class Pattern:
        def findall(self, text):
            found.append(text)
            return own_pattern.findall(text)

    own_pattern, encode_words = codec.pattern, codec.encode_words
    monkeypatch.setattr(codec, "pattern", Pattern())
    monkeypatch.setattr(codec, "encode_words", lambda words: encoded.extend(words) or encode_words(words))
    texts = ["Qwzx, it's 12345 xyzzyq", None, "", "qwzx  xyzzyq,\n\nQwzx,"]
    expected = [own.encode_ordinary(t or "") for t in texts]

    def ids():
        got, counts = codec.encode(pa.array([t or "" for t in texts], pa.large_string()))
        return [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])]

    assert ids() == expected
    assert found and encoded and len(encoded) == len(set(encoded))
    found.clear(), encoded.clear()
    assert ids() == expected
    assert not found and not encoded
    # one generation is one slice's: what the last slice used is still known
    monkeypatch.setattr(bpe, "KEEP", 1)
    assert all(ids() == expected for _ in range(4))
    assert not encoded
    codec.close()


def test_recursive_query_on_words_of_few_letters():
    """Equal pairs side by side, at both ends of a word and across neighbouring words."""
    draw = random.Random(9)
    ranks, pattern = q.tokenizer()
    codec, own = bpe.Codec(ranks, pattern), reference_encoding()
    words = ["a" * n for n in range(1, 40)] + ["".join(draw.choices(kinds, k=draw.randint(1, 30))) for kinds in ("ab", "es", "etaoin", "éa", "漢字の") for _ in range(200)]
    for word, ids in zip(words, codec.encode_words([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(word)
    codec.close()


# ---------------------------------------------------------------------------------------------------------- shards
def test_shards_are_contiguous_and_equal(spark, docs):
    for frame, total in ((table(spark, "documents"), 16), (docs, 4), (docs, 30)):
        rows = sorted(shards.byte_shards(frame, total).collect(), key=lambda r: (r.shard, r.slot))
        assert len(rows) == frame.count()
        target, largest = sum(r["size"] for r in rows) / total, max(r["size"] for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all([r.slot for r in x] == list(range(len(x))) and abs(sum(r["size"] for r in x) - target) <= largest for x in by.values())
        ids = [r.doc_id if r.doc_id is not None else -1 for r in rows]
        assert ids == sorted(ids)
    assert shards.byte_shards(empty(spark, "documents")).count() == 0
