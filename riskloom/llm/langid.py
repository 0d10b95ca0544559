"""Language identification by one interpolated Kneser-Ney character model per language.

Counting runs over every learning text: tasks pack four 16-bit character codes into one 64-bit key, sort the keys and
count runs, and Spark adds the counts up. Lower orders follow from the distinct higher ones (continuation counts), so only
the longest n-grams are counted. The model holds, per order, one sorted array of keys with a column of log-probabilities
per language, and a sorted array of contexts with their interpolation weights; a text is scored by binary search, falling
back one order at a time. It goes to the language of lowest cross-entropy per character.

Size: no n-gram is ever left out. Up to ``max_ngrams`` (language, n-gram) pairs the model is put together on the driver and
broadcast (some 100 MB at most). Beyond that it stays in tables: continuation counts, discounts, discounted probabilities
and interpolation weights of all n-grams are Spark aggregations, written once; texts are dealt into blocks, the distinct
n-grams of a block, their endings and contexts are joined to the tables, and a block is scored with the arrays put together
from its own rows. Both ways compute the same probabilities.

Rejection: a tenth of the learning texts is not counted but calibrates. Per language and length class (powers of four
letters) the limit is the ``quantile`` of the cross-entropy of the calibrating texts, or of all those of the language where
the class has none. A text of n letters is rejected if it lies above its limit by more than ``spread`` bits, by which
documents may differ at any length, and ``least / sqrt(n)`` bits, by which short ones vary. So few calibrating texts do not
make false rejections, and a single odd one moves only its own class. Texts without any letter (``und``) are rejected too.

Defined results: null or letterless text gives ``und``, score 0, rejected; ties go to the first language by name; without
learning rows all texts are ``und``; repeated rows are scored each; extra columns pass through unread, but one named like a result is
replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import bounded, materialise, slices, text_array, without

ORDER = 4
#: Pairs up to which the model is broadcast; it does not change the result.
MAX_NGRAMS = 2_000_000
#: Characters of text in one block, where the model stays in tables.
BLOCK_CHARS = 16_000_000
QUANTILE = 0.995
SPREAD = 0.5
LEAST_Z = 20.0
BREAK = 1
_codes: list[np.ndarray] = []


def code_table() -> np.ndarray:
    """Code of each character below 65536: its lower-case form if it is a letter, else a blank."""
    if not _codes:
        table = np.full(65536, 32, np.uint16)
        for c in range(65536):
            x = chr(c)
            if x.isalpha():
                low = ord(x.lower()[0])
                table[c] = low if low < 65536 else 0xFFFD
        _codes.append(table)
    return _codes[0]


def characters(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, text, letters)``: n-gram key and text number of each scored character; letters per text."""
    glued = "\x01".join(x.replace("\x01", " ") if "\x01" in x else x for x in texts)
    points = np.frombuffer(glued.encode("utf-32-le", "replace"), np.uint32)
    codes = code_table()[np.minimum(points, 65535)]
    for i in np.flatnonzero(points > 65535):
        codes[i] = 0xFFFD if chr(points[i]).isalpha() else 32
    codes[points == 1] = BREAK
    blank = codes == 32
    previous = np.concatenate([[True], blank[:-1] | (codes[:-1] == BREAK)])
    codes = codes[~(blank & previous)]
    is_break = codes == BREAK
    number = np.cumsum(is_break)
    letters = np.bincount(number[(codes != 32) & ~is_break], minlength=len(texts))
    repeat = np.where(is_break, order - 1, 1)
    pads = np.full(order - 1, 32, np.uint64)
    scored = np.repeat(~is_break, repeat)
    number = np.repeat(number, repeat)[scored]
    wide = np.concatenate([pads, np.repeat(np.where(is_break, 32, codes), repeat).astype(np.uint64)])
    keys = np.zeros(len(scored), np.uint64)
    for j in range(order):
        keys |= wide[j : j + len(scored)] << np.uint64(16 * (order - 1 - j))
    return keys[scored], number, letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def fold(lang: str) -> None:
        known, count = have.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        fresh, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        keys = np.union1d(known, fresh)
        total = np.zeros(len(keys), np.int64)
        total[np.searchsorted(keys, known)] += count
        total[np.searchsorted(keys, fresh)] += n
        have[lang] = keys, total

    for batch in batches:
        texts = text_array(batch.column(1))
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for a, b in slices(texts):
            keys, number, _ = characters(texts.slice(a, b - a).to_pylist())
            for lang in set(langs[a:b]):
                mine = keys[(langs[a:b] == lang)[number]]
                waiting.setdefault(lang, []).append(mine)
                if sum(map(len, waiting[lang])) > 1 << 19:
                    fold(lang)
    for lang in list(waiting):
        fold(lang)
    for lang, (keys, count) in have.items():
        for i in range(0, len(keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(keys[part].view(np.int64)), pa.array(count[part])], ["lang", "key", "n"])


def count_ngrams(learn: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of (lang, text)."""
    return learn.select("lang", "text").mapInArrow(bounded(_count), "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def smooth(keys: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: list[str], order: int = ORDER) -> dict:
    """Interpolated Kneser-Ney from the counts of the longest n-grams; keys are unsigned, lang an index."""
    model: dict = {"languages": languages, "order": order, "keys": {}, "logp": {}, "contexts": {}, "weight": {}}
    wide = len(languages)
    per_order = {}
    for k in range(order, 0, -1):
        per_order[k] = keys, lang, n
        if k > 1:  # continuation counts: how many distinct characters come before
            short = keys & np.uint64((1 << (16 * (k - 1))) - 1)
            pairs = np.rec.fromarrays([lang, short], names="l,k")
            unique, count = np.unique(pairs, return_counts=True)
            keys, lang, n = unique["k"].astype(np.uint64), unique["l"].astype(np.int64), count.astype(np.int64)
    alphabet = len(np.unique(per_order[1][0]))
    lower_keys, lower_p = np.zeros(0, np.uint64), None
    for k in range(1, order + 1):
        keys, lang, n = per_order[k]
        ones, twos = np.sum(n == 1), np.sum(n == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        union = np.unique(keys)
        context = union >> np.uint64(16) if k > 1 else np.zeros(len(union), np.uint64)
        contexts = np.unique(context)
        own = keys >> np.uint64(16) if k > 1 else np.zeros(len(keys), np.uint64)
        total, kinds = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
        at = np.searchsorted(contexts, own)
        np.add.at(total, (at, lang), n)
        np.add.at(kinds, (at, lang), 1)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        p = np.zeros((len(union), wide))
        np.add.at(p, (np.searchsorted(union, keys), lang), n - discount)
        place = np.searchsorted(contexts, context)
        p /= np.maximum(total[place], 1)
        if k == 1:
            below = np.full((len(union), wide), 1.0 / (alphabet + 1))
        else:  # every lower n-gram of a seen one is itself seen in some language
            below = lower_p[np.searchsorted(lower_keys, union & np.uint64((1 << (16 * (k - 1))) - 1))]
        p += weight[place] * below
        model["keys"][k], model["logp"][k] = union, np.log2(p).astype(np.float32)
        model["contexts"][k], model["weight"][k] = contexts, np.log2(np.maximum(weight, 1e-12)).astype(np.float32)
        lower_keys, lower_p = union, p
    model["unknown"] = float(np.log2(1.0 / (alphabet + 1)))
    return model


def fit(learn: DataFrame, max_ngrams: int = MAX_NGRAMS) -> dict | Tables | None:
    """A model from all rows of (lang, text) with a non-null language; None without any."""
    counts = materialise(count_ngrams(learn.where(F.col("lang").isNotNull())), "ngrams")
    pairs = counts.count()
    if not pairs:
        return None
    if pairs > max_ngrams:
        return Tables(counts)
    rows = counts.toPandas()
    languages = sorted(rows["lang"].unique())
    index = {x: i for i, x in enumerate(languages)}
    return smooth(rows["key"].to_numpy(np.int64).view(np.uint64), rows["lang"].map(index).to_numpy(np.int64), rows["n"].to_numpy(np.int64), languages)


def ending(key: Column, k: int) -> Column:
    """The last k characters of a key."""
    return key if k == 4 else key.bitwiseAND(F.lit((1 << (16 * k)) - 1))


class Tables:
    """The same model as written tables: ``grams`` (k, key, lang, p), p being the discounted share of a seen n-gram, and
    ``contexts`` (k, key, lang, weight), for all orders k and all n-grams."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order, level = order, counts
        self.languages = sorted(r[0] for r in counts.select("lang").distinct().collect())  # a row a language
        grams, contexts = [], []
        for k in range(order, 0, -1):
            if k < order:  # continuation counts: how many distinct characters come before
                level = materialise(level.groupBy("lang", ending(F.col("key"), k).alias("key")).agg(F.count(F.lit(1)).alias("n")), "continuations")
            ones, twos = level.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            of = F.shiftrightunsigned("key", 16)
            total = level.groupBy("lang", of.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            total = materialise(total, "contexts")
            contexts.append(total.select(F.lit(k).alias("k"), F.col("context").alias("key"), "lang", (F.lit(discount) * F.col("kinds") / F.col("total")).alias("v")))
            grams.append(level.withColumn("context", of).join(total, ["lang", "context"]).select(F.lit(k).alias("k"), "key", "lang", ((F.col("n") - F.lit(discount)) / F.col("total")).alias("v")))
        self.alphabet = level.select("key").distinct().count()
        self.grams = materialise(reduce(DataFrame.unionByName, grams), "grams")
        self.contexts = materialise(reduce(DataFrame.unionByName, contexts), "weights")

    def assemble(self, k: np.ndarray, key: np.ndarray, lang: np.ndarray, value: np.ndarray, is_gram: np.ndarray) -> dict:
        """The arrays of ``smooth`` for the n-grams and contexts of these rows."""
        return assemble(self.languages, self.order, self.alphabet, k, key, lang, value, is_gram)


def assemble(languages: list[str], order: int, alphabet: int, k: np.ndarray, key: np.ndarray, lang: np.ndarray, value: np.ndarray, is_gram: np.ndarray) -> dict:
    model: dict = {"languages": languages, "order": order, "keys": {}, "logp": {}, "contexts": {}, "weight": {}}
    wide, lower_keys, lower_p = len(languages), np.zeros(0, np.uint64), None
    for n in range(1, order + 1):
        own, of = (k == n) & is_gram, (k == n) & ~is_gram
        union, contexts = np.unique(key[own]), np.unique(key[of])
        weight, p = np.ones((len(contexts), wide)), np.zeros((len(union), wide))
        weight[np.searchsorted(contexts, key[of]), lang[of]] = value[of]
        p[np.searchsorted(union, key[own]), lang[own]] = value[own]
        place = np.searchsorted(contexts, union >> np.uint64(16) if n > 1 else np.zeros(len(union), np.uint64))
        below = np.full((len(union), wide), 1.0 / (alphabet + 1)) if n == 1 else lower_p[np.searchsorted(lower_keys, union & np.uint64((1 << (16 * (n - 1))) - 1))]
        p += weight[place] * below
        model["keys"][n], model["logp"][n] = union, np.log2(p).astype(np.float32)
        model["contexts"][n], model["weight"][n] = contexts, np.log2(np.maximum(weight, 1e-12)).astype(np.float32)
        lower_keys, lower_p = union, p
    model["unknown"] = float(np.log2(1.0 / (alphabet + 1)))
    return model


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def log_probabilities(model: dict, keys: np.ndarray, k: int | None = None) -> np.ndarray:
    """Log2 of the probability of each n-gram's last character, a column per language."""
    k = k or model["order"]
    at, seen = _look(model["keys"][k], keys)
    out = model["logp"][k][at] if len(model["keys"][k]) else np.zeros((len(keys), len(model["languages"])), np.float32)
    lost = np.flatnonzero(~seen)
    if len(lost):
        rest = keys[lost]
        if k == 1:
            out[lost] = model["unknown"] + model["weight"][1][0]
        else:
            shorter, where = np.unique(rest & np.uint64((1 << (16 * (k - 1))) - 1), return_inverse=True)
            below = log_probabilities(model, shorter, k - 1)[where]
            place, known = _look(model["contexts"][k], rest >> np.uint64(16))
            out[lost] = below + (np.where(known[:, None], model["weight"][k][place], 0) if len(model["weight"][k]) else 0)
    return out


def cross_entropies(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits per character by text and language, characters and letters per text."""
    keys, number, letters = characters(texts, model["order"])
    sizes = np.bincount(number, minlength=len(texts))
    total = np.zeros((len(texts), len(model["languages"])))
    if len(keys):
        logp = log_probabilities(model, keys)
        has = np.flatnonzero(sizes)
        total[has] = np.add.reduceat(logp, np.concatenate([[0], np.cumsum(sizes[has])[:-1]]), axis=0, dtype=np.float64)
    return -total / np.maximum(sizes, 1)[:, None], sizes, letters


ADDED = [("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("n_letters", pa.int64())]


def scored_columns(model: dict | None, texts: list[str]) -> list[pa.Array]:
    n = len(texts)
    best, score, ce, letters = ["und"] * n, np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    if model is not None and n:
        bits, sizes, letters = cross_entropies(model, texts)
        win = bits.argmin(axis=1)
        ce = bits[np.arange(n), win]
        gap = (bits - ce[:, None]) * np.sqrt(sizes)[:, None]
        score = np.where(letters > 0, 1 / np.exp2(-np.minimum(gap, 60)).sum(axis=1), 0.0)
        best = [model["languages"][w] if k else "und" for w, k in zip(win, letters, strict=True)]
    return [pa.array(best, pa.string()), pa.array(score), pa.array(np.where(letters > 0, ce, 0.0)), pa.array(letters.astype(np.int64))]


def predict(documents: DataFrame, model: dict | Tables | None) -> DataFrame:
    """All columns of the documents with lang_pred, score, cross_entropy and n_letters."""
    documents = without(documents, [n for n, _ in ADDED])
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("n_letters", T.LongType())])
    if isinstance(model, Tables):
        return predict_in_blocks(documents, model, schema)
    place = documents.columns.index("text")
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(place))
            for a, b in slices(texts):
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, *scored_columns(sent.value, texts.slice(a, b - a).to_pylist())], [*own.schema.names, *(x for x, _ in ADDED)])

    return documents.mapInArrow(bounded(run), schema)


def predict_in_blocks(documents: DataFrame, model: Tables, schema: T.StructType, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of documents meet the rows of the model that their own n-grams need."""
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # equal rows are spread by their place in the table, which decides nothing else
    rows = materialise(rows.withColumn("nth", F.monotonically_increasing_id()), "numbered")
    blocks = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    rows = rows.withColumn("block", F.pmod(F.xxhash64("nth"), F.lit(blocks))).drop("nth")
    order, languages, alphabet = model.order, model.languages, model.alphabet

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, block = text_array(batch.column(1)), np.asarray(batch.column(0))
            for a, b in slices(texts):
                keys, number, _ = characters(texts.slice(a, b - a).to_pylist(), order)
                for x in np.unique(block[a:b]):
                    mine = np.unique(keys[(block[a:b] == x)[number]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), x)), pa.array(mine.view(np.int64))], ["block", "key"])

    asked = rows.select("block", "text").mapInArrow(bounded(wanted), "block bigint, key bigint").distinct()
    asked = materialise(asked, "asked")
    each = [asked.select("block", F.lit(k).alias("k"), ending(F.col("key"), k).alias("key")).distinct() for k in range(1, order + 1)]
    grams = reduce(DataFrame.unionByName, each)
    contexts = grams.select("block", "k", F.shiftrightunsigned("key", 16).alias("key")).distinct()
    needed = grams.join(model.grams, ["k", "key"]).withColumn("gram", F.lit(True)).unionByName(contexts.join(model.contexts, ["k", "key"]).withColumn("gram", F.lit(False)))

    def score(held: pa.Table, known: pa.Table) -> pa.Table:
        index = {x: i for i, x in enumerate(languages)}
        lang = np.array([index[x] for x in known["lang"].to_pylist()], np.int64)
        own = assemble(languages, order, alphabet, known["k"].to_numpy(), known["key"].to_numpy().view(np.uint64), lang, known["v"].to_numpy(), known["gram"].to_numpy(zero_copy_only=False)) if len(known) else None
        texts = text_array(held["text"])
        parts = [scored_columns(own, texts.slice(a, b - a).to_pylist()) for a, b in slices(texts)]
        new = [pa.concat_arrays(list(x)) for x in zip(*parts, strict=True)]
        return pa.Table.from_arrays([held["row"], *new], ["row", *(x for x, _ in ADDED)])

    kinds = T.StructType([rows.schema["row"], *schema.fields[-len(ADDED):]])
    got = rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(score, kinds)
    return got.select("row.*", *(x for x, _ in ADDED))


def calibrates(doc_id: Column) -> Column:
    """Rows that are not counted but calibrate the rejection: about a tenth, by a hash of the id."""
    return F.pmod(F.xxhash64(F.lit("calibrate"), doc_id), F.lit(10)) == 0


def reject(scored: DataFrame, calibrate: Column, quantile: float = QUANTILE, spread: float = SPREAD, least: float = LEAST_Z) -> DataFrame:
    """Add ``rejected``. ``calibrate`` is true for rows that were not counted and have their language in column ``lang``."""
    held = scored.select(F.struct(*(F.col(f"`{c}`") for c in scored.columns if c.lower() != "rejected")).alias("row"), F.coalesce(calibrate, F.lit(False)).alias("calibrate"))
    pred, bits = F.col("row.lang_pred"), F.col("row.cross_entropy")
    n = F.greatest(F.col("row.n_letters"), F.lit(1))
    held = held.withColumn("length", F.floor(F.log2(n) / 2))
    good = held.where(F.col("calibrate") & (F.col("row.lang") == pred)).select(pred.alias("of"), F.col("length").alias("size"), bits.alias("bits"))
    high = F.percentile_approx("bits", quantile, 10_000)
    # a row per language and length class at most, and a row per language
    limits = good.groupBy("of", "size").agg(high.alias("limit"))
    whole = good.groupBy(F.col("of").alias("any")).agg(high.alias("whole"))
    held = held.join(F.broadcast(limits), (pred == F.col("of")) & (F.col("length") == F.col("size")), "left").join(F.broadcast(whole), pred == F.col("any"), "left")
    above = bits > F.coalesce("limit", "whole") + spread + least / F.sqrt(n)
    return held.select("row.*", ((pred == "und") | F.coalesce(above, F.lit(False))).alias("rejected"))
