"""The queries of this package and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, chat, decontaminate, fingerprint, jaccard, langid, license_scan, manifest, repeats, runs, shards, toxicity, warc
from riskloom.llm.common import materialise, read
from riskloom.llm.twins import ORACLES as ORACLES

RUNS = dict[str, Callable[[SparkSession, str], DataFrame]]


def remainder(parts: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    got = decontaminate.contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    learns = remainder(4) != 2
    calibrates = langid.calibrates(F.col("doc_id"))
    model = langid.fit(documents.where(learns & ~calibrates))
    held = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    rows = documents.select("doc_id", held, F.when(learns, F.col("lang")).alias("lang"), "text")
    scored = materialise(langid.predict(rows, model).drop("text"), "languages")
    return langid.reject(scored, calibrates & F.col("lang").isNotNull()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    model = toxicity.fit(documents, read(spark, folder, "labels"), remainder(3) != 1)
    held = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return toxicity.score(documents.select("doc_id", held, "text"), model).select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    _, records = warc.archive_and_read(read(spark, folder, "pages"))
    records = materialise(records.drop("payload"), "records")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, folder, "documents"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(read(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "class_size")


def op7_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    got = chat.rotate(read(spark, folder, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ",")
    return got.select("conv_id", "perspective", "part", F.col("n_turns").cast("long").alias("n_turns"), "starts_at", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"), spans.alias("mask_spans"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files ``source/doc_id div 500/doc_id div 50/fN.txt``; every third one is a licence file of a directory
    above: of the source if its id is divisible by 30, of a block of 500 ids otherwise."""
    id_ = F.col("doc_id")
    block = F.concat_ws("/", F.col("source"), F.floor(id_ / 500).cast("string"))
    notice = F.concat(F.lit("LICENSE-"), id_.cast("string"))
    path = (
        F.when(id_ % 30 == 0, F.concat_ws("/", "source", notice)).when(id_ % 3 == 0, F.concat_ws("/", block, notice))
        .otherwise(F.concat_ws("/", block, F.floor(id_ / 50).cast("string"), F.concat(F.lit("f"), id_.cast("string"), F.lit(".txt"))))
    )
    files = read(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    own = materialise(license_scan.scan(files, license_scan.FORMS, window=license_scan.WINDOW), "own_licences")
    got = license_scan.inherit(files.select("doc_id", "path"), own)
    return got.select("doc_id", "path", "license", F.round("score", 6).alias("score"), "inherited_license", "inherited_from")


def tokenizer() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    got = bpe.tokenize(read(spark, folder, "documents").select("doc_id", "text"), *tokenizer())
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    got = shards.byte_shards(read(spark, folder, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def repeating(doc_id: F.Column, text: F.Column) -> F.Column:
    """The text; where 10 divides its id's checksum, with the words from some place on repeating with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(w: F.Column) -> F.Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(w, (source(i) + 1).cast("int"))), " ")).otherwise("")

    # a lambda's variable is evaluated once, a column repeated in an expression may not be
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda x: x != "")
    return F.when((h % 10 == 0) & text.isNotNull(), F.transform(F.array(words), planted)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    got = runs.detect(documents)
    ahead = lambda x, y: F.coalesce(x["length"] * y["period"] > y["length"] * x["period"], F.lit(False))
    # runs are ordered by start and period, so of equal exponents the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(ahead(x, best), x).otherwise(best))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    got = got.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return got.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    text = F.col("text")
    leaf = lambda t: manifest.digest(*(manifest.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)))
    tampered = F.when(remainder(5) == 0, leaf(manifest.lower_ascii(text))).otherwise(F.col("leaf"))
    leaves = documents.select("doc_id", "source", "lang", "n_chars", "text", leaf(text).alias("leaf")).select("doc_id", "source", "leaf", tampered.alias("tampered"))
    got = manifest.prove(leaves, "source", "doc_id", "leaf")
    folded = manifest.fold(F.col("row.tampered"), F.col("places"), F.col("siblings"))
    proof = F.sha2(F.array_join("siblings", "").cast("binary"), 256)
    out = got.select("row.doc_id", "row.leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    got = repeats.dedup(read(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return got.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: RUNS = {
    f.__name__: f
    for f in (op1_decontamination, op2_language_id, op3_toxicity, op4_warc, op5_fingerprints, op6_jaccard_join, op7_chat_perspectives, op8_license_scan, op9_byte_bpe, op10_byte_shards, op11_periodic_runs, op12_merkle_manifest, op13_repeated_bytes, pipeline)
}
