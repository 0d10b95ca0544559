"""Corpus pipeline: toxic documents, documents in no known language, near copies and contaminated documents go; the rest
is tokenized. Each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, jaccard, langid, toxicity
from riskloom.llm.common import materialise, prepare, read
from riskloom.llm.queries import remainder, tokenizer


def packed(docs: DataFrame, *needed: str | Column) -> DataFrame:
    """The rows as one column beside those that a stage works on, so that no name of a stage's can clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *needed)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder(3) != 1)
    return toxicity.score(packed(docs, "text"), model).where(F.col("predicted") == 0).select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    learns = remainder(4) != 2
    calibrates = langid.calibrates(F.col("doc_id"))
    model = langid.fit(docs.where(learns & ~calibrates).select("lang", "text"))
    scored = materialise(langid.predict(packed(docs, "doc_id", "lang", "text"), model).drop("text"), "languages")
    return langid.reject(scored, learns & calibrates & F.col("lang").isNotNull()).where(~F.col("rejected")).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class (of least checksum among equal ids, null ids last); of repeated rows one
    stays; null texts, which are in no class, stay."""
    prepare(spark)
    groups = materialise(jaccard.join(docs.select("doc_id", "text")).select("doc_id", "class_key", "text_md5"), "groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5")
    stays = groups.where("class_key is not null").groupBy("class_key").agg(F.min(rank).alias("least"))
    stays = materialise(stays.select(F.col("least.doc_id").alias("id"), F.col("least.text_md5").alias("md5")), "stays")
    rows = packed(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5("text") == F.col("md5"))
    kept = rows.where("text is not null").join(stays, same, "left_semi").unionByName(rows.where("text is null"))
    if groups.groupBy("doc_id", "text_md5").count().where("count > 1").isEmpty():
        return kept.select("row.*")
    return kept.dropDuplicates(["doc_id", "text"]).select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontaminate.contamination(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = found.where("contaminated").select(F.col("rid").alias("bad")).distinct()
    rows = packed(docs, F.xxhash64("doc_id", "text").alias("rid"))
    return rows.join(bad, F.col("rid") == F.col("bad"), "left_anti").select("row.*")


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.tokenize(docs.select("doc_id", "text"), *tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("byte_bpe", tokenized),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
