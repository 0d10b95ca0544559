"""Pipeline stages on rows with clashing column names, shared ids, repeated rows, nulls and unlearnt languages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from riskloom.llm import bpe
from riskloom.llm import queries as q
from riskloom.llm.common import prepare

SF = "/root/testdata/sf0.001"
MINE = ["predicted", "score", "lang_pred", "cross_entropy", "n_letters", "rejected", "bad", "rid", "id", "md5", "row", "calibrate", "length", "of", "size", "n_tokens", "_keep"]


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents with columns of the user's own that are named like the stages' results."""
    given = prepare(spark).read.parquet(f"{SF}/documents.parquet")
    return given.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in MINE])


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[:4]])
def test_columns_of_the_users_own_stay_as_they_are(spark, docs, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) > 100 and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in MINE)


def test_tokens_replace_a_column_of_the_same_name(spark, docs):
    out = bpe.tokenize(docs.limit(3), *q.tokenizer())
    assert out.columns.count("n_tokens") == 1 and dict(out.dtypes)["n_tokens"] == "bigint"


def test_one_document_of_each_group_stays(spark):
    draw = random.Random(1)
    text = lambda: " ".join(f"w{draw.randrange(9999)}" for _ in range(60))
    a, b, c = text(), text(), text()
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(3, a), (1000, a), (1000, b), (1001, near), (5, c), (5, c), (7, None), (7, None), (None, b + " x"), (None, "alone here with some words"), (9, "")]
    got = cp.one_of_each_group(spark, prepare(spark).createDataFrame(rows, "doc_id bigint, text string"), SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, a), (1000, b), (5, c), (7, None), (None, "alone here with some words"), (9, "")], key=str)


def test_unlearnt_languages_go_and_clean_documents_stay(spark):
    given = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    draw = random.Random(2)
    odd = [(900_000 + i, " ".join("".join(draw.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(60 + i)), None) for i in range(12)]
    out = {r.doc_id for r in cp.known_language(spark, given.unionByName(spark.createDataFrame(odd, given.schema)), SF).select("doc_id").collect()}
    assert not out & {i for i, _, _ in odd} and len(out) >= 0.995 * given.count()
