import sys

import pytest
from pyspark.sql import functions as F

from loam.llm import tokenize

sys.path.append("/opt/tokenizers/..")
HARD = ["", None, " ", "\n\n  x", "don't  stop'll", "a" * 1000, "अनुवाद 12.5 का", "naïve ½ Ⅷ 😀​　x", "tab\t \tend  ", "<|endoftext|>", "x  y z", "é" * 300, "'S 's", "1 22 333", "a  \n b", "a \n  b   c", "x\n   y", " \t z", "a\n b", "\u001c\u001d a"]


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pub = pytest.importorskip("public_tokenizers")
    return tiktoken.Encoding("own", pat_str=pub.PATTERN, mergeable_ranks=tokenize.load_ranks(tokenize.VOCABULARY), special_tokens={})


def test_same_as_public_encoder(spark, tiny):
    enc = reference()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string").unionByName(spark.read.parquet(f"{tiny}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    got = tokenize.encode(docs, "doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


def test_rare_chunks_are_joined(spark):
    """Chunks that are not broadcast give the same ids, also in repeated rows, and other columns are kept."""
    docs = spark.createDataFrame([(i % 15, t, f"s{i}") for i, t in enumerate(HARD + HARD)], "doc_id bigint, text string, source string")
    get = lambda n: sorted((r["doc_id"], r["source"], r["ids"]) for r in tokenize.encode(docs, "doc_id", "text", hot_chunks=n, keep=("source",)).collect())
    every = get(1000)
    assert len(every) == 2 * len(HARD)
    for n in (1, 3, 20):
        assert get(n) == every


def test_long_words_equal_the_fold(spark):
    """Words on both sides of LONG_WORD bytes have the ids of the public encoder."""
    enc = reference()
    texts = ["ab" * (tokenize.LONG_WORD // 2 + d) for d in (-1, 0, 1, 40)] + ["x" + "é" * (tokenize.LONG_WORD // 2 + d) for d in (-1, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in tokenize.encode(docs, "doc_id", "text").collect():
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]])


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, word string, n int")
    assert tokenize.encode(docs, "doc_id", "text").collect() == []
    one = spark.createDataFrame([(1, "a b", "w", 2)], "doc_id bigint, text string, word string, n int")
    r = tokenize.encode(one, "doc_id", "text").first()
    assert r["ids"] == [64, 275]


def test_decode(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    for r in tokenize.encode(docs, "doc_id", "text").join(docs, "doc_id").withColumn("back", tokenize.decode(F.col("ids"))).collect():
        assert r["back"] == (r["text"] or "")
