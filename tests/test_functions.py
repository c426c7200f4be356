from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loam.functions import categories, dates, text, urls
from loam.operators import vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "got,want",
    [
        (lambda: text.query_key(F.lit("  What IS  the CSE-branch?!")), "what is the csebranch"),
        (lambda: text.short_hash(text.query_key(F.lit("  What IS  the CSE-branch?!"))), "d4152a7135bbb561398914ea7599ecc7"),
        (lambda: text.query_key_nfkc(F.lit("ＡＢＣ１")), "abc1"),
        (lambda: text.query_key_nfkc(F.lit("ﬁle № 5")), "file no 5"),
        (lambda: text.query_key(F.lit("a b")), "a b"),
        (lambda: text.query_key(F.lit("Please tell me about the fees"), True), "fees"),
        (lambda: text.chunk_id(F.lit("u"), F.lit(3), F.sha2(F.lit("t"), 256)), "0bfe935e70c3:0003:e3b98a4da3"),
        (lambda: F.split(text.chunk_id(F.lit("u"), F.lit(12345), F.lit("abc")), ":")[1], "12345"),
        (lambda: text.word_count(F.lit("  a\nb")), 2),
        (lambda: text.word_count(F.lit(None).cast("string")), 0),
        (lambda: text.space_pieces(F.lit("a  b")), 3),
        (lambda: text.trim_ws(F.lit("  x y﻿\n")), "x y"),
        (lambda: urls.url_key(F.lit("HTTPS://A.example/B//#Top/")), "https://a.example/b"),
        (lambda: urls.site(F.lit("https://User@A.Example:80/x")), "a.example"),
        (lambda: urls.site(F.lit("not a url")), None),
        (lambda: urls.first_segment(F.lit("https://h/Academic/x")), "academic"),
        (lambda: urls.pdf_key(F.lit("https://h/A.pdf?x=1#p")), "https://h/a.pdf"),
        (lambda: urls.link_type(F.lit("https://h/a.PDF"), "h"), "pdf"),
        (lambda: urls.link_type(F.lit("https://h/a.jpg"), "h"), "image"),
        (lambda: urls.link_type(F.lit("https://g/a"), "h/"), "external"),
        (lambda: urls.is_valid(F.lit("https://h.example/a.css?x"), "h.example"), False),
        (lambda: urls.is_valid(F.lit("https://h.example/a"), "h.example"), True),
        (lambda: urls.is_valid(F.lit(None).cast("string"), "h.example"), False),
        (lambda: categories.category(F.lit("https://h/Academic/x"), F.lit("")), "academics"),
        (lambda: categories.category(F.lit("https://h/Tenders"), F.lit("")), "tender"),
        (lambda: categories.category(F.lit("https://h/foo"), F.lit("A course and a tender")), "academics"),
        (lambda: categories.category(F.lit("https://h/foo"), F.lit("éacademic")), "academics"),
        (lambda: categories.category(F.lit(None).cast("string"), F.lit(None).cast("string")), "general"),
        (lambda: categories.pdf_category(F.lit("https://h/Uploads/recruitments/a.pdf")), "notices"),
        (lambda: dates.months_ago(F.lit("2024-03-31").cast("timestamp"), F.lit(1)).cast("string"), "2024-03-02"),
        (lambda: dates.months_ago(F.lit("2023-03-31").cast("timestamp"), F.lit(1)).cast("string"), "2023-03-03"),
        (lambda: dates.months_ago(F.lit("2024-05-31").cast("timestamp"), F.lit(1)).cast("string"), "2024-05-01"),
        (lambda: dates.item_date(F.lit("1700000000")), datetime(2023, 11, 14, 22, 13, 20)),
        (lambda: dates.item_date(F.lit("1700000000000")), datetime(2023, 11, 14, 22, 13, 20)),
        (lambda: dates.item_date(F.lit("nonsense")), None),
        (lambda: vectors.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))), 0.0),
    ],
)
def test_scalar(spark, got, want):
    assert one(spark, got()) == want


def test_planes():
    draw = vectors.uniform(1)
    assert [round(draw(), 10) for _ in range(3)] == [0.6270739406, 0.0027357212, 0.5274470400]
    assert vectors.plane_seed("resp:v1", "cohere:embed-english-v3.0:1024", 64) == 2908389639
    assert round(vectors.gaussian(vectors.uniform(2908389639)), 10) == 1.3748662384
    assert [len(vectors.masks(16, r)) for r in (0, 1, 2, 3)] == [1, 17, 137, 137]
