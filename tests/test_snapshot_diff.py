from datetime import datetime

from loam.operators import snapshot_diff as sd


def tables(spark, snaps, pages, pdfs=()):
    s = spark.createDataFrame(snaps, "snapshot_id int, taken_at timestamp")
    p = spark.createDataFrame(pages, "page_id bigint, snapshot_id int, url string, ts timestamp, content string, change string")
    f = spark.createDataFrame(list(pdfs), "pdf_id bigint, snapshot_id int, url string, ts timestamp, text string")
    return s, p, f


def t(n):
    return datetime(2024, 1, n)


def test_classes(spark):
    # taken_at, not the id, orders snapshots: 1, 3, 2.
    pages = [
        (1, 1, "HTTPS://a/x/#top", t(1), "one", "z"),
        (2, 3, "https://a/x", t(2), "one  ", "z"),
        (3, 3, "https://a/y//", t(2), None, "z"),
        (4, 2, "https://a/y", t(3), " ", "z"),
        (5, 2, "https://a/x", t(3), "old", "z"),
        (6, 2, "https://a/x", t(4), "two", "z"),
        (7, 2, "https://a/x", t(4), "two", "z"),
        (8, 2, None, t(4), "lost", "z"),
        (9, None, "https://a/q", t(4), "lost", "z"),
        (10, 99, "https://a/q", t(4), "unlisted", "z"),
    ]
    got = sd.snapshot_changes(*tables(spark, [(1, t(1)), (2, t(9)), (3, t(5))], pages))
    assert {tuple(r)[:4] for r in got.collect()} == {(3, "page", "https://a/y", "added"), (2, "page", "https://a/x", "changed")}
    assert [r["changed_fields"] for r in got.where("change = 'changed'").collect()] == [["content"]]


def test_removed_and_kinds(spark):
    got = sd.snapshot_changes(*tables(spark, [(1, t(1)), (2, t(2))], [(1, 1, "u", t(1), "a", "z")], [(1, 2, "u", t(2), "a")]))
    assert {tuple(r)[:4] for r in got.collect()} == {(2, "page", "u", "removed"), (2, "pdf", "u", "added")}


def test_empty(spark):
    assert sd.snapshot_changes(*tables(spark, [], [])).collect() == []
