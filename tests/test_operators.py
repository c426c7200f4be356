import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loam.operators import chunk, conversation, crawl, items, ledger, links, replay, vectors, xhr
from loam.sources import dom, sitemap, snapshots


def test_limiter_steps(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=s), "g") for i, s in enumerate((0, 10, 20, 60, 60.001))]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, k string")
    got = {r["event_id"]: r["allowed"] for r in replay.rate_limit(df, "k", 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True}


def test_cache_ttl(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + timedelta(seconds=s), "q") for i, s in enumerate((0, 6, 12))], "event_id bigint, ts timestamp, k string")
    assert [r["hit"] for r in replay.cache_replay(df, "k", 10).orderBy("event_id").collect()] == [False, True, False]


def test_lru(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + timedelta(seconds=i), "s", k) for i, k in enumerate("abacbc")], "event_id bigint, ts timestamp, s string, k string")
    assert [r["hit"] for r in replay.lru_replay(df, "s", "k", 2).orderBy("event_id").collect()] == [False, False, True, False, False, True]


def test_streams_equal_batch(spark, tmp_path):
    from loam.streaming import limits

    rng = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=10 * i + rng.random()), rng.choice("abc")) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, k string")
    for n in range(3):
        df.where(f"event_id >= {n * 20} and event_id < {(n + 1) * 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for i, (stream, batch) in enumerate(((lambda e: limits.limit_stream(e, "k", 2, 120), replay.rate_limit(df, "k", 2, 120)), (lambda e: limits.cache_stream(e, "k", 90), replay.cache_replay(df, "k", 90)))):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream(source).writeStream.format("memory").queryName(f"out{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"out{i}").collect())) == sorted(map(tuple, batch.collect()))


def test_splitter():
    assert chunk.split_text(None) == [] and chunk.split_text("") == [] and chunk.split_text("short") == ["short"]
    text = "\n\n".join("word " * n for n in (100, 300, 20, 250, 1))
    out = chunk.split_text(text)
    assert all(len(c) <= chunk.SIZE for c in out) and len(out) > 2
    assert all(len(c) <= 50 for c in chunk.split_text("x" * 500, 50, 10)) and chunk.split_text("aaa bbb ccc", 7, 3) == ["aaa bbb", "ccc"] and chunk.split_text("aaa bbb ccc", 8, 4) == ["aaa bbb", "bbb ccc"]
    for seed in range(40):
        rng = random.Random(seed)
        t = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "x" * 30]) for _ in range(300))
        got = chunk.split_text(t, 60, 15)
        assert all(0 < len(c) <= 60 for c in got)
        assert "".join("".join(got).split()).count("w") >= t.count("w")


def test_fragments():
    assert list(xhr.fragments(["abcdefg"] * 51)) == []
    assert len(list(xhr.fragments({f"k{i}": "letters" for i in range(51)}))) == 50
    assert list(xhr.fragments("12345 a")) == [] and list(xhr.fragments("ab")) == ["ab"]
    assert list(xhr.fragments({"a": [1, {"b": "some  text"}]})) == ["a > #2 > b: some text"]
    assert list(xhr.fragments("a" * 401)) == ["a" * 400 + "..."]


def test_xhr_first_response_counts(spark):
    df = spark.createDataFrame([(1, [("u", 500, "{}"), ("u", 200, "{}"), ("v", 200, "[]"), ("x/i18n", 200, "{}")])], "page_id bigint, xhr_responses array<struct<url:string,status:int,data:string>>")
    assert [(r["url"], r["pos"]) for r in xhr.accepted(df).collect()] == [("v", 2)]
    items_ = spark.createDataFrame([(1, [("u", 200, json.dumps({"results": [{"title": "t", "date": "2024-01-01"}, 3], "list": ["x"]}))])], df.schema)
    assert [tuple(r)[2:] for r in xhr.item_rows(items_).collect()] == [(1, "t", "2024-01-01")]


def test_ledger_runs(spark):
    run = spark.createDataFrame([("u1", "a\nb"), ("u2", "c"), ("u3", "d\n \ne")], "url string, text string")
    none = spark.createDataFrame([], "url string, content_hash string, deleted boolean, version int")
    plan = ledger.page_plan(run, none)
    assert {r["status"] for r in plan.collect()} == {"NEW"}
    merged = ledger.merge_pages(plan, none)
    assert {r["version"] for r in merged.collect()} == {1}
    again = ledger.page_plan(run, merged)
    assert {r["status"] for r in again.collect()} == {"UNCHANGED"}
    assert sorted(map(tuple, ledger.merge_pages(again, merged).collect())) == sorted(map(tuple, merged.collect()))
    chunks = ledger.line_chunks(run)
    assert ledger.to_embed(chunks, chunks).count() == 0 and ledger.stale(chunks, chunks).count() == 0
    tail = ledger.line_chunks(spark.createDataFrame([("u1", "a"), ("u2", "c")], "url string, text string"))
    assert ledger.to_embed(tail, chunks).count() == 0 and ledger.stale(tail, chunks).count() == 1
    head = ledger.line_chunks(spark.createDataFrame([("u1", "z\na\nb")], "url string, text string"))
    assert ledger.to_embed(head, chunks).count() == 3 and ledger.stale(head, chunks).count() == 2


def test_link_database_order(spark):
    L = "link_id bigint, link_type string, url string, text string"
    ls = spark.createDataFrame([(1, "internal", "A", "k x"), (2, "internal", "B", "K  x"), (3, "pdf", "h/f.pdf", None)], L)
    pages = spark.createDataFrame([], "page_id bigint, url string, title string")
    pdfs = spark.createDataFrame([], "pdf_id bigint, url string, title string")
    got = {r["key"]: (r["first"]["b"], r["url"]) for r in links.link_database(ls, pages, pdfs).collect()}
    assert got["page_k_x"] == (1, "B") and got["pdf_f"] == (3, "h/f.pdf")


def test_source_order(spark):
    hits = spark.createDataFrame([(1, i, s, p) for p, (i, s) in enumerate(((1, 0.55), (2, 0.50), (3, 0.80), (4, 0.60), (5, 0.60), (6, 0.49)), 1)], "q_id bigint, vec_id bigint, score double, place bigint")
    docs = spark.createDataFrame([(1, "u1", "t", "x"), (2, "u2", "t", "x"), (3, "u1", "t", "x"), (4, "", "t", "x"), (5, "", "t", None), (6, "u3", "t", "x")], "doc_id bigint, url string, title string, text string")
    got = [(r["url"], r["score"]) for r in vectors.sources(hits, docs, 0.5).orderBy("rank").collect()]
    assert got == [("", 0.6), ("", 0.6), ("u1", 0.55), ("u2", 0.5)]


def test_top_k_blocks(spark, monkeypatch):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)] + [(99, None)], "vec_id bigint, embedding array<double>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    a = sorted(map(tuple, vectors.top_k(v, q, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    assert a == sorted(map(tuple, vectors.top_k(v, q, 3).collect())) and len(a) == 24
    assert vectors.top_k(v, q.limit(0), 3).count() == 0


def test_lsh_radius_grows(spark):
    rng = random.Random(4)
    planes = vectors.planes(6, 4)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "vec_id bigint, embedding array<double>").withColumn("sig", vectors.signature(F.col("embedding"), planes))
    q = v.where("vec_id < 5").select(F.col("vec_id").alias("q_id"), "sig")
    sizes = [vectors.near(q, v, 6, r).count() for r in (0, 1, 2)]
    assert sizes[0] <= sizes[1] <= sizes[2]


def test_history(spark):
    t0 = datetime(2024, 1, 1)
    m = spark.createDataFrame([("s", i, t0 + timedelta(seconds=i), ["ADMIN", "System", None][i % 3], f" m{i} ") for i in range(32)], "session_id string, msg_id bigint, at timestamp, role string, content string")
    assert [r["msg_id"] for r in conversation.recent(m).orderBy("place").collect()] == list(range(2, 32))
    assert conversation.prompt_history(m).first()["history"].split("\n")[0] in ("User: m22", "Assistant: m22")
    assert [r["x"] for r in m.select(conversation.role(F.col("role")).alias("x")).limit(3).collect()] == ["user", "system", "user"]


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "B/"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "x"), (None, "q")], "source string, target string")
    seeds = spark.createDataFrame([("A",)], "url string")
    banned = spark.createDataFrame([("X/",)], "url string")
    assert {tuple(r) for r in crawl.crawl(edges, seeds, 2, banned).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_sitemaps(spark):
    files = spark.createDataFrame([("r", "<sitemapindex><sitemap><LOC> a.xml </LOC></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"), ("a.xml", "<urlset><url><loc>u1</loc><lastmod> 2024-01-01 </lastmod></url><url><x/></url><url><loc>u2</loc></url></urlset>")], "url string, xml string")
    assert {tuple(r) for r in sitemap.tree(files, spark.createDataFrame([("r",)], "url string")).collect()} == {("u1", "2024-01-01"), ("u2", None)}


def test_dom(spark):
    html = "<html><head><title>T &amp; x</title><meta name=Description content='d'></head><body><h1>Head</h1><p>A paragraph that is long enough to keep.<p>short</p><ul><li>an item that is long</li><li>no</li></ul><table><tr><td>a</td><th>b</th></tr></table><a href='/x'>go</a><footer>gone and long enough to be kept otherwise</footer>"
    title, desc, _, heads, blocks, tables, lists, hrefs = dom.read_page(html)
    assert (title, desc, heads, tables, lists, hrefs) == ("T & x", "d", [(1, "Head", None)], [[["a", "b"]]], [["an item that is long"]], [("/x", "go")])
    assert any("long enough to keep" in b for b in blocks) and not any("gone" in b for b in blocks)
    df = spark.createDataFrame([(1, html), (2, None), (3, "<<<p>")], "id bigint, html string")
    assert dom.extract(df, "id", "html").count() == 3


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"timestamp": "t1"}, "pages": [{"url": "u", "headings": []}], "links": {"pdf": [{"url": "p"}]}}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("{}")
    snaps = snapshots.read_snapshots(spark, str(tmp_path))
    assert {r["file"]: (r["pages"], r["pdf"]) for r in snapshots.summary(snaps).collect()} == {"a.json": (1, 1), "c.json": (0, 0)}
    assert snapshots.latest(snaps).first()["file"] == "c.json"


def test_pushdown_and_shuffles(spark, tiny):
    """Scans read only what they need, and counts combine before the shuffle."""
    df = links.page_link_stats(spark.read.parquet(f"{tiny}/links.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(source_url)" in plan and "context" not in plan.split("ReadSchema")[1][:200]
    assert plan.count("HashAggregate") == 2
    assert items.LEAST_TEXT == 100


def test_global_places(spark):
    from loam.operators.ranking import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("n").alias("n")).repartition(7)
    got = numbered(df, [F.desc("x")], "place").collect()
    assert sorted((r["place"], r["x"]) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
