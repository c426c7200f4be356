"""Operators of link answers, files, crawls, ledgers and codecs against small cases and brute force."""

import gzip
import json
import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from loam.functions import codec, dates, language, urls
from loam.operators import crawl, files, items, ledger, links, matching, response_cache, shred, vectors, xhr
from loam.sources import sitemap, snapshots


def test_contained_brute(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    hays = [(i, word(rng.randint(0, 40))) for i in range(60)] + [(90, None), (91, "the hay of the needle"), (91, "the hay of the needle")]
    needles = [(f"n{i}", word(rng.randint(0, 12))) for i in range(80)] + [("long", "the hay of the n"), ("none", None), ("too", "the hay of the needle and more")]
    got = matching.contained(spark.createDataFrame(hays, "h_id int, hay string"), spark.createDataFrame(needles, "n_id string, needle string"))
    want = {(h, n) for h, a in hays for n, b in needles if a is not None and b and b in a}
    assert {tuple(r) for r in got.collect()} == want and ("long" in {n for _, n in want})
    assert matching.contained(spark.createDataFrame([], "h_id int, hay string"), spark.createDataFrame(needles, "n_id string, needle string")).count() == 0
    assert matching.contained(spark.createDataFrame(hays, "h_id int, hay string"), spark.createDataFrame([], "n_id string, needle string")).count() == 0


def test_match_links_brute(spark):
    """The three conditions, empty texts and empty questions, first in order."""
    rng = random.Random(8)
    words = ["fee", "hostel fee", "Library", "exam", "", "hours of the library", "a very long title of a page"]
    links = [(f"k{i}", i, rng.choice(words), rng.choice(["notices", "tender", None, ""])) for i in range(40)]
    asked = [(1, "hostel FEE of the year"), (2, "hours"), (3, "new tender today"), (4, ""), (5, None), (6, "zzz")]
    df = spark.createDataFrame(links, "key string, n int, text string, category string").withColumn("first", F.struct("n")).drop("n")
    got = {}
    for r in matching.match_links(spark.createDataFrame(asked, "q_id int, question string"), df).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = r["key"]
    for q, text in asked:
        want = [] if text is None else [k for k, _, t, c in links if text.lower() in t.lower() or t.lower() in text.lower() or (c and c in text.lower())][:5]
        assert got.get(q, {}) == dict(enumerate(want, 1)), q


def test_link_sources(spark):
    db = spark.createDataFrame([("k1", "pdf", "u1", "A", "ctx"), ("k2", "pdf_document", "u2", "B", "")], "key string, type string, url string, text string, context string")
    matched = spark.createDataFrame([(1, "k1", 1), (1, "k2", 2)], "q_id bigint, key string, rank bigint")
    linked = vectors.link_sources(matched, db)
    assert {(r["url"], r["text"], r["score"], r["source"]) for r in linked.collect()} == {("u1", "ctx", 0.8, "pdf"), ("u2", "B", 0.8, "pdf_document")}
    hits = spark.createDataFrame([(1, 7, 0.55, 1)], "q_id bigint, vec_id bigint, score double, place bigint")
    docs = spark.createDataFrame([(7, "u1", "t", "x")], "doc_id bigint, url string, title string, text string")
    # The link to u1 loses to the document found before it, in spite of its score.
    got = [(r["url"], r["score"]) for r in vectors.sources(hits, docs, 0.5, linked).orderBy("rank").collect()]
    assert got == [("u2", 0.8), ("u1", 0.55)]
    lines = matching.links_text(matched, db).first()["text"].split("\n")
    assert lines[1:] == ["• A: u1 (PDF Document)", "• B: u2 (Web Page)"]


def test_captured_files(spark):
    body = {
        "data": [
            {"link": "/uploads/tender/a.pdf", "title": " Tender A ", "date": "bad", "created_at": 1706000000},
            {"file": {"href": "b.PDF"}, "name": "B", "notification_for": ["Notice"], "time": "2023-01-01"},
            {"url": "x.html"},
            "text",
            {"document": "https://o.example/c.pdf", "description": "words of it"},
        ]
    }
    rows = [(1, "https://h.example/p/q", [("u", 200, None, json.dumps(body)), ("u", 200, None, json.dumps(body)), ("v", 500, None, json.dumps(body))]), (2, "https://h.example/", None), (3, None, [("w", 200, None, "{bad")])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, xhr_responses array<struct<url:string,status:int,captured_at:timestamp,data:string>>")
    got = {r["url"]: r for r in files.captured_files(pages, F.lit("2024-02-15").cast("timestamp")).collect()}
    assert set(got) == {"https://h.example/uploads/tender/a.pdf", "https://o.example/c.pdf"}  # b is an old notice
    a, c = got["https://h.example/uploads/tender/a.pdf"], got["https://o.example/c.pdf"]
    assert (a["title"], a["category"], a["published_at"], a["n"]) == ("Tender A", "tender", datetime(2024, 1, 23, 8, 53, 20), 1)
    assert (c["title"], c["text"], c["word_count"], c["published_at_source"]) == ("c.pdf", "words of it", 3, None)


def test_first_date():
    assert xhr.first_date({"time": "", "date": "soon", "idate": True, "created_at": "2024-01-02"}) == "2024-01-02"
    assert xhr.first_date({"time": 1e300, "date": "1706000000"}) == "1706000000" and xhr.first_date({}) is None


def test_recent(spark):
    rows = [("Tender", "2023-08-16"), ("Tender", "2023-08-14"), ("NOTIFICATION", "2024-01-14"), ("news", "2001-01-01"), ("tender", None), (None, "2001-01-01")]
    df = spark.createDataFrame(rows, "c string, d string").select(dates.is_recent(F.col("d").cast("timestamp"), F.col("c"), F.lit("2024-02-15").cast("timestamp")).alias("r"))
    assert [r["r"] for r in df.collect()] == [True, False, False, True, True, True]


def test_resolve_and_lists(spark):
    cases = [("https://h.example/a/b", "c", "https://h.example/a/c"), ("https://h.example/a/b", "/C?x", "https://h.example/C?x"), ("https://h.example", "https://o.example", "https://o.example/"), (None, "c", None), ("https://h.example/", None, None), ("https://h.example/", "http://[bad", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r["x"] for r in df.select(urls.resolve(F.col("a"), F.col("b")).alias("x")).collect()] == [c for _, _, c in cases]
    assert spark.range(1).select(urls.input_list(F.lit(" a, ,b,")).alias("x")).first()["x"] == ["a", "b"]


def test_language_and_codec(spark):
    df = spark.createDataFrame([("HINDI", " Change Language "), ("x", "हाँ"), (None, None)], "l string, m string")
    got = df.select(language.language(F.col("l")).alias("l"), language.is_change_request(F.col("m")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("hindi", True), ("english", False), ("english", False)]
    held = {"a": {"english": "{0} of {1} {2}"}}
    assert spark.range(1).select(language.message(held, F.lit("a"), F.lit("hindi"), F.lit(3), F.lit(None).cast("int")).alias("x")).first()["x"] == "3 of {1} {2}"
    assert spark.range(1).select(language.message(held, F.lit("zz"), F.lit("hindi")).alias("x")).first()["x"] == ""
    bad = spark.createDataFrame([("!!",), ("YWI=",), (None,), ("AACAPw==",)], "t string").select(codec.decode_vector(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in bad] == [None, None, None, [1.0]]


def test_crawl_budget_brute(spark):
    rng = random.Random(3)
    names = [f"https://h.example/{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names + ["https://H.example/3/"]), i) for i in range(150)] + [(None, "x", 999)]
    seeds, first, banned = [(names[0], 1), (names[1], 2)], [(names[5], 1)], [(names[7],)]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    for depth, most in ((3, 1000), (3, 9), (0, 5), (9, 14)):
        got = crawl.budgeted(df(edges, "source string, target string, ord int"), df(seeds, "url string, ord int"), depth, most, df(first, "url string, ord int"), df(banned, "url string"))
        key = lambda u: u.lower().rstrip("/")
        queue, seen, want = [(key(u), 0) for u, _ in first + seeds], set(), []
        while queue and len(want) < most:
            u, d = queue.pop(0)
            if u in seen or u == names[7]:
                continue
            seen.add(u)
            want.append((u, d, len(want) + 1))
            if d < depth:
                queue += [(key(t), d + 1) for s, t, _ in edges if s is not None and key(s) == u]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want, (depth, most)


def test_sitemap_files(spark, tmp_path):
    """Packed files, bare locations, a long chain and a circle of index files, an unreadable file."""
    index = lambda *us: "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in us) + "</sitemapindex>"
    chain = [(f"i{k}", index(f"i{k + 1}", "i0")) for k in range(14)] + [("i14", "<urlset><loc>bare1</loc> <loc>bare2</loc></urlset>")]
    got = sitemap.tree(spark.createDataFrame(chain, "url string, xml string"), spark.createDataFrame([("i0",)], "url string"))
    assert {tuple(r) for r in got.collect()} == {("bare1", None), ("bare2", None)}
    (tmp_path / "a.xml").write_text("<urlset/>")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress("<urlset>é</urlset>".encode()))
    (tmp_path / "c.xml.gz").write_bytes(b"\x1f\x8bbroken")
    assert {r["xml"] for r in sitemap.read_files(spark, str(tmp_path)).collect()} == {"<urlset/>", "<urlset>é</urlset>"}


def test_parse_deep():
    rng = random.Random(4)

    def make(d):
        k = rng.random()
        if d > 5 or k < 0.3:
            return rng.choice([None, True, 1.5, -3, "a\"\\ué", "", 1e20, 0])
        return [make(d + 1) for _ in range(rng.randint(0, 3))] if k < 0.65 else {f"k{i}": make(d + 1) for i in range(rng.randint(0, 3))}

    for _ in range(200):
        text = json.dumps(make(0), indent=rng.choice([None, 1]))
        assert shred.parse_deep(text) == json.loads(text)
    for bad in ("", "[", "[1,]", "{", '{"a"}', '{"a":1,}', "1 2", "nul", "[1}", '{1:2}', "NaN", '"a', "01x"):
        try:
            shred.parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert shred.parse("[" * 200_000 + "]" * 200_000)[0] and not shred.parse("[" * 200_000)[0]


def test_response_cache_models(spark):
    planes = vectors.planes(4, 2)
    at = datetime(2024, 1, 1)
    made = [(1, [1.0, 0.0], "a", ["s"], 0.9, "english", at, "m1"), (2, [1.0, 0.0], "b", ["s"], 0.9, "english", at, "m2")]
    cache = response_cache.put(spark.createDataFrame(made, "item_id bigint, embedding array<double>, text string, sources array<string>, confidence double, language string, created_at timestamp, model_key string"), planes)
    asked = spark.createDataFrame([(1, [1.0, 0.1], "english", "m2"), (2, [1.0, 0.1], "english", "m3")], "q_id bigint, embedding array<double>, language string, model_key string")
    got = response_cache.look_up(asked, cache, planes, F.lit(at)).collect()
    assert [(r["q_id"], r["item_id"]) for r in got] == [(1, 2)]
    ids = cache.select(response_cache.item_id(F.col("embedding"), F.col("text")).alias("i")).distinct().collect()
    assert len(ids) == 2 and all(len(r["i"]) == 32 for r in ids)


def test_page_ledger(spark):
    now = spark.createDataFrame([("new", "a\nb"), ("same", "a"), ("less", "a"), ("more", "a\nz")], "url string, text string")
    old = spark.createDataFrame([("same", "a"), ("less", "a\nb"), ("more", "a"), ("gone", "q")], "url string, text string")
    h = F.sha2("text", 256)
    rows = now.withColumn("type", F.lit("page")).withColumn("title", F.lit("t")).withColumn("category", F.lit("c")).withColumn("word_count", F.lit(1).cast("bigint"))
    held = old.select("url", F.lit("page").alias("type"), F.lit("o").alias("title"), F.lit("c").alias("category"), F.lit(1).cast("bigint").alias("word_count"), h.alias("content_hash"), F.lit(9).cast("bigint").alias("chunk_count"), F.lit("t0").alias("last_seen_at"), F.lit(False).alias("deleted"), F.lit(3).cast("bigint").alias("version"), F.lit("t0").alias("last_embedded_at"))
    plan = ledger.page_plan(now, held)
    got = {r["url"]: (r["version"], r["chunk_count"], r["last_seen_at"], r["last_embedded_at"], r["deleted"]) for r in ledger.page_rows(rows, plan, ledger.line_chunks(now), ledger.line_chunks(old), held, F.lit("t1"), F.lit("t2")).collect()}
    assert got == {"new": (1, 2, "t1", "t2", False), "same": (3, 9, "t1", "t0", False), "less": (4, 1, "t1", "t2", False), "more": (4, 2, "t1", "t2", False), "gone": (3, 9, "t0", "t0", False)}
    assert ledger.active(held.withColumn("deleted", F.col("url") == "gone")).count() == 3
    stamped = ledger.stamped_chunks(ledger.line_chunks(now), rows, F.lit("t1")).collect()
    assert {r["stored_at"] for r in stamped} == {"t1"} and stamped[0]["metadata"]["category"] == "c"


def test_virtual_items_and_snapshot_writer(spark, tmp_path, tiny):
    t = {n: spark.read.parquet(f"{tiny}/{n}.parquet") for n in ("pages", "pdfs", "links")}
    every = items.all_items(t["pages"], t["pdfs"], t["links"])
    kinds = {r["url"] for r in every.where("category = 'virtual'").collect()}
    assert kinds == {"virtual://links-directory", "virtual://statistics"}
    snapshots.write_snapshot(t["pages"], t["pdfs"], str(tmp_path / "s"), t["links"])
    told = spark.read.json(str(tmp_path / "s" / "statistics")).first()
    assert told["total_pages"] == t["pages"].count() and told["total_links"] == t["links"].count()
    folder = snapshots.write_files(t["pdfs"], str(tmp_path / "f"), 2)
    assert folder.endswith("v=2") and spark.read.json(folder).count() == t["pdfs"].count()


def test_sections(spark):
    rows = [(1, [("u", 200, datetime(2024, 1, 1), '{"a":"some words here"}'), (None, None, None, '[{"t":"more words"}]'), ("z", 200, None, "3")]), (2, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, xhr_responses array<struct<url:string,status:int,captured_at:timestamp,data:string>>")
    got = [tuple(r) for r in xhr.sections(pages).collect()]
    assert got == [(1, "XHR 1 (u | status 200 | 2024-01-01T00:00:00.000Z)\na: some words here\n\nXHR 2\n#1 > t: more words")]


def test_index_recall(spark, small):
    """The index of several tables finds the best vector of nine queries in ten, by brute force over all vectors."""
    from loam.plans import retrieval

    v = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = v.collect()
    m = np.array([r["embedding"] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sim = m @ m.T
    np.fill_diagonal(sim, -9)
    best = {rows[i]["vec_id"]: rows[j]["vec_id"] for i, j in enumerate(sim.argmax(1))}
    pairs = vectors.near_any(v, v, retrieval._PLANE_SETS, 1)
    found = {(r["q_id"], r["vec_id"]) for r in pairs.collect()}
    recall = sum((q, b) in found for q, b in best.items()) / len(best)
    assert recall >= 0.9, recall


def test_binary_files(spark, tmp_path):
    from loam.sources import binary

    for name, body in (("a.bin", b"two|text a"), ("b.bin", b"broken"), ("c.bin", b"x" * 100), ("d.bin", b"one|text d")):
        (tmp_path / name).write_bytes(body)

    def extract(c):
        head, text = c.decode().split("|")
        return text, {"one": 1, "two": 2}[head]

    def recognise(c):
        if c.startswith(b"one"):
            raise ValueError
        return " seen " if c.startswith(b"two") else ""

    got = {r["path"][-5:]: (r["text"], r["pages"], r["error"] is None) for r in binary.read_texts(spark, str(tmp_path), extract, recognise, 50).collect()}
    assert got == {"a.bin": ("seen", 2, True), "b.bin": (None, None, False), "c.bin": (None, None, False), "d.bin": ("text d", 1, True)}


def test_clean_links_resolved(spark):
    rows = [(1, 1, "https://h.example/a/", "b", "x", "internal"), (2, 1, "https://h.example/a/", "https://h.example/a/b", "y", "internal"), (3, 1, "https://h.example/a/", "#", "z", "internal")]
    df = spark.createDataFrame(rows, "link_id bigint, snapshot_id int, source_url string, url string, text string, link_type string")
    assert [(r["url"], r["link_id"]) for r in links.cleaned(df, resolved=True).collect()] == [("https://h.example/a/b", 1)]
    assert links.cleaned(df).count() == 2
