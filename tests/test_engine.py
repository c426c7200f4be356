import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loam.engine import Engine
from loam.operators import items, response_cache, vectors


def hashed(c):
    """A stand-in for an embedding service: counts of hashed words."""
    words = F.split(F.lower(c), "[^a-z]+")
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(F.pmod(F.xxhash64(w), F.lit(32)) == b, 1.0).otherwise(0.0)))


def test_runs(spark, tiny, tmp_path):
    t = lambda n: spark.read.parquet(f"{tiny}/{n}.parquet")
    pages, pdfs = t("pages"), t("pdfs")
    one = lambda n: (pages.where(f"snapshot_id = {n}"), pdfs.where(f"snapshot_id = {n}"))
    e = Engine(spark, str(tmp_path / "store"), hashed)
    before = {r["status"]: r["n"] for r in e.preview(*one(1)).collect()}
    first = {r["status"]: r["n"] for r in e.ingest(*one(1)).collect()}
    assert set(before) == {"NEW"} and first["NEW"] == before["NEW"] and first["EMBED"] > 0 and first["DELETE"] == 0
    again = {r["status"]: r["n"] for r in e.ingest(*one(1)).collect()}
    assert again["UNCHANGED"] == first["NEW"] and again["EMBED"] == again["DELETE"] == 0
    second = {r["status"]: r["n"] for r in e.ingest(*one(2)).collect()}
    assert sum(second.get(s, 0) for s in ("NEW", "MODIFIED", "UNCHANGED")) == items.items(*one(2)).count()
    stats = {r["name"]: r["n"] for r in e.stats().collect()}
    assert stats["vectors"] == stats["ledger_chunks"] > 0
    q = spark.createDataFrame([(1, "annual report of the library"), (2, "")], "q_id bigint, question string")
    got = {r["q_id"]: r for r in e.ask(q, k=3).collect()}
    assert got[1]["confidence"] > 0 and got[1]["context"].startswith("[Page 1:") and "Question: annual" in got[1]["prompt"]
    assert len(list(Engine(spark, str(tmp_path / "store"), hashed, lambda p: "a").answers(q))) == 2
    e.reset()
    assert {r["n"] for r in e.stats().collect()} == {0}


def test_response_cache(spark):
    t0 = datetime(2024, 1, 10)
    planes = vectors.planes(16, 3)
    rows = [(1, [1.0, 0.1, 0.0], "yes", ["s"], 0.9, "en", t0), (2, [1.0, 0.0, 0.0], " ", ["s"], 0.9, "en", t0), (3, [1.0, 0.0, 0.0], "no", [], 0.9, "en", t0), (4, [1.0, 0.0, 0.0], "no", ["s"], float("nan"), "en", t0), (5, [1.0, 0.1, 0.0], "old", ["s"], 0.9, "en", t0 - timedelta(days=8)), (6, [1.0, 0.1, 0.0], "hi", ["s"], 0.9, "hi", t0)]
    answers = spark.createDataFrame(rows, "item_id bigint, embedding array<double>, text string, sources array<string>, confidence double, language string, created_at timestamp")
    cache = response_cache.put(answers, planes)
    assert {r["item_id"] for r in cache.collect()} == {1, 5, 6}
    q = spark.createDataFrame([(1, [1.0, 0.1, 0.0], "en"), (2, [-1.0, 0.0, 0.0], "en")], "q_id bigint, embedding array<double>, language string")
    got = response_cache.look_up(q, cache, planes, F.lit(t0)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0)]


def test_frames_cache_and_virtual_items(spark, tiny, tmp_path):
    from loam.engine import Engine, embedder

    sizes = []

    def embed(texts):
        sizes.append(len(texts))
        assert all(isinstance(t, str) for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    assert [r["v"] for r in spark.createDataFrame([("ab",), (None,)], "t string").coalesce(1).select(embedder(embed, 1)(F.col("t")).alias("v")).collect()] == [[2.0, 1.0], None]
    t = {n: spark.read.parquet(f"{tiny}/{n}.parquet") for n in ("pages", "pdfs", "links")}
    one = {n: df.where("snapshot_id = 1") for n, df in t.items()}

    def generate(prompt):
        if "broken" in prompt:
            raise ValueError("no answer")
        return iter(["a", "b"])

    e = Engine(spark, str(tmp_path / "e"), embedder(embed), generate)
    e.ingest(one["pages"], one["pdfs"], one["links"])
    assert e.read("ledger_pages").where("url like 'virtual://%'").count() == 2
    asked = spark.createDataFrame([(1, "What  is the FEE?"), (2, "what is the fee"), (3, "broken")], "q_id bigint, question string")
    frames = [json.loads(f) for f in e.frames(asked)]
    assert [(f["event"], f.get("text")) for f in frames if f["q_id"] == 1] == [("chunk", "a"), ("chunk", "b"), ("end", None)]
    assert [f["event"] for f in frames if f["q_id"] == 3] == ["error"]
    for _ in range(2):
        made = {r["q_id"]: list(r["embedding"]) for r in e.embed_queries(asked).collect()}
        assert made == {1: [17.0, 1.0], 2: [17.0, 1.0], 3: [6.0, 1.0]}
    assert e.read("query_cache").count() == 2 and e.read("vectors").count() > 0
    assert {r["name"] for r in e.stats().collect()} == {"ledger_pages", "ledger_chunks", "vectors", "query_cache"}
    (tmp_path / "s").mkdir()
    for name, at in (("a.json", "t1"), ("b.json", "t2")):
        (tmp_path / "s" / name).write_text(json.dumps({"metadata": {"timestamp": at}, "pages": []}))
    assert [r["file"] for r in e.sources(str(tmp_path / "s")).collect()] == ["b.json", "a.json"]


def test_expiry_and_capacity(spark):
    from datetime import datetime, timedelta

    from loam.operators import conversation, replay, vectors

    t0 = datetime(2024, 1, 1)
    m = spark.createDataFrame([("old", 1, t0, "user", "x"), ("kept", 2, t0, "user", "x"), ("kept", 3, t0 + timedelta(hours=30), "user", "y")], "session_id string, msg_id bigint, at timestamp, role string, content string")
    now = F.lit(t0 + timedelta(hours=40))
    assert {r["msg_id"] for r in conversation.recent(m, now=now).collect()} == {2, 3}
    ev = [(i, t0 + timedelta(seconds=s), k) for i, (s, k) in enumerate([(0, "a"), (5, "a"), (11, "a"), (12, "b"), (13, "c"), (14, "a"), (15, "b")])]
    got = replay.lru_replay(spark.createDataFrame(ev, "event_id bigint, ts timestamp, k string").withColumn("s", F.lit(1)), "s", "k", 2, 10).orderBy("event_id").collect()
    assert [r["hit"] for r in got] == [False, True, False, False, False, False, False]
    hits = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "q_id bigint, vec_id bigint, place bigint")
    docs = spark.createDataFrame([(7, "A", "x", "pdf_document", 3), (8, "B", "y", "page", None)], "doc_id bigint, title string, text string, source_type string, pages int")
    assert conversation.context(hits, docs).first()["context"] == "[PDF Document 1: A (3 pages)] x\n\n[Page 2: B] y"
    q = spark.createDataFrame([(1, 5, "m1")], "q_id bigint, sig bigint, model string")
    v = spark.createDataFrame([(2, 5, "m1"), (3, 5, "m2"), (4, 4, "m1")], "vec_id bigint, sig bigint, model string")
    assert {r["vec_id"] for r in vectors.near(q, v, 4, 1, ("model",)).collect()} == {2, 4}
