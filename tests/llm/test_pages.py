import random
import re
from collections import defaultdict

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from loam.llm import frame, notices, pages as pg, queries, repeated, residue

SCHEMA = "page_id bigint, url string, title string, content string, headings array<struct<level:int,text:string,id:string>>, lists array<array<string>>, tables array<array<array<string>>>, site string, doc string, node string, lines string"


def rows(spark, items):
    full = [(i, u, t, c, h, ls, tb, "s", "d", "n", "l") for i, u, t, c, h, ls, tb in items]
    return spark.createDataFrame(full, SCHEMA)


def page(i, url, title, content, heads=(), lists=(), tables=()):
    return (i, url, title, content, [(1, x, None) for x in heads], [list(x) for x in lists], [list(t) for t in tables])


def norm(x):
    return re.sub("[0-9]+", "0", re.sub(r"\s+", " ", x).strip().lower())


def test_norm_lines(spark):
    text = "  A  b\t\n\n x12 \r\nC  D \n"
    got = spark.range(1).select(pg.norm_lines(F.lit(text)).alias("x")).first()["x"]
    assert got == [norm(x) for x in text.split("\n")]


def test_repeated_brute(spark):
    rng = random.Random(5)
    items = []
    for i in range(400):
        site = rng.choice(["a", "b", "b", "b"])
        lines = [rng.choice(["Menu one", "menu  ONE", "Legal 12", "Legal 7", "", f"body {rng.choice('abcdefghijkl')}{i % 40}", "x", "y"]) for _ in range(rng.randint(0, 12))]
        items.append(page(i, rng.choice([f"https://{site}.example/{i % 60}", f"HTTPS://{site}.example/{i % 60}/#z"]), "t", "\n".join(lines)))
    items += [page(900, None, "t", "Menu one"), page(901, "https://b.example/q", "t", None), page(902, "https://b.example/r", "t", "")]
    keys = defaultdict(set)
    every = []
    for i, u, _, c, *_ in items:
        if u is None or c is None:
            continue
        k = re.sub("/+$", "", u.split("#")[0].lower())
        for n, x in enumerate(c.split("\n"), 1):
            if norm(x):
                keys[k.split("/")[2], norm(x)].add(k)
                every.append((i, n, k.split("/")[2], norm(x)))
    want = {(i, n) for i, n, s, x in every if len(keys[s, x]) >= 6}
    df = rows(spark, items)
    found = repeated.repeated_lines(df)
    assert {tuple(r) for r in found.collect()} == want
    kept = {r["page_id"]: r["content"] for r in repeated.remove_lines(df, found).collect()}
    assert kept[901] is None and kept[900] == "Menu one" and len(kept) == len(items)


def brute_blocks(seqs, least):
    """{lines: (blocks, most documents)} of sequences (site, doc, ids), lines a power of two."""
    docs = defaultdict(set)
    for site, doc, seq in seqs:
        n = 1
        while n <= len(seq):
            for i in range(len(seq) - n + 1):
                docs[site, tuple(seq[i : i + n])].add(doc)
            n *= 2
    out = defaultdict(list)
    for (_, block), d in docs.items():
        if len(d) >= least:
            out[len(block)].append(len(d))
    return {n: (len(x), max(x)) for n, x in out.items()}


def test_blocks_many_segments(spark):
    """Intervals that go over many sorted partitions, a hot line, long blocks, repeated documents."""
    rng = random.Random(3)
    long = list(range(1000, 1150))
    made = []
    for i in range(160):
        seq = [1] + [rng.choice([2, 3, 4, 100 + i]) for _ in range(rng.randint(0, 9))]
        made.append((rng.choice([7, 7, 8]), i % 120, seq + (long if i % 5 == 0 else [])))
    once = spark.createDataFrame([(i, s, d, q) for i, (s, d, q) in enumerate(made)], "seq_id bigint, site bigint, doc bigint, seq array<bigint>")
    levels = repeated.levels_of(once)
    assert levels == 8
    want = {(i, p) for i, (s, _, q) in enumerate(made) for p, x in enumerate(q) if len({d for s2, d, q2 in made if s2 == s and x in q2}) >= 6}
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            starts = repeated.block_starts(once, levels).collect()
            assert {(r["seq_id"], r["place"]) for r in starts} == want
            # Blocks of 128 lines are followed like any other.
            assert max(r["depth"] for r in starts) >= 1 << 7
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_block_counts_brute(spark):
    items = [page(i, f"https://a.example/{i}", "t", f"own {chr(97 + i)}\nfoot a\n\nfoot b\nfoot c\nend {chr(97 + i)}") for i in range(8)] + [page(20 + i, f"https://a.example/z{i}", "t", f"foot a\nfoot b\n{chr(97 + i)}") for i in range(3)]
    got = {r["lines"]: (r["blocks"], r["most_docs"]) for r in repeated.block_counts(rows(spark, items)).collect()}
    seqs = [("a", u, [norm(x) for x in c.split("\n") if norm(x)]) for _, u, _, c, *_ in items]
    assert got == brute_blocks(seqs, 6) and got[2] == (2, 11)


def test_empty(spark):
    none = rows(spark, [])
    assert repeated.repeated_lines(none).collect() == [] and repeated.block_counts(none).collect() == [] and frame.frames(none).collect() == [] and residue.residue_pages(none).collect() == []


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p5_blocks", "p5_clean", "p8_round_trip"])
def test_same_as_sql(spark, tiny, name):
    assert_same(queries.QUERIES[name](spark, tiny), tiny, queries.ORACLES[name])


def site_pages():
    menu, foot = ["Home page", "Contact us", "Site map"], ["All rights reserved", "Back to top"]
    out = []
    for i in range(30):
        side = [f"Report number {chr(97 + (i + k) % 26)} on rivers" for k in (1, 2, 3)]
        title = f"Report number {chr(97 + i % 26)} on rivers" if i < 26 else f"Other {chr(97 + i)} page"
        body = [title, "Background", f"The river {chr(97 + i)} was measured in the spring by {chr(110 - i % 20)} teams.", f"key {chr(97 + i)}: value"]
        lines = [*menu, f"Home > Reports > {title}", *body, f"Visitors: {i * 37}", "Read also", *side, *foot, ""]
        out.append(page(i, f"https://a.example/{i}", title, "\n".join(lines), [title, "Background", "Read also"], [menu, [body[3]], side, foot], [[["k", "v"]]]))
    return out


def test_frame(spark):
    items = site_pages()
    df = rows(spark, items + [page(90, None, None, None), page(91, "https://a.example/x", "Empty", "")])
    got = frame.frames(df)
    by = defaultdict(set)
    for r in got.collect():
        by[r["page_id"], r["field"]].add(r["pos"])
    for i in range(26):
        assert by[i, "content"] == {1, 2, 3, 4, 9, 10, 11, 12, 13, 14, 15}, (i, by[i, "content"])
        assert by[i, "lists"] == {1, 3, 4}
    body = {r["page_id"]: r["content"] for r in frame.main_body(df, got).collect()}
    assert body[0].split("\n")[:2] == ["Report number a on rivers", "Background"] and body[91] == "" and body[90] is None


def test_residue(spark):
    good = site_pages()
    notice = "Please enable JavaScript to use the search box"
    bad = {
        50: ("Not Found", "x"),
        51: ("News", "Welcome {{user_name}} to the hall."),
        52: ("News", "You need to enable JavaScript to run this app."),
        53: (None, "Lor dapvel nulgra tetmip dolvel quo bis. Vel dap gra nul."),
        54: ("News", "The mail office closes at [insert time here] today."),
        55: ("Error", "Your session has timed out. Sign in again to continue."),
    }
    fine = {
        60: "The guide explains that {{roll_no}} marks the spot which the office fills.",
        61: "The portal answered with error 404 for an hour and was restored by the staff.",
        62: "She teaches JavaScript and shows why some pages need scripts enabled.",
    }
    items = [(i, u, t, f"{c}\n{notice}", h, ls, tb) for i, u, t, c, h, ls, tb in good]
    items += [page(i, f"https://a.example/b{i}", t, c) for i, (t, c) in bad.items()] + [page(i, f"https://a.example/f{i}", "Note", c) for i, c in fine.items()] + [page(70, None, None, None)]
    df = rows(spark, items)
    found = residue.residue_pages(df)
    assert {r["page_id"] for r in found.collect()} == set(bad)
    assert residue.clean_pages(df, found).count() == len(items) - len(bad)


def test_templates_are_mined(spark):
    """A leaf's common words stay, also in messages of over thirty words; other leaves are left alone."""
    long = " ".join(["the", "gate", "of"] + [f"word{chr(97 + i % 20)}" for i in range(40)])
    made = [f"error in module {x} at noon today" for x in "abc"] + [f"{long} {x}" for x in "pqr"] + ["error in module only", "one two three four five", "one two three six seven"]
    once = spark.createDataFrame([(m, 1, 1) for m in made], "message string, n int, alone int")
    got = {r["message"]: r["template"] for r in residue.templates(once).collect()}
    assert set(got) == set(made)
    assert {got[m] for m in made[:3]} == {"error in module <*> at noon today"} and {got[m] for m in made[3:6]} == {f"{long} <*>"}
    assert got[made[6]] == made[6] and got[made[7]] == "one two three <*> <*>"


def test_notices_held_out():
    """Phrasings that the labelled messages do not have."""
    bad = [
        "sorry, this document cannot be located on our server",
        "unable to connect to the database, try again later",
        "turn on javascript to read this page",
        "replace this dummy paragraph with your text",
        "your login session has ended, please log in again",
        "the website is under maintenance and will be back soon",
        "http 0 - service not available",
        "an error occurred while loading the page",
        "org.foo.bar.indexexception at org.foo.run(0)",
        "javascript must be enabled in the browser",
        "this is only sample text, write your own",
        "no results were found for this id",
        "access to this page is forbidden",
        "null undefined null",
        "qqqq qqqq qqqq",
        "this page could not be found",
        "placeholder text for the section",
        "the requested file does not exist",
    ]
    good = [
        "list of selected candidates",
        "workshop on error analysis in surveying",
        "the library stays open on sunday",
        "tree planting drive",
        "applications are invited for the post of junior engineer",
        "the lost and found desk is in the main hall",
        "hostel allotment list",
        "road safety week",
        "time for the second paper is two hours",
        "मेला सोमवार को होगा",
        "merit scholarship",
        "the page proofs of the magazine are ready",
        "the sample of milk was found pure",
        "training on office software",
    ]
    model = notices.text_model()
    hits = lambda xs: sum(model.score(x) + residue.ALONE > residue.LEAST_SCORE for x in xs)
    assert not {*bad, *good} & {*notices.masked(notices.RESIDUE), *notices.masked(notices.ORDINARY)}
    assert hits(bad) >= 0.85 * len(bad) and hits(good) == 0


def test_broken_site_is_no_frame(spark):
    """A site most of whose pages are errors has all of them found; a notice beside prose is frame."""
    prose = "The department held a meeting in the hall and it was decided that the work of the new block will be taken up in the summer by the office."
    items = [page(i, f"https://x.example/{i}", f"Page {chr(97 + i)}", "The page you want does not exist or has been moved.") for i in range(12)]
    items += [page(20 + i, f"https://x.example/g{i}", f"Good {chr(97 + i)}", f"{prose} {chr(97 + i)}") for i in range(8)]
    items += [page(40 + i, f"https://y.example/{i}", f"Note {chr(97 + i)}", f"{prose} {chr(97 + i)}\nPlease enable JavaScript to use the map") for i in range(12)]
    assert {r["page_id"] for r in residue.residue_pages(rows(spark, items)).collect()} == set(range(12))

