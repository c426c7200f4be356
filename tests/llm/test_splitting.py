import random

import pytest

from loam.llm import splitting as sp


def check(text, limit=1200, overlap=300):
    (starts, ends, forced), = sp.greedy_cuts([text], limit, overlap)
    starts, ends = list(map(int, starts)), list(map(int, ends))
    assert starts[0] == 0 and ends[-1] == len(text)
    for i, (s, e) in enumerate(zip(starts, ends)):
        assert 0 < e - s <= limit
        if i:
            assert s <= ends[i - 1] < e and ends[i - 1] - s <= overlap and s > starts[i - 1]
    longest = max(map(len, text.translate(str.maketrans({c: " " for c in sp.WS_CHARS})).split(" ")))
    assert bool(max(forced)) == (longest > limit), (longest, forced)
    return starts, ends


@pytest.mark.parametrize("seed", range(60))
def test_random(seed):
    rng = random.Random(seed)
    limit, overlap = rng.choice([(1200, 300), (50, 10), (20, 5), (100, 49)])
    words = ["".join(rng.choices("abcदेव😀.!", k=rng.choice([1, 3, 8, rng.randint(1, 2 * limit)]))) for _ in range(rng.randint(5, 400))]
    text = "".join(w + rng.choice([" ", "\n", "\n\n", "  ", " ", " " * rng.randint(1, 2 * limit)]) for w in words)
    if len(text) > limit:
        check(text, limit, overlap)


def test_edges():
    check("x" * 1201)
    check("x" * 5000)
    check(" " * 5000)
    check("x" * 1200 + " " + "y" * 1200 + "\n")
    check("x" * 1199 + " " + "y" * 901 + " " + "z" * 1200)
    check(" " * 1500 + "x")
    check(("word. " * 400_000))


def test_prefers_lines():
    text = ("a" * 50 + " ") * 10 + "\n" + ("b" * 50 + " ") * 10 + "\n" + ("c" * 50 + " ") * 10
    starts, ends = check(text)
    assert text[ends[0] - 1] == "\n"


def test_pieces(spark):
    items = spark.createDataFrame([("page", 1, "x " * 601), ("page", 2, "x" * 1200), ("pdf", 1, None), ("pdf", 2, ""), ("pdf", 3, "y" * 1300)], "rec_kind string, rec_id bigint, text string")
    out = sp.pieces(items)
    assert {tuple(r) for r in sp.oversized(out).collect()} == {("page", 1, 0), ("pdf", 3, 1)}
    assert all(len(r["piece"]) <= 1200 for r in out.collect())
