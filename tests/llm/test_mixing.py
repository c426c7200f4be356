import random

from loam.llm import mixing


def test_pivotal_keeps_mass():
    rng = random.Random(3)
    size = [rng.uniform(1, 900) for _ in range(500)]
    frac = [0.37] * 500
    out = mixing.pivotal(frac, size, rng.random)
    assert abs(sum(f * s for f, s in zip(out, size)) - sum(f * s for f, s in zip(frac, size))) < 1e-6
    assert sum(0 < f < 1 for f in out) <= 1


def test_pivotal_keeps_expectation():
    hits = [0] * 5
    for seed in range(4000):
        out = mixing.pivotal([0.3] * 5, [1, 2, 3, 4, 5], random.Random(seed).random)
        for i, f in enumerate(out):
            hits[i] += f
    assert all(abs(h / 4000 - 0.3) < 0.04 for h in hits)


def test_mix(spark):
    rows = [(i, " Big " if i % 2 else "big", 10 + i % 7) for i in range(3000)] + [(5000 + i, "small", 12) for i in range(50)] + [(9000, None, 5), (9001, "other", 5), (9002, "big", 0)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2), (None, 0.3, None)], "source string, target_share double, max_repeats int")
    recs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")
    chosen, goals = mixing.mix(recs, targets, block=100)
    got = {r["source"]: r for r in mixing.shares(chosen, goals).collect()}
    assert abs(got["big"]["reached_share"] - 5 / 9) < 0.01 and abs(got["small"]["reached_share"] - 4 / 9) < 0.01
    assert got["gone"]["tokens"] == 0 and got["small"]["most_uses"] <= 3 and got["big"]["most_uses"] == 1
    again = mixing.mix(recs, targets, block=100)[0]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))


def test_empty(spark):
    recs = spark.createDataFrame([], "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, goals = mixing.mix(recs, targets)
    assert chosen.count() == 0 and mixing.shares(chosen, goals).first()["reached_share"] == 0
