import random

import numpy as np

from loam.llm import subjects as sj

TOPICS = {"law": ["court order", "witness statement", "stamp duty"], "sport": ["chess tournament", "relay race", "goal keeper"], "arts": ["folk music", "street play", "short film"]}
FORMS = ["The report on {} was read in the hall by the team.", "Work on {} goes on in the east block.", "What does {} mean for the new batch?"]
PLAIN = ["Tea was served in the hall and the guests thanked the staff.", "The office will stay closed on 3 May 2021.", "It was a race against time for the team."]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        own = rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 2]))
        parts = [rng.choice(FORMS).format(rng.choice(TOPICS[t])) for t in own for _ in range(4)] + [rng.choice(PLAIN) for _ in range(2)]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts), "x"))
        truth[i] = set(own)
        if i < 200:
            said = own if rng.random() > 0.1 else [rng.choice(sorted(TOPICS))]
            labels += [(i, s, "w1") for s in said] or [(i, None, "w1")]
    return docs, labels, truth


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id bigint, text string, subject string"), spark.createDataFrame(labels, "doc_id bigint, subject string, labeller string"), spark.createDataFrame([(s, "a") for s in TOPICS], "subject string, about string")


def test_held_out(spark):
    docs, labels, truth = corpus()
    docs += [(900, None, "x"), (901, "", "x"), (902, "  \n ", "x"), (903, "word", "x")]
    d, lab, s = frames(spark, docs, labels + [(5000, "law", "w1"), (3, "unknown", "w2"), (3, None, "w2")])
    found = sj.doc_subjects(d, sj.fit(d, lab, s))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == truth[i] for i in range(200, 300))
    assert right >= 90, right
    assert not set(got) & {900, 901, 902, 903}
    parts = {r["subject"]: r for r in sj.composition(d, found).collect()}
    assert abs(sum(r["share"] for r in parts.values()) - 1) < 1e-4 and parts[None]["documents"] >= 4


def test_without_labels(spark):
    docs, _, _ = corpus(20)
    d, lab, s = frames(spark, docs, [])
    model = sj.fit(d, lab, s)
    assert model.terms == {} and sj.doc_subjects(d, model).collect() == []


def test_fold_is_a_fixed_point():
    """Rows of a matrix that is W H itself are found again."""
    rng = np.random.default_rng(2)
    h = rng.random((6, 3)).astype(np.float32) ** 4
    model = sj.Model(["a", "b", "c"], {str(i): i for i in range(6)}, h, h.sum(0), np.ones(3, np.float32))
    rows, cols = np.repeat([0, 1, 2], [1, 2, 3]), np.asarray([int(h[:, 0].argmax()), *h[:, 1].argsort()[-2:], *h[:, 2].argsort()[-3:]])
    w = model.fold(rows, cols, 3, rounds=200)
    # The updates keep the sum of W H equal to that of the data, and rest where they are.
    assert np.allclose((w * model.total).sum(1), [1, 2, 3], rtol=1e-3)
    assert np.allclose(w, model.fold(rows, cols, 3, rounds=201), atol=1e-3)


def test_sentences():
    assert len(sj.sentences("Dr. A met Prof. B in the hall. Item 12. The council read it!\nShort title 3/2020\nयह पहला वाक्य है। यह दूसरा वाक्य है।")) == 4
