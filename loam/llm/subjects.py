"""Subject areas of documents by seeded non-negative factorisation.

The document-term matrix of hand-labelled documents (terms: words and pairs of neighbouring words) is factored into
W H. There is one component for each subject and BACKGROUND free ones; a document's row of W starts on the components
its labels name and H starts as the W-weighted term counts, so each component is anchored to its subject. Alternating
multiplicative updates then let wrong labels fade and unlabelled subjects of a document appear.

H is then held fixed, and the rows of W of all other text are folded in by the same updates. Rows are sentences over the
anchored terms, those of which one subject's component holds at least ANCHORED; a sentence is about the subject that leads its row. A document's
mixture is the share of its sentences that each subject leads, and it has the areas with at least SHARE.

Labels are fitted on at most SAMPLE labelled documents, those with the least hash of doc_id; that bound keeps the
fitting on the driver. Counting, scoring and composition cover all documents.

Defined cases: null, empty or blank texts have no sentence and no subject; labels without subject put a document on
the background; labels of unknown documents or unlisted subjects are ignored; repeated labels count once by labeller;
without labels no area is found.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SAMPLE = 2_500
#: The list of subjects is small by nature; more than this is an error.
MOST_SUBJECTS = 1_000
BACKGROUND = 2
SHARE = 0.25
ROUNDS = 12
#: Updates of a row that is folded in.
FOLDS = 4
LEAST_DF = 3
ANCHORED = 0.55

_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-ॣ॰-ॿ‌‍])*")
# A full stop after these does not end a sentence.
_ABBREVIATED = re.compile(r"\b(Dr|Prof|Mr|Mrs|Ms|No|Item|Sri|Smt|Q|A)\.(?=\s)|\b(Item \d+)\.(?=\s)")
_SENTENCE = re.compile(r"(?<=[.!?।])\s+|\n+")
_NOT_FOLDED = re.compile(r"[^\x00-\x7fऀ-ॿ]")


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text) if _NOT_FOLDED.search(text) else text


def sentences(text: str | None) -> list[str]:
    """Sentences of a text; a line ends one, abbreviations do not; short lines without a full stop (titles) are none."""
    if not text:
        return []
    text = _ABBREVIATED.sub(lambda m: (m[1] or m[2]), fold(text))
    return [s for s in _SENTENCE.split(text) if (n := s.count(" ")) >= 5 or n >= 2 and s.rstrip(" \"')]\r")[-1:] in (".", "!", "?", "।")]


def stem(w: str) -> str:
    return w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w


def terms(sentence: str) -> list[str]:
    """Words and pairs of neighbouring words, lower case, without the s of a plural."""
    ws = [stem(w) for w in _WORD.findall(sentence.lower())]
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


@dataclass
class Model:
    """H at the anchored terms: rows of terms, columns of components (subjects first, then background)."""

    subjects: list[str]
    terms: dict[str, int]
    h: np.ndarray
    #: Sums of H by component over all terms, and how much of the fitted documents each component holds.
    total: np.ndarray
    mass: np.ndarray

    def fold(self, rows: np.ndarray, cols: np.ndarray, n: int, rounds: int = FOLDS) -> np.ndarray:
        """Rows of W, for entries (row, term) of a matrix of n rows in which every row has one."""
        w = np.tile(self.mass, (n, 1))
        held, starts = self.h[cols], np.searchsorted(rows, np.arange(n))
        for _ in range(rounds):
            q = 1 / np.maximum(np.einsum("ij,ij->i", w[rows], held), np.float32(1e-20))
            w *= np.add.reduceat(held * q[:, None], starts, axis=0) / self.total
        return w


def factor(docs: list[set[str]], labels: list[Counter], subjects: list[str], rounds: int = ROUNDS, background: int = BACKGROUND) -> Model:
    """The factorisation of labelled documents (sets of terms)."""
    none = Model(subjects, {}, np.zeros((0, len(subjects) + background), np.float32), np.ones(len(subjects) + background, np.float32), np.ones(len(subjects) + background, np.float32))
    df = Counter(t for d in docs for t in d)
    vocab = {t: i for i, t in enumerate(sorted(t for t, n in df.items() if n >= LEAST_DF))}
    if not vocab or not docs:
        return none
    rows, cols = [], []
    for i, d in enumerate(docs):
        own = [vocab[t] for t in d if t in vocab]
        rows += [i] * len(own)
        cols += own
    r, c = np.asarray(rows), np.asarray(cols)
    if not len(r):
        return none
    n, m, k = len(docs), len(vocab), len(subjects) + background
    rng = np.random.default_rng(11)
    w = np.full((n, k), 0.02, dtype=np.float32)
    for i, lab in enumerate(labels):
        total = sum(lab.values()) or 1
        for s, x in lab.items():
            w[i, s] += x / total
    w[:, len(subjects) :] = 0.3 + 0.1 * rng.random((n, background), dtype=np.float32)
    by_col = np.argsort(c, kind="stable")
    starts_c = np.searchsorted(c[by_col], np.arange(m))
    starts_r = np.searchsorted(r, np.arange(n))
    has_row = np.bincount(r, minlength=n) > 0

    def sum_rows(x: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(x, np.minimum(starts_r, len(x) - 1), axis=0)
        out[~has_row] = 0
        return out

    def h_numerator(q: np.ndarray) -> np.ndarray:
        return np.add.reduceat((w[r] * q[:, None])[by_col], starts_c, axis=0)

    # Start: H from the seeded W. Kullback-Leibler updates, as terms are counts.
    h = h_numerator(np.ones(len(r), dtype=np.float32)) / w.sum(0) + np.float32(1e-6)
    seeds = w.copy()
    for step in range(rounds):
        q = 1 / np.maximum(np.einsum("ij,ij->i", w[r], h[c]), np.float32(1e-12))
        w *= sum_rows(h[c] * q[:, None]) / h.sum(0)
        # The seed stays as a weak prior, so that components keep their subjects.
        w = np.maximum(w, 1e-6) * (0.5 + 0.5 * seeds / seeds.max(1, keepdims=True)) if step < rounds // 2 else np.maximum(w, 1e-6)
        q = 1 / np.maximum(np.einsum("ij,ij->i", w[r], h[c]), np.float32(1e-12))
        h *= h_numerator(q) / w.sum(0)
        h = np.maximum(h, 1e-9)
    mass = h * w.sum(0)
    share = mass / mass.sum(1, keepdims=True)
    best = share.argmax(1)
    top = share[np.arange(m), best]
    kept = [t for t, i in vocab.items() if best[i] < len(subjects) and top[i] >= ANCHORED]
    at = np.asarray([vocab[t] for t in kept], dtype=np.int64)
    return Model(subjects, {t: i for i, t in enumerate(kept)}, h[at].astype(np.float32), h.sum(0).astype(np.float32), w.sum(0).astype(np.float32))


def mixtures(texts: list[str | None], model: Model) -> list[tuple[int, Counter]]:
    """(number of sentences, sentences led by each subject) of each text."""
    counts, owner, rows, cols = [], [], [], []
    get = model.terms.get
    for i, text in enumerate(texts):
        all_ = sentences(text)
        counts.append((len(all_), Counter()))
        for s in all_:
            own = {c for t in terms(s) if (c := get(t)) is not None}
            if own:
                rows += [len(owner)] * len(own)
                cols += sorted(own)
                owner.append(i)
    if owner:
        w = model.fold(np.asarray(rows), np.asarray(cols), len(owner))[:, : len(model.subjects)]
        for r, k in zip(*np.nonzero(w >= 0.999 * w.max(1, keepdims=True))):
            counts[owner[r]][1][int(k)] += 1
    return counts


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most sample labelled documents."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().take(MOST_SUBJECTS + 1))
    if len(names) > MOST_SUBJECTS:
        raise ValueError("too many subjects for one factorisation")
    at = {s: i for i, s in enumerate(names)}
    one = labels.select("doc_id", "subject", "labeller").where("doc_id is not null").distinct()
    chosen = one.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    held = one.join(chosen, "doc_id").toPandas()
    by: dict[int, Counter] = defaultdict(Counter)
    for d, s in zip(held["doc_id"], held["subject"]):
        by[d][s] += 1
    texts = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id", "left_semi")

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "terms": [sorted({t for s in sentences(x) for t in terms(s)}) for x in b["text"]]})

    rows = texts.mapInPandas(shorten, "doc_id bigint, terms array<string>").toPandas().sort_values("doc_id")
    sets = [set(t) for t in rows["terms"]]
    labs = [Counter({at[s]: n for s, n in by[d].items() if s in at}) for d in rows["doc_id"]]
    return factor(sets, labs, names)


def doc_subjects(docs: DataFrame, model: Model, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, sentences, of): the areas of each document with their sentences."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, (n, found) in zip(b["doc_id"], mixtures(list(b["text"]), model)):
                out += [(d, model.subjects[k], x, n) for k, x in sorted(found.items()) if x >= share * n]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "sentences", "of"])

    return docs.select("doc_id", "text").where("text is not null").mapInPandas(score, "doc_id bigint, subject string, sentences int, of int")


def composition(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(subject, documents, share): make-up of the corpus; a document counts by equal parts for its areas, none as null."""
    parts = found.withColumn("part", 1 / F.count("*").over(W.partitionBy("doc_id")))
    n = docs.agg(F.count("*").alias("n"))
    some = parts.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("part").alias("parts"))
    none = docs.select("doc_id").join(found.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("documents")).select(F.lit(None).cast("string").alias("subject"), "documents", F.col("documents").cast("double").alias("parts"))
    total = n.first()[0] or 1
    return some.unionByName(none).select("subject", "documents", F.round(F.col("parts") / F.lit(float(total)), 6).alias("share"))
