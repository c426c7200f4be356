"""Noise in text from scanned pages: furniture, broken words, misread words.

Only files whose lines are wrapped to a width can be scans; the others tell what undamaged text looks like.

Furniture: a line-pair classifier (boosted trees) sees a line with its neighbours: whether the line before was broken
because it was full, whether the line after continues it, the shape of page numbers, how often the line recurs in the
file with digits masked, its likeness to the title. It is fitted on a bounded sample of files, labelled by strict
rules, and generalises to noisy and single headers.

Misread words: distinct words are joined to more frequent ones through an inverted index of positional 3-grams; a pair
is aligned into edits (one or two characters for one or two). How much more often an edit occurs in wrapped files than
in others tells recognition errors from real variation (names, plurals). Boosted trees rank the candidates; fitted on
a bounded sample of pairs, with words of unwrapped files as the negative class. Words run together or torn apart are found by joins
with their parts.

Broken words: a line that ends in a hyphen is paired with the next body line. Where the whole corpus has the joined
word, or the hyphenated form, or both parts as words, the counts decide; from those pairs a line-pair classifier learns
to decide the others from the parts alone.

Defined cases: null, empty and blank texts have no damage; texts of one line, and texts whose
lines are mostly wide, are not wrapped and have none: of the lines with white space inside (of all lines if none has)
more than a tenth is over WIDEST characters; one long token does not decide; lines are numbered from 1, blank ones included; furniture has no other damage; equal
copies of a row have equal results; files of other columns are untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loam.llm.boosting import Boosted
from loam.storage import cut, sized

WIDEST = 100
#: Share of the lines with white space that must not be wider.
BULK = 0.9
#: Bounds of the samples that are fitted on.
SAMPLE_FILES, SAMPLE_PAIRS = 1500, 20_000
#: Characters that a misread line may lack to its width.
SLACK = 6
#: Features of a line.
FEATURES = 26
#: A word is trusted from so many occurrences, and a candidate is so many times as frequent as its misreading.
TRUSTED, RATIO = 6, 3
#: A word belongs to undamaged text if its share of occurrences in unwrapped files is over this part of all words' share.
KNOWN = 0.2
#: Mark of a piece of a broken word: a character that no word has.
PIECE = "\ue000"
# Characters that stand for a hyphen at a line's end.
HYPHENS = "-‐¬­"

_NUMBER = re.compile(r"^(?:p ?a ?g ?e|पृष्ठ)?\s*[|\[(-]*\s*([0-9olis]{1,4}|[ivxl]{1,6})\s*[\])-]*(?:\s*(?:/|of)\s*[0-9]{1,4})?\s*\.?$", re.I)
_BARE = re.compile(r"^[0-9]{1,4}$")
_ITEM = re.compile(r"^\s*(?:[0-9lI]{1,2}|[a-z])[.)] \S")
_TAIL = re.compile(r"\s{2,}[0-9olisOS]{1,4}$")
_END = re.compile(r"[.?!।:;][\"')\]]*$")


def is_wrapped(text: Column) -> Column:
    """Whether the bulk of the lines is narrow; a line of one token cannot be wrapped and tells nothing."""
    lines = F.split(text, "\n", -1)
    spaced = F.filter(lines, lambda x: F.trim(x).rlike(r"\S\s+\S"))
    widths = F.array_sort(F.transform(F.when(F.size(spaced) > 0, spaced).otherwise(lines), lambda x: F.length(x)))
    bulk = F.element_at(widths, F.ceil(F.size(widths) * BULK).cast("int"))
    return F.coalesce((F.size(lines) > 1) & (bulk <= WIDEST), F.lit(False))


# Furniture ---------------------------------------------------------------------------------------------------------


def masked(line: str) -> str:
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", _TAIL.sub("", line))).strip().lower()


def pairs_of(a: str) -> frozenset[str]:
    return frozenset(a[i : i + 2] for i in range(len(a) - 1))


def likeness(a: frozenset[str], b: frozenset[str]) -> float:
    """Dice likeness of two sets of letter pairs."""
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def line_features(lines: list[str], title: str | None, pages: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, strict label: 1 furniture, 0 body, -1 unknown) of the lines that are not blank."""
    s = [x.strip() for x in lines]
    at = [i for i, x in enumerate(s) if x]
    body_width = sorted(len(s[i]) for i in at)[int(0.8 * (len(at) - 1))] if at else 0
    m = {i: masked(lines[i]) for i in at}
    # Broken because it was full: the next word would not have fitted (one of the next lines may be furniture).
    heads = [len(s[i].split(" ", 1)[0]) for i in at]
    is_full = {i: n + 1 < len(at) and len(s[i]) + 1 + max(heads[n + 1 : n + 4]) > body_width - SLACK for n, i in enumerate(at)}
    among = {i for i in at if not is_full[i] and not _END.search(s[i]) and not _ITEM.match(s[i])}
    counts = Counter(m[i] for i in at)
    grams_ = {k: pairs_of(k) for k in {m[i] for i in among}}
    t = pairs_of(masked(title or ""))
    titles = sum(likeness(g, t) > 0.7 for k, g in grams_.items() for i in among if m[i] == k)
    kind = {i: _NUMBER.match(s[i]) for i in at}
    styled = any(kind[i] and not _BARE.match(s[i]) for i in at)  # pages are numbered in another style than bare numbers
    out, labels = [], []
    for n, i in enumerate(at):
        x = s[i]
        before = at[n - 1] if n else -1
        after = at[n + 1] if n + 1 < len(at) else -1
        prev, nxt = (s[before] if n else ""), (s[after] if after >= 0 else "")
        number = bool(kind[i])
        bare = bool(_BARE.match(x))
        stack = bare and (styled or (before == i - 1 and bool(_BARE.match(prev))) or (after == i + 1 and bool(_BARE.match(nxt))))
        full = is_full[i]
        ended = bool(_END.search(x))
        item = bool(_ITEM.match(x))
        prev_open = bool(prev) and not _END.search(prev) and not _ITEM.match(prev) and not kind[before] and len(prev) > 0.6 * body_width
        # Without this line, would the lines around it be one text?
        joins = prev_open and bool(nxt) and (nxt[:1].islower() or before == i - 1 and after == i + 1)
        tail = bool(_TAIL.search(lines[i]))
        like = likeness(pairs_of(m[i]), t)
        others = max((likeness(grams_[m[i]], g) for k, g in grams_.items() if k != m[i]), default=0.0) if i in among and not number else 0.0
        value = int(kind[i][1]) if number and kind[i][1].isdigit() else 0
        plausible = number and (value == 0 or value <= (pages or 999) or not x.rstrip(".").isdigit())
        words = x.split()
        caps = sum(w[:1].isupper() for w in words) / max(1, len(words))
        out.append((number, bare, stack, plausible, full, ended, item, prev_open, joins, tail, like, others, counts[m[i]], len(x) / max(1, body_width), n == 0, n == len(at) - 1, caps, before != i - 1, after != i + 1, x.isupper(), x[:1].islower(), nxt[:1].islower(), value, n == 1, titles, after >= 0 and likeness(pairs_of(m[after]), t) > 0.7))
        headline = not ended and not item and not stack and not number and not full
        if number and not stack and plausible:
            labels.append(1)
        elif headline and like > 0.7 and n <= 1:
            # The title, or the first header: a header if others follow, and before a title that is set out below it.
            below = n == 0 and after >= 0 and likeness(pairs_of(m[after]), t) > 0.7
            labels.append(int(below or n == 0 and titles > 1))
        elif headline and (tail or like > 0.7 or counts[m[i]] > 1 or others > 0.75):
            labels.append(1)
        elif headline and len(x) < 0.8 * body_width and (n > 1 or caps > 0.4):
            labels.append(1)
        elif stack or item or ended or full:
            labels.append(0)
        else:
            labels.append(-1)
    return np.array(out, dtype=float).reshape(len(at), FEATURES), np.array(labels)



def fit_furniture(files: DataFrame) -> Boosted:
    """The line classifier, from at most SAMPLE_FILES wrapped files: those with the least hash of the text."""
    sample = files.orderBy("h").limit(SAMPLE_FILES).toPandas()
    xs, ys = [np.zeros((0, FEATURES))], [np.zeros(0)]
    for text, title, pages in zip(sample["text"], sample["title"], sample["pages"]):
        x, y = line_features(text.split("\n"), title, None if pages is None or pages != pages else int(pages))
        if len(y):
            xs.append(x[y >= 0])
            ys.append(y[y >= 0])
    return Boosted(trees=60, depth=4).fit(np.concatenate(xs), np.concatenate(ys))


def body_lines(files: DataFrame, model: Boosted) -> DataFrame:
    """(h, line_no, line, furniture): lines of wrapped files that are not blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs, nos, texts, feats = [], [], [], [np.zeros((0, FEATURES))]
            for h, text, title, pages in zip(b["h"], b["text"], b["title"], b["pages"]):
                lines = text.split("\n")
                x, _ = line_features(lines, title, None if pages is None or pages != pages else int(pages))
                at = [i for i, v in enumerate(lines) if v.strip()]
                hs += [h] * len(at)
                nos += [i + 1 for i in at]
                texts += [lines[i].strip() for i in at]
                if len(at):
                    feats.append(x)
            yield pd.DataFrame({"h": pd.Series(hs, dtype="int64"), "line_no": pd.Series(nos, dtype="int32"), "line": pd.Series(texts, dtype=object), "furniture": model.predict(np.concatenate(feats)) > 0.5})

    return files.mapInPandas(run, "h bigint, line_no int, line string, furniture boolean")


# Misread words -----------------------------------------------------------------------------------------------------


def bare_word(c: Column) -> Column:
    """Lower case, without punctuation at the ends."""
    return F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}@!]+|[^\p{L}\p{N}\p{M}@!]+$", ""))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, plain, whole, known): distinct words, how often they occur, how often in files that are not wrapped,
    how often other than beside a hyphen at a line's end, and whether they are known from files that are not wrapped."""
    # Pieces of broken words carry a mark, which bare_word takes off.
    marked = F.when(F.col("wrapped"), F.regexp_replace("text", rf"(\S+[{HYPHENS}])\s*\n\s*(\S+)", f"{PIECE}$1 {PIECE}$2")).otherwise(F.col("text"))
    each = texts.select("wrapped", F.explode(F.split(marked, r"\s+")).alias("w")).select("wrapped", (~F.startswith("w", F.lit(PIECE))).alias("whole"), bare_word(F.col("w")).alias("word"))
    counts = cut(each.where(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.count("*").alias("n"), F.count_if(~F.col("wrapped")).alias("plain"), F.count_if("whole").alias("whole")))
    # A rate, as any misreading gets into some unwrapped file once the corpus is large.
    whole = counts.agg(F.sum("plain").alias("plain"), F.sum("n").alias("n")).first()
    usual = (whole["plain"] or 0) / (whole["n"] or 1)
    return counts.withColumn("known", F.col("plain") > F.col("n") * (KNOWN * usual))


def grams(word: Column) -> Column:
    """Positional 3-grams of the padded word."""
    padded = F.concat(F.lit("^^"), word, F.lit("$$"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 2), lambda i: F.struct(i.alias("at"), F.substring(padded, i, F.lit(3)).alias("g")))


#: Words without any of these are codes.
VOWEL = "[aeiouy@0136!5]"


def candidates(counts: DataFrame) -> DataFrame:
    """(word, n, known, other, n_other): pairs of a word and a more frequent one that is near."""
    fit_ = counts.where((F.col("whole") > 0) & (F.length("word") >= 3) & F.col("word").rlike(r"[a-z]") & F.col("word").rlike(VOWEL))
    trusted = fit_.where((F.col("n") >= TRUSTED) & F.col("word").rlike(r"^[a-z]+(?:-[a-z]+)*$")).select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    index = trusted.select("other", "n_other", F.explode(grams(F.col("other"))).alias("x")).select("other", "n_other", F.explode(F.array(F.col("x.at") - 1, F.col("x.at"), F.col("x.at") + 1)).alias("at"), "x.g")
    asked = fit_.select("word", "n", "known", F.explode(grams(F.col("word"))).alias("x")).select("word", "n", "known", "x.at", "x.g")
    met = asked.join(index, ["g", "at"]).where((F.col("word") != F.col("other")) & (F.col("n_other") >= RATIO * F.col("n")) & (F.abs(F.length("word") - F.length("other")) <= 2))
    near = met.groupBy("word", "other").agg(F.max("n").alias("n"), F.max("known").alias("known"), F.max("n_other").alias("n_other"), F.count("*").alias("met")).where(F.col("met") >= F.greatest(F.lit(1), F.length("word") - 6))
    most = F.when(F.length("word") <= 4, 2).when(F.length("word") <= 9, 3).otherwise(4)
    return near.where(F.levenshtein("word", "other") <= most).drop("met")


def edits(right: str, wrong: str) -> list[str]:
    """Least edits that turn right into wrong; an edit may replace one or two characters by one or two."""
    n, m = len(right), len(wrong)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    back: list[list[tuple[int, int] | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    steps = ((1, 1), (1, 2), (2, 1), (0, 1), (1, 0))
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            best, how = 1e9, None
            if i and j and right[i - 1] == wrong[j - 1] and cost[i - 1][j - 1] < best:
                best, how = cost[i - 1][j - 1], (1, 1)
            for a, b in steps:
                if a <= i and b <= j and (c := cost[i - a][j - b] + (1.01 if a + b == 3 else 1.0)) < best:
                    best, how = c, (a, b)
            cost[i][j], back[i][j] = best, how
    out, i, j = [], n, m
    while i or j:
        a, b = back[i][j]
        x, y = right[i - a : i], wrong[j - b : j]
        if x != y:
            out.append(f"{x}>{y}")
        i, j = i - a, j - b
    return out[::-1]


def pair_edits(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(edits=[edits(o, w) for w, o in zip(b["word"], b["other"])])

    return pairs.mapInPandas(run, "word string, other string, n bigint, known boolean, n_other bigint, edits array<string>").where(F.size("edits") <= F.when(F.length("word") >= 9, 3).when(F.length("word") >= 5, 2).otherwise(1))


def edit_odds(pairs: DataFrame) -> DataFrame:
    """(edit, odds, seen, shown, usual): log of how much more often an edit occurs for words of wrapped files than for
    others; how many words have it in either; its frequency against that of the most usual edit."""
    best = pairs.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy(F.size("edits"), F.desc("n_other"), "other"))).where("r = 1")
    # By number of distinct words, so that one frequent word does not make an edit.
    each = best.select(F.explode(F.array_distinct("edits")).alias("edit"), F.col("known").cast("int").alias("p"))
    whole = best.agg(F.count_if("known").alias("a"), F.count_if(~F.col("known")).alias("b")).first()
    odds = each.groupBy("edit").agg(F.sum("p").alias("a"), (F.count("*") - F.sum("p")).alias("b")).select("edit", (F.log((F.col("b") + 0.3) / (F.col("a") + 0.3)) - math.log(((whole["b"] or 0) + 1) / ((whole["a"] or 0) + 1))).alias("odds"), F.col("b").alias("seen"), F.col("a").alias("shown"))
    odds = cut(odds)
    top = odds.where("odds > 0").agg(F.max("seen")).first()[0] or 1
    return odds.withColumn("usual", F.col("seen") / F.lit(top))


_ODD = re.compile(r"[^a-z-]")
PAIR_FEATURES = ["least", "total", "seen", "edits", "log_n", "log_other", "log_ratio", "length", "odd", "gap", "usual", "shown"]


def pair_features(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(
        [
            rows["least"].to_numpy(float),
            rows["total"].to_numpy(float),
            np.log1p(rows["seen"].to_numpy(float)),
            rows["k"].to_numpy(float),
            np.log(rows["n"].to_numpy(float)),
            np.log(rows["n_other"].to_numpy(float)),
            np.log(rows["n_other"].to_numpy(float) / rows["n"].to_numpy(float)),
            rows["word"].str.len().to_numpy(float),
            rows["word"].map(lambda w: bool(_ODD.search(w))).to_numpy(float),
            rows["length_gap"].to_numpy(float),
            rows["usual"].to_numpy(float),
            (rows["shown"] > 0).to_numpy(float),
        ],
        axis=1,
    )


def corrections(counts: DataFrame) -> DataFrame:
    """(word, replacement): misread words with the candidate that ranks first."""
    pairs = cut(pair_edits(candidates(counts)))
    odds = edit_odds(pairs)
    each = pairs.select("word", "other", F.explode("edits").alias("edit")).join(odds, "edit").groupBy("word", "other").agg(F.min("odds").alias("least"), F.sum("odds").alias("total"), F.min("seen").alias("seen"), F.min("usual").alias("usual"), F.max("shown").alias("shown"))
    ready = cut(pairs.join(each, ["word", "other"]).select("word", "other", "n", "known", "n_other", F.size("edits").alias("k"), "least", "total", "seen", "usual", "shown", (F.length("word") - F.length("other")).alias("length_gap")))
    first = ready.withColumn("r", F.row_number().over(W.partitionBy("word").orderBy("k", F.desc("total"), F.desc("n_other"), "other"))).where("r = 1").drop("r")
    sample = first.orderBy(F.xxhash64("word"), "word").limit(SAMPLE_PAIRS).toPandas()
    y = (~sample["known"].astype(bool)).to_numpy(float)
    weight = np.where(y == 1, 1.0, (y.sum() + 1) / max(1.0, (1 - y).sum()))
    model = Boosted(trees=60, depth=3, least=8).fit(pair_features(sample), y, weight) if len(sample) else Boosted().fit(np.zeros((0, len(PAIR_FEATURES))), np.zeros(0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.predict(pair_features(b)) if len(b) else np.zeros(0)
            yield b.assign(p=p)[["word", "other", "n_other", "k", "total", "p", "usual"]]

    # A rare edit is dropped if unwrapped files show it too; else the trees decide, and must be sure.
    rare = F.col("usual") < LEAST_SEEN
    asked = ready.where(~F.col("known") & (F.col("least") > LEAST_ODDS) & (~rare | (F.col("shown") == 0)))
    ranked = asked.mapInPandas(score, "word string, other string, n_other bigint, k int, total double, p double, usual double").where(F.col("p") >= F.when(rare, MISREAD_RARE).otherwise(MISREAD))
    best = ranked.groupBy("word").agg(F.max(F.struct(-F.col("k"), F.round("total", 1), "p", "n_other", "other")).alias("b"))
    return best.select("word", F.col("b.other").alias("replacement"))


#: Least score of a replacement, also if one of its edits is rare; least log odds of each edit; an edit is rare under so
#: many times the most usual one.
MISREAD, MISREAD_RARE, LEAST_ODDS = 0.6, 0.99, 0.9
LEAST_SEEN = 0.03


def odd_words(counts: DataFrame) -> DataFrame:
    """(word, replacement): words with a sign inside that are not known from unwrapped files, whatever the word is."""
    odd = counts.where(~F.col("known") & F.col("word").rlike(r"^(?:[a-z@!0156-]*[a-z][@!0156][a-z-]+|[@!0156][a-z]{2,}|[a-z-]{2,}[@!0156]|[a-z]{2,}[.'][a-z]{2,})$") & F.col("word").rlike(r"[a-z].*[a-z]"))
    return odd.select("word", F.regexp_replace(F.translate("word", "0156@!", "olsbai"), "[.']", "").alias("replacement"))


def run_together(counts: DataFrame) -> DataFrame:
    """(word, replacement): words that are two trusted words without the space between them."""
    known = counts.where((F.col("n") >= TRUSTED * 3) & F.col("word").rlike(r"^[a-z]+(?:-[a-z]+)*$") & ((F.length("word") > 2) | F.col("word").isin("a", "an", "as", "at", "be", "by", "in", "is", "it", "no", "of", "on", "or", "to", "up", "we"))).select("word", "n")
    asked = counts.where(~F.col("known") & (F.length("word") >= 4) & F.col("word").rlike(r"^[a-z-]+$"))
    # No part is longer than the longest trusted word: a long token has few cuts, or none.
    longest = known.agg(F.max(F.length("word"))).first()[0] or 0
    asked = asked.where(F.length("word") <= 2 * longest)
    at = F.sequence(F.greatest(F.lit(1), F.length("word") - longest), F.least(F.length("word") - 1, F.lit(longest)))
    cuts = asked.select("word", "n", F.explode(at).alias("i")).select("word", "n", F.expr("substring(word, 1, i)").alias("a"), F.expr("substring(word, i + 1)").alias("b"))
    both = cuts.join(known.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(known.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    return both.where(F.least("na", "nb") >= 5 * F.col("n")).groupBy("word").agg(F.max(F.struct(F.least("na", "nb").alias("m"), F.concat_ws(" ", "a", "b").alias("r"))).alias("x")).select("word", F.col("x.r").alias("replacement"))


def torn_apart(body: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, line_no, i, word, replacement): trusted words with a space inside them, as two neighbouring rows.

    body has the words of lines, each with the next one (h, line_no, i, word, next); at least one part is not known from unwrapped files.
    """
    pairs = body.where(F.col("word").rlike("^[a-z]+$") & F.col("next").rlike("^[a-z]+$")).select("h", "line_no", "i", F.col("word").alias("a"), F.col("next").alias("b"))
    known = sized(counts.where((F.col("n") >= TRUSTED) & F.col("known") & (F.length("word") >= 4)).select(F.col("word").alias("joined")))
    plain = counts.where("known")
    named = pairs.withColumn("joined", F.concat("a", "b")).join(known, "joined")
    rare = named.join(plain.select(F.col("word").alias("a"), F.lit(1).alias("pa")), "a", "left").join(plain.select(F.col("word").alias("b"), F.lit(1).alias("pb")), "b", "left").where("pa is null or pb is null")
    two = F.array(F.struct(F.col("i"), F.col("a").alias("word"), F.col("joined").alias("replacement")), F.struct((F.col("i") + 1).alias("i"), F.col("b").alias("word"), F.lit("").alias("replacement")))
    return rare.select("h", "line_no", F.explode(two).alias("x")).select("h", "line_no", "x.*")


# Broken words ------------------------------------------------------------------------------------------------------


def line_breaks(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, line_no, next_no, a, b, broken): body lines that end in a hyphen, and whether it breaks a word."""
    body = lines.where(~F.col("furniture"))
    order = W.partitionBy("h").orderBy("line_no")
    pairs = body.select("h", "line_no", "line", F.lead("line").over(order).alias("next"), F.lead("line_no").over(order).alias("next_no"))
    cut_ = pairs.where(F.col("line").rlike(f"\\p{{L}}[{HYPHENS}]$") & F.col("next").rlike(r"^\p{L}"))
    named = cut_.select("h", "line_no", "next_no", F.lower(F.regexp_extract("line", rf"([\p{{L}}\p{{M}}\p{{N}}@!'.{HYPHENS}]+)[{HYPHENS}]$", 1)).alias("a"), F.lower(F.regexp_extract("next", r"^([\p{L}\p{M}\p{N}@!'-]+)", 1)).alias("b"), (F.substring("line", -1, 1) != "-").alias("soft"))
    named = named.withColumn("joined", F.concat("a", "b")).withColumn("dashed", F.concat("a", F.lit("-"), "b"))
    c = lambda col, name: counts.select(F.col("word").alias(col), F.col("n").alias(name))
    known = named.join(c("joined", "nj"), "joined", "left").join(c("dashed", "nd"), "dashed", "left").join(c("a", "na"), "a", "left").join(c("b", "nb"), "b", "left").fillna(0, ["nj", "nd", "na", "nb"])
    # Clear cases by the counts of both forms; they teach the classifier that decides the rest (mostly rare names).
    clear = F.when(F.col("nd") > F.col("nj"), 0).when(F.col("nj") >= TRUSTED, 1).when((F.col("na") >= TRUSTED) & (F.col("nb") >= TRUSTED) & (F.length("a") > 2) & (F.length("b") > 2) & (F.col("nj") == 0), 0).otherwise(-1)
    ready = cut(known.select("h", "line_no", "next_no", "a", "b", "na", "nb", "soft", "nj", clear.alias("clear")))
    sample = ready.where("clear >= 0").orderBy(F.xxhash64("h", "line_no"), "h", "line_no").limit(SAMPLE_PAIRS).toPandas()
    model = Boosted(trees=40, depth=3).fit(break_features(sample), sample["clear"].to_numpy(float))
    taught = sample["clear"].nunique() > 1

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            # Without both classes to learn from, a break is one unless both parts are words.
            guess = model.predict(break_features(x)) > 0.5 if taught else ~((x["na"] >= TRUSTED) & (x["nb"] >= TRUSTED)).to_numpy(bool)
            yield x[["h", "line_no", "next_no", "a", "b"]].assign(broken=np.where(x["clear"] >= 0, x["clear"] == 1, (x["nj"] > 0) | guess).astype(bool))

    return ready.mapInPandas(decide, "h bigint, line_no int, next_no int, a string, b string, broken boolean")


def break_features(x: pd.DataFrame) -> np.ndarray:
    """A line end with a hyphen as seen without the joined form."""
    log = lambda c: np.log1p(x[c].to_numpy(float))
    return np.stack([log("na"), log("nb"), np.minimum(log("na"), log("nb")), x["a"].str.len().to_numpy(float), x["b"].str.len().to_numpy(float), x["soft"].to_numpy(float)], axis=1)


# The operator ------------------------------------------------------------------------------------------------------


def files_of(pdfs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, files): keys (pdf_id, h); files (h, text, title, pages, wrapped), one for each distinct text and title."""
    held = pdfs.where("text is not null and text <> ''").select("pdf_id", F.xxhash64("text", F.coalesce("title", F.lit("")), F.coalesce("pages", F.lit(0))).alias("h"), "text", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("pages", F.lit(0)).alias("pages"))
    files = held.groupBy("h").agg(F.first("text").alias("text"), F.first("title").alias("title"), F.first("pages").alias("pages")).withColumn("wrapped", is_wrapped(F.col("text")))
    return held.select("pdf_id", "h"), files


def damage(pdfs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(keys, lines, breaks, misread words of lines)."""
    keys, files = files_of(pdfs)
    files = cut(files)
    wrapped = files.where("wrapped").drop("wrapped")
    lines = cut(body_lines(wrapped, fit_furniture(wrapped)))
    counts = word_counts(files)
    ranked = corrections(counts).withColumn("o", F.lit(2)).unionByName(run_together(counts).withColumn("o", F.lit(1))).unionByName(odd_words(counts).withColumn("o", F.lit(3)))
    wrong = ranked.groupBy("word").agg(F.min_by("replacement", "o").alias("replacement"))
    breaks = cut(line_breaks(lines, counts))
    # Pieces of broken words are not misread: the last word before a break and the first one after it are left out.
    ends = breaks.select("h", "line_no").distinct().withColumn("cut_", F.lit(1))
    starts = breaks.select("h", F.col("next_no").alias("line_no")).distinct().withColumn("cont", F.lit(1))
    body = lines.where(~F.col("furniture")).select("h", "line_no", "line").join(ends, ["h", "line_no"], "left").join(starts, ["h", "line_no"], "left").fillna(0, ["cut_", "cont"])
    arrays = body.select("h", "line_no", "cut_", "cont", F.transform(F.split("line", r"\s+"), bare_word).alias("ws"))
    stop = F.size("ws") - F.col("cut_")
    each = F.transform("ws", lambda w, i: F.struct(i.alias("i"), w.alias("word"), F.when(i + 1 < stop, F.get("ws", i + 1)).alias("next")))
    body_words = arrays.select("h", "line_no", F.explode(F.filter(each, lambda x: (x["i"] >= F.col("cont")) & (x["i"] < stop))).alias("x")).select("h", "line_no", "x.*")
    misread = body_words.join(sized(wrong), "word").select("h", "line_no", "i", "word", "replacement")
    found = misread.unionByName(torn_apart(body_words, counts))
    return keys, lines, breaks, found


def found(pdfs: DataFrame) -> DataFrame:
    """(pdf_id, line_no, damage)."""
    keys, lines, breaks, words = damage(pdfs)
    every = lines.where("furniture").select("h", "line_no", F.lit("furniture").alias("damage"))
    every = every.unionByName(breaks.where("broken").select("h", "line_no", F.lit("hyphen").alias("damage"))).unionByName(words.select("h", "line_no", F.lit("chars").alias("damage")).distinct())
    return keys.join(every, "h").select("pdf_id", "line_no", "damage")


def repaired(pdfs: DataFrame) -> DataFrame:
    """(pdf_id, text): continuous paragraphs; texts that are not wrapped stay as they are."""
    keys, lines, breaks, words = damage(pdfs)
    _, files = files_of(pdfs)
    fixes = words.groupBy("h").agg(F.collect_list(F.struct("line_no", "i", "word", "replacement")).alias("fixes"))
    cuts = breaks.groupBy("h").agg(F.collect_list(F.struct("line_no", "broken")).alias("cuts"))
    gone = lines.where("furniture").groupBy("h").agg(F.collect_list("line_no").alias("gone"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "text": [repair(t, list(f if f is not None else []), list(c if c is not None else []), set(g if g is not None else [])) for t, f, c, g in zip(b["text"], b["fixes"], b["cuts"], b["gone"])]})

    held = files.where("wrapped").select("h", "text").join(fixes, "h", "left").join(cuts, "h", "left").join(gone, "h", "left")
    done = held.mapInPandas(run, "h bigint, text string").unionByName(files.where(~F.col("wrapped")).select("h", "text"))
    return keys.join(done, "h").select("pdf_id", "text")


def repair(text: str, fixes: list, cuts: list, gone: set[int]) -> str:
    """Paragraphs of a text after dropping furniture, joining broken words and replacing misread ones."""
    get = lambda x, k: x[k] if isinstance(x, dict) else getattr(x, k)
    by_line: dict[int, dict[int, tuple[str, str]]] = {}
    for f in fixes:
        by_line.setdefault(get(f, "line_no"), {})[get(f, "i")] = (get(f, "word"), get(f, "replacement"))
    hyphen = {get(c, "line_no"): get(c, "broken") for c in cuts}
    out: list[str] = []
    join: bool | None = None  # whether the last line ended inside a word; None: not at a hyphen
    blank = False
    for no, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if no in gone:
            continue
        if not line:
            blank = True
            continue
        words = re.split(r"\s+", line)
        for i, (wrong, right) in by_line.get(no, {}).items():
            k = words[i].lower().find(wrong)
            if k >= 0:
                old = words[i][k : k + len(wrong)]
                new = right.upper() if old.isupper() and len(old) > 1 else right[:1].upper() + right[1:] if old[:1].isupper() else right
                words[i] = words[i][:k] + new + words[i][k + len(wrong) :]
        line = " ".join(w for w in words if w)
        if out and join is not None:
            out[-1] += line
        elif out and not (blank and _END.search(out[-1])):
            out[-1] += " " + line
        else:
            out.append(line)
        blank, join = False, hyphen.get(no)
        if join:
            out[-1] = out[-1][:-1]
    return "\n\n".join(out)
