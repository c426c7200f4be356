"""Splitting oversized items at natural boundaries, by pointer doubling.

Boundaries of a text are its start, its end, and each place where white space ends (levels: word, sentence, line), and
inside a run of over limit characters without white space, a hard boundary every overlap characters. Each boundary e,
taken as the end of a piece, is joined to its farthest legal successor: the next piece starts at the first boundary
that is at most overlap before e (later, if else it could not reach the next boundary) and ends at the farthest
boundary within limit, of the highest level that lies in the piece's second half. The successor tables of a whole
batch of texts are then squared, and with each square the set of reached boundaries doubles its steps, so all greedy
cuts come out in parallel in log2(pieces) rounds of array gathers.

Defined cases: texts of limit characters (code points) or fewer, null and empty ones give no pieces; pieces cover the
text without gap, are at most limit long, and neighbours share at most overlap characters; forced is 1 for a piece
that ends at a hard boundary; overlap must be under half of limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.text import WS_CHARS

LIMIT, OVERLAP = 1200, 300
# Characters that end a sentence.
SENTENCE_ENDS = ".!?।॥。！？"

_WS = np.zeros(0x10000, dtype=bool)
_WS[[ord(c) for c in WS_CHARS]] = True
_END = np.zeros(0x10000, dtype=bool)
_END[[ord(c) for c in SENTENCE_ENDS]] = True


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def boundaries(cp: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, levels): 4 ends of the text, 3 line, 2 sentence, 1 word, 0 hard."""
    n = len(cp)
    low = np.minimum(cp, 0xFFFF)
    ws = _WS[low]
    step = np.flatnonzero(ws[:-1] & ~ws[1:]) + 1  # a word starts here
    stop = np.flatnonzero(~ws[:-1] & ws[1:]) + 1  # a word ended here
    level = np.ones(len(step), dtype=np.int8)
    if len(step) and len(stop):
        before = np.searchsorted(stop, step, side="left") - 1
        has = before >= 0
        at = stop[np.maximum(before, 0)]
        level[has & _END[low[at - 1]]] = 2
        breaks = np.concatenate(([0], np.cumsum(cp == 10)))
        level[has & (breaks[step] > breaks[at])] = 3
    pos = np.concatenate(([0], step, [n]))
    level = np.concatenate(([4], level, [4])).astype(np.int8)
    # Runs are measured between white space, wherever their boundaries lie.
    edges = np.concatenate(([-1], np.flatnonzero(ws), [n]))
    gaps = np.diff(edges) - 1
    hard = [np.arange(edges[i] + 1 + overlap, edges[i + 1], overlap) for i in np.flatnonzero(gaps > limit)]
    # A stretch of white space alone has no word start in it.
    spots = np.sort(np.concatenate([pos, *hard])) if hard else pos
    for a in spots[:-1][np.diff(spots) > limit]:
        b = spots[np.searchsorted(spots, a, side="right")]
        if ws[a:b].any():
            run = np.flatnonzero(~ws[a:b])
            cut = a + (run[-1] + 1 if len(run) else 0)
            hard_ws = np.arange(cut if cut > a else a + overlap, b, overlap)
            pos, level = np.concatenate((pos, hard_ws)), np.concatenate((level, np.ones(len(hard_ws), dtype=np.int8)))
    if hard:
        h = np.concatenate(hard)
        pos, level = np.concatenate((pos, h)), np.concatenate((level, np.zeros(len(h), dtype=np.int8)))
    order = np.lexsort((-level, pos))
    pos, level = pos[order], level[order]
    keep = np.concatenate(([True], np.diff(pos) > 0))
    return pos[keep], level[keep]


def successors(pos: np.ndarray, level: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the next end, index of the next start) for each boundary taken as an end; the last joins itself."""
    m = len(pos)
    nearest = np.append(pos[1:], pos[-1])
    start = np.searchsorted(pos, np.maximum(pos - overlap, nearest - limit), side="left")
    start = np.minimum(start, np.arange(m))
    reach = pos[start] + limit
    end = np.searchsorted(pos, reach, side="right") - 1  # the farthest of any level
    floor = np.maximum(pos + 1, pos[start] + limit // 2)
    done = np.zeros(m, dtype=bool)
    for lv in (4, 3, 2, 1):
        own = np.flatnonzero(level >= lv)
        k = np.searchsorted(pos[own], reach, side="right") - 1
        cand = own[np.maximum(k, 0)]
        good = ~done & (k >= 0) & (pos[cand] >= floor)
        end[good] = cand[good]
        done |= good
    # Without a boundary in the second half, any natural one before a hard one.
    own = np.flatnonzero(level >= 1)
    cand = own[np.maximum(np.searchsorted(pos[own], reach, side="right") - 1, 0)]
    good = ~done & (pos[cand] > np.maximum(pos, pos[start] + overlap))
    end[good] = cand[good]
    end[-1] = m - 1
    return end, start


def greedy_cuts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, forced) of the pieces of each text, all texts' tables squared at once."""
    if not 0 < overlap < limit // 2:
        raise ValueError("overlap must be under half of limit")
    if not texts:
        return []
    parts, base = [], 0
    all_pos, all_level, all_next, all_start, first, last = [], [], [], [], [], []
    for t in texts:
        pos, level = boundaries(code_points(t), limit, overlap)
        end, start = successors(pos, level, limit, overlap)
        all_pos.append(pos)
        all_level.append(level)
        all_next.append(end + base)
        all_start.append(start + base)
        first.append(base)
        base += len(pos)
        last.append(base - 1)
        parts.append(len(pos))
    pos, level, nxt, start = map(np.concatenate, (all_pos, all_level, all_next, all_start))
    table = nxt
    reached = np.zeros(base, dtype=bool)
    reached[first] = True
    ends = np.asarray(last)
    while True:
        reached[table[reached]] = True
        if reached[ends].all() and (table[np.asarray(first)] == ends).all():
            break
        table = table[table]
    out = []
    for a, n in zip(first, parts):
        at = np.flatnonzero(reached[a : a + n]) + a  # ends of pieces, after the start of the text
        out.append((pos[start[at[:-1]]], pos[at[1:]], (level[at[1:]] == 0).astype(np.int32)))
    return out


def pieces(items: DataFrame, with_text: bool = True, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(rec_kind, rec_id, piece_no, piece_start, piece_end, forced[, piece]) of items (rec_kind, rec_id, text)."""
    long = items.select("rec_kind", "rec_id", "text").where(F.length("text") > limit)
    schema = "rec_kind string, rec_id bigint, piece_no int, piece_start bigint, piece_end bigint, forced int" + ", piece string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            # Tables of about four million characters at a time.
            a = 0
            while a < len(texts):
                b, held = a, 0
                while b < len(texts) and (b == a or held + len(texts[b]) <= 4_000_000):
                    held += len(texts[b])
                    b += 1
                cuts = greedy_cuts(texts[a:b], limit, overlap)
                counts = [len(s) for s, _, _ in cuts]
                which = np.repeat(np.arange(a, b), counts)
                starts, ends = (np.concatenate([c[i] for c in cuts]) for i in (0, 1))
                out = pd.DataFrame({"rec_kind": batch["rec_kind"].to_numpy()[which], "rec_id": batch["rec_id"].to_numpy()[which], "piece_no": np.concatenate([np.arange(1, c + 1) for c in counts]).astype(np.int32), "piece_start": starts, "piece_end": ends, "forced": np.concatenate([c[2] for c in cuts])})
                if with_text:
                    out["piece"] = [texts[i][s:e] for i, s, e in zip(which, starts, ends)]
                yield out
                a = b

    return long.mapInPandas(run, schema)


def items(pages: DataFrame, pdfs: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, text) of pages and pdfs."""
    return pages.select(F.lit("page").alias("rec_kind"), F.col("page_id").alias("rec_id"), F.col("content").alias("text")).unionByName(pdfs.select(F.lit("pdf").alias("rec_kind"), F.col("pdf_id").alias("rec_id"), "text"))


def oversized(found: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, forced): one row for each item that was cut."""
    return found.groupBy("rec_kind", "rec_id").agg(F.max("forced").alias("forced"))
