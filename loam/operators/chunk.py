"""Recursive character splitting with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size, overlap and separators, in this order.
SIZE, OVERLAP = 1200, 300
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")


def _cut(text: str, sep: str) -> list[str]:
    """Pieces at a separator, which stays with the piece after it."""
    if sep == "":
        return list(text)
    first, *rest = text.split(sep)
    return [p for p in [first, *[sep + r for r in rest]] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in pieces:
        if total + len(p) > size and held:
            if chunk := "".join(held).strip():
                out.append(chunk)
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if chunk := "".join(held).strip():
        out.append(chunk)
    return out


def split_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most size characters; neighbours share whole pieces of at most overlap characters."""
    if not text:
        return []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[str] = []
    good: list[str] = []
    for p in _cut(text, separators[at]):
        if len(p) < size:
            good.append(p)
            continue
        if good:
            out += _pack(good, size, overlap)
            good = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + (_pack(good, size, overlap) if good else [])


def chunks(items: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, idx, total, chunk)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "c": [split_text(t, size, overlap) for t in b["t"]]})

    kind = items.schema[key].dataType.simpleString()
    held = items.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, c array<string>")
    return held.select(F.col("k").alias(key), F.size("c").cast("bigint").alias("total"), F.posexplode("c").alias("idx", "chunk"))
