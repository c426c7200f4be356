"""Texts of binary files, through an extractor that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file beyond which it is left unread.
LARGEST = 50 * 1024 * 1024

Extract = Callable[[bytes], tuple[str, int]]


def read_texts(spark: SparkSession, path: str, extract: Extract, recognise: Callable[[bytes], str] | None = None, largest: int = LARGEST) -> DataFrame:
    """(path, text, pages, error) of the files under path.

    extract gives text and number of pages of a file's bytes. recognise, if given, reads the first page as an image;
    what it finds stands in place of the text. Files that are too large, and those that extract cannot read, have a
    null text and the reason in error; an error of recognise leaves the text of extract.
    """
    raw = spark.read.format("binaryFile").load(path)
    small = raw.where(F.col("length") <= largest).select("path", "content")
    large = raw.where(F.col("length") > largest).select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("pages"), F.lit("too large").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    text, pages = extract(bytes(c))
                except Exception as e:  # noqa: BLE001 - the extractor is the caller's
                    out.append((p, None, None, str(e) or type(e).__name__))
                    continue
                if recognise is not None:
                    try:
                        text = recognise(bytes(c)).strip() or text
                    except Exception:  # noqa: BLE001, S110 - as above
                        pass
                out.append((p, text, pages, None))
            yield pd.DataFrame(out, columns=["path", "text", "pages", "error"]).astype({"pages": "Int32"})

    return small.mapInPandas(run, "path string, text string, pages int, error string").unionByName(large)
