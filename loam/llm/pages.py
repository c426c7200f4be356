"""Lines of pages: the common view that the page operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import WS, squeeze
from loam.functions.urls import site, url_key


def norm(c: Column) -> Column:
    """A line for comparison: white space squeezed and trimmed, lower case, every run of digits alike."""
    return F.regexp_replace(F.lower(squeeze(c)), "[0-9]+", "0")


#: White space but for line ends.
_INNER = WS.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")


def norm_text(text: Column) -> Column:
    """A text whose every line is as norm() makes it, in one pass over the whole text."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"{_INNER}+", " "), "[0-9]+", "0")


def norm_lines(text: Column) -> Column:
    return F.split(F.trim(norm_text(text)), " ?\n ?", -1)


def line_arrays(pages: DataFrame) -> DataFrame:
    """(page_id, site, url_key, lines): pages with site and content; lines hold the blank ones as ''."""
    return pages.select("page_id", F.coalesce(site(F.col("url")), F.lit("")).alias("site"), url_key(F.col("url")).alias("url_key"), norm_lines(F.col("content")).alias("lines"))


def ids(lines: Column) -> Column:
    """Line identifiers; 0 for blank lines."""
    return F.transform(lines, lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(x)))
