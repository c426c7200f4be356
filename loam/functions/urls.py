"""Url expressions: identity keys, sites, segments, validity, link types."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def url_key(c: Column) -> Column:
    """The url without its # part, lower-cased, without slashes at its end. Null stays null."""
    return F.regexp_replace(F.lower(F.substring_index(c, "#", 1)), "/+$", "")


def site(c: Column) -> Column:
    """The lower-cased host of the url; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


# File endings and parts of a url that a crawl skips.
SKIPPED_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".map")
SKIPPED_PARTS = ("mailto:", "tel:", "javascript:", "#", "/assets/", "/static/", "/locales/", "/images/", "/fonts/", "facebook.com", "twitter.com", "linkedin.com", "youtube.com", "google.com", "maps.google", "instagram.com")
IMAGE_ENDINGS = r"\.(?:jpg|jpeg|png|gif|webp)$"


def path(c: Column) -> Column:
    """The path of an absolute url, without query and fragment."""
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def first_segment(c: Column) -> Column:
    """The first part of the path, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path(c), r"^/*([^/]+)", 1))


def pdf_key(c: Column) -> Column:
    """Identity of a file: without fragment and query, lower case."""
    return F.lower(F.substring_index(F.substring_index(c, "#", 1), "?", 1))


def is_valid(c: Column, domain: str) -> Column:
    """Whether a crawl of domain follows the url (an absolute one). The host has to contain the domain."""
    low = F.lower(c)
    skipped = F.lit(False)
    for e in SKIPPED_ENDINGS:
        skipped = skipped | F.endswith(F.lower(path(c)), F.lit(e))
    for p in SKIPPED_PARTS:
        skipped = skipped | F.contains(low, F.lit(p))
    return F.coalesce(F.contains(site(c), F.lit(domain)) & ~skipped, F.lit(False))


def link_type(c: Column, domain: str) -> Column:
    """pdf, image, internal or external, tested in this order."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit(".pdf")), "pdf").when(low.rlike(IMAGE_ENDINGS), "image").when(F.contains(low, F.lit(domain)), "internal").otherwise("external")


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/", -1), -1)


def _join(base: str | None, href: str | None) -> str | None:
    if href is None:
        return None
    try:
        out = urljoin(base or "", href.strip())
        parts = urlsplit(out)
    except ValueError:
        return None
    if not parts.scheme:
        return None
    # An absolute url without path has the root path.
    return out if parts.path or not parts.netloc else parts._replace(path="/").geturl()


@F.pandas_udf(StringType())
def resolve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(base, href): the absolute url of href on a page; null if there is none."""
    for base, href in batches:
        yield pd.Series([_join(b, h) for b, h in zip(base, href)], dtype=object)


def comparison_key(base: Column, href: Column) -> Column:
    """Resolved and in lower case, path and query too."""
    return F.lower(resolve(base, href))


def input_list(c: Column) -> Column:
    """Entries of a comma list, trimmed, without empty ones; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
