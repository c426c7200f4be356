"""Categories of pages and files, from the url and from the content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.urls import first_segment

# Category of a first path segment.
SEGMENTS = {
    "institute": "institute",
    "administration": "administration",
    "academics": "academics",
    "academic": "academics",
    "students": "students",
    "student": "students",
    "research": "research",
    "people": "people",
    "tender": "tender",
    "tenders": "tender",
    "notices": "notices",
    "notice": "notices",
    "cells": "cells",
    "cell": "cells",
    "facilities": "facilities",
    "facility": "facilities",
    "recruitments": "recruitments",
    "recruitment": "recruitments",
    "rti": "rti",
    "computer-center": "computer_center",
    "computer_center": "computer_center",
    "central-facilities": "facilities",
    "central_facilities": "facilities",
}
# Words of a content by category; the first category with a match holds.
CONTENT_WORDS = (
    ("academics", r"curriculum|syllabus|semester|academic|course|b\.?tech|m\.?tech|ph\.?d"),
    ("students", r"admission|hostel|scholarship|student|exam|result|anti[-\s]?ragging"),
    ("research", r"research|publication|project|grant|patent"),
    ("recruitments", r"recruitment|walk[-\s]?in|faculty|advertisement"),
    ("tender", r"tender|gem|bidding|quotation|procurement"),
    ("notices", r"notice|notification|announcement|circular"),
    ("facilities", r"library|laborator(?:y|ies)|workshop|sports|medical|guest\s*house"),
    ("administration", r"registrar|dean|administration|establishment|senate"),
)
# Category of a file by its upload folder.
FOLDERS = (("/uploads/tender/", "tender"), ("/uploads/notices/", "notices"), ("/uploads/recruitments/", "notices"))

# Tags of an item that make its file a notice.
NOTICE_TAGS = ("announcement", "notice", "notifications", "recruitments")


def from_tags(tags: Column) -> Column:
    """notices if one of the tags says so, in any letter case; else null."""
    return F.when(F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*map(F.lit, NOTICE_TAGS))), "notices")


def from_url(url: Column) -> Column:
    """Category by the first path segment, also without the s of a plural; null if there is none."""
    held = F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv])
    seg = first_segment(url)
    return F.coalesce(F.try_element_at(held, seg), F.when(F.endswith(seg, F.lit("s")), F.try_element_at(held, F.regexp_replace(seg, "s$", ""))))


def from_content(text: Column) -> Column:
    """Category of the first rule with a word in the text (whole words by ASCII letters); null if there is none."""
    out = None
    for name, words in CONTENT_WORDS:
        hit = text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def category(url: Column, text: Column) -> Column:
    return F.coalesce(from_url(url), from_content(F.coalesce(text, F.lit(""))), F.lit("general"))


def pdf_category(url: Column) -> Column:
    """Category by upload folder; null if there is none."""
    low, out = F.lower(url), None
    for folder, name in FOLDERS:
        hit = F.contains(low, F.lit(folder))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def or_general(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("general"))
