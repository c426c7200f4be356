"""Text expressions: the white-space class, squeezing, word counts, cache keys, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space, as a regex class that Java and RE2 read alike.
WS = r"[\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The same class for Python's re.
PY_WS = "[\\x09-\\x0d\\x20\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: The same class as plain characters, for str.strip and str.translate.
WS_CHARS = "\t\n\x0b\x0c\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


def squeeze(c: Column) -> Column:
    """Each run of white space becomes one space; ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def trim_ws(c: Column) -> Column:
    """Unicode-aware trim."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def word_count(c: Column) -> Column:
    """Pieces between white space, empties dropped; 0 for null."""
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " "))).cast("bigint")


def space_pieces(c: Column) -> Column:
    """Pieces of a split on single spaces, empties counted; 0 for null."""
    return F.coalesce(F.size(F.split(c, " ", -1)), F.lit(0)).cast("bigint")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(url: Column, index: Column, text_hash: Column) -> Column:
    """url hash (12) : index (at least four digits, never cut) : text hash (10)."""
    return F.concat_ws(":", F.left(F.sha2(url, 256), F.lit(12)), F.format_string("%04d", index.cast("int")), F.left(text_hash, F.lit(10)))


# Words that a cache key leaves out.
STOP_WORDS = ("please", "tell", "me", "what", "is", "are", "the", "a", "an", "of", "about")


def query_key(c: Column, drop_stop_words: bool = False) -> Column:
    """Cache key text: squeezed, lower case, only letters, digits and spaces. Without NFKC."""
    s = F.lower(squeeze(F.coalesce(c, F.lit(""))))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N} ]+", ""), " +", " "))
    if drop_stop_words:
        stop = F.array(*map(F.lit, STOP_WORDS))
        s = F.array_join(F.filter(F.split(s, " "), lambda w: ~F.array_contains(stop, w)), " ")
    return s


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def query_key_nfkc(c: Column) -> Column:
    return query_key(nfkc(c))


def short_hash(c: Column, n: int = 32) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))
