"""Languages of answers: choice, requests to change, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages of answers, the first is the default; messages that ask to change it.
LANGUAGES = ("english", "hindi")
CHANGE_REQUESTS = ("change-language", "change language", "bhasha badlo", "भाषा बदलो", "language change karo", "/language", "/lang")


def is_language(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*LANGUAGES), F.lit(False))


def language(c: Column) -> Column:
    """The language in lower case; the default if it is null or unknown."""
    return F.when(is_language(c), F.lower(c)).otherwise(LANGUAGES[0])


def is_change_request(message: Column) -> Column:
    return F.coalesce(F.trim(F.lower(message)).isin(*CHANGE_REQUESTS), F.lit(False))


def fill(text: Column, *args: Column) -> Column:
    """The text with {0}, {1}, ... replaced by args; a number without argument, and a null argument, stay as they are."""
    for i, a in enumerate(args):
        text = F.coalesce(F.replace(text, F.lit("{%d}" % i), a.cast("string")), text)
    return text


def message(table: dict[str, dict[str, str]], key: Column, lang: Column, *args: Column) -> Column:
    """The message of a key in a language, in the default one if that lacks it, '' if the key is unknown."""
    held = F.create_map(*[F.lit(x) for k, by in table.items() for name, text in by.items() for x in (f"{k}|{name}", text)])
    get = lambda name: F.try_element_at(held, F.concat_ws("|", key, name))
    return fill(F.coalesce(get(F.lower(F.coalesce(lang, F.lit(LANGUAGES[0])))), get(F.lit(LANGUAGES[0])), F.lit("")), *args)
