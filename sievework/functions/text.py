"""Names and free text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.codes import NAME_EXPANSIONS, NULL_TOKENS

BLANKS = " \t\n\r\x0b\x0c"

# Unicode word characters and blanks as Python counts them, written so that every engine agrees:
# letters and numbers of any script plus the underscore; ASCII and Unicode separators.
WORD = r"\p{L}\p{N}_"
ASCII_WORD = "A-Za-z0-9_"  # word characters at the word boundary of engines that know no other letters there
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def snake_case(name: str) -> str:
    """``FAC_NAME`` -> ``fac_name``; every run of capitals opens a new word.

    A digit followed by a capital therefore splits: ``NUME90Q`` -> ``nume90_q``.  Callers that look
    for such columns accept both spellings (see :func:`either_spelling`).
    """
    opened = re.sub("[A-Z]+", lambda run: "_" + run.group(), name).lower().removeprefix("_")
    return re.sub("__+", "_", opened)


def either_spelling(columns: list[str], wanted: str) -> str | None:
    """The column called ``wanted``, or the one equal to it when underscores are ignored."""
    flat = wanted.replace("_", "")
    return next((c for c in columns if c.lower().replace("_", "") == flat), None)


def name_tokens(column: str) -> set[str]:
    return set(snake_case(column).split("_"))


def has_token(column: str, *tokens: str) -> bool:
    """True when one of ``tokens`` is a whole word of the column name.

    Substring search would call ``violation_count`` a latitude column (vio-lat-ion).
    """
    return bool(name_tokens(column).intersection(tokens))


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def null_tokens_removed(column: Column) -> Column:
    """Trim, and turn the usual spellings of "nothing" into null."""
    text = trimmed(column)
    return F.when(~text.isin(*NULL_TOKENS), text)


def upper_code(column: Column) -> Column:
    """Identifier or code: upper case, trimmed, null tokens removed."""
    text = F.upper(trimmed(column))
    return F.when(~text.isin("NAN", "NONE", "NULL", ""), text)


def clean_name(column: Column, boundary: str = WORD) -> Column:
    """Standard form of a facility, permit or pollutant name.

    Blanks collapse, abbreviations are spelled out in their fixed order and case, then everything but
    word characters, blanks and ``- . , ( )`` goes.  ``&`` is replaced only between two word characters.
    Word boundaries are Unicode ones; ``boundary`` gives the characters of words another way (with
    ``ASCII_WORD`` an accented letter ends a word, as in SQL).  A name that was missing stays null.
    """
    text = F.regexp_replace(trimmed(column), f"[{SPACE}]+", " ")
    for short, full in NAME_EXPANSIONS:
        # The first character is matched before its surroundings are looked at, which is much
        # cheaper than a look-behind at every position of a long text.
        first, rest = short[0], short[1:]
        if short == "&":
            pattern = f"&(?<=[{boundary}]&)(?=[{boundary}])"
        else:
            pattern = f"{first}(?<![{boundary}]{first}){rest}(?![{boundary}])"
        text = F.regexp_replace(text, pattern, full)
    text = F.regexp_replace(text, rf"[^{WORD}{SPACE}\-.,()]", "")
    return F.when(~text.isin("NAN", ""), text)


def search_tokens(*columns: Column) -> Column:
    """Distinct lower-case words of the given columns, for token look-ups with ``array_contains``."""
    joined = F.lower(F.concat_ws(" ", *columns))
    words = F.split(joined, f"[^{WORD}]+")
    return F.array_distinct(F.filter(words, lambda word: word != ""))


def comma_list(column: Column) -> Column:
    """``"a, b"`` -> ``["a", "b"]``; empty items are dropped."""
    items = F.transform(F.split(column, ","), lambda item: trimmed(item))
    return F.filter(items, lambda item: item != "")


def similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, between 0 and 1; two empty texts are equal."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(left, right) / longer)
