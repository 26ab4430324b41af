"""Column expressions on text that several jobs share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An octet, as a pattern.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
#: Word borders that treat only ASCII letters, digits and the underscore as word characters, so that a term may touch CJK text.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
IPV4 = rf"{LEFT}(?:{OCTET}\.){{3}}{OCTET}{RIGHT}"
CIDR = rf"{LEFT}(?:{OCTET}\.){{3}}{OCTET}/\d{{1,2}}{RIGHT}"
IP_RANGE = rf"{LEFT}(?:{OCTET}\.){{3}}{OCTET}\s*-\s*(?:{OCTET}\.){{3}}{OCTET}{RIGHT}"
CJK = "[一-龥]"


def any_of(conditions: list[Column]) -> Column:
    """Whether one of the conditions holds, as a balanced tree, so that long lists stay shallow."""
    if len(conditions) > 1:
        half = len(conditions) // 2
        return any_of(conditions[:half]) | any_of(conditions[half:])
    return conditions[0] if conditions else F.lit(False)


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """A frame with more columns, each computed once a row however often later expressions and filters use it."""
    fields = [value.alias(name) for name, value in columns.items()]
    return df.select(*df.columns, F.inline(F.array(F.struct(*fields))))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds at least one of the words as a substring."""
    return any_of([F.contains(text, F.lit(w)) for w in words])


def held(text: Column, words: tuple[str, ...]) -> Column:
    """The words that a text holds as substrings, in the order given."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def words_of(text: Column, words: tuple[str, ...]) -> Column:
    """All occurrences of whole words, in text order and lower case."""
    pattern = LEFT + "(?i:" + "|".join(map(re.escape, words)) + ")" + RIGHT
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences of a substring; none for an empty word."""
    word = F.lit(word) if isinstance(word, str) else word
    return F.when(F.length(word) > 0, ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")).otherwise(F.lit(0).cast("long"))


def first_of(rules: list[tuple[str, Column]], default: str | None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default).cast("string")
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def trimmed(text: Column) -> Column:
    """A text without white space (no-break spaces included) at its ends."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")
