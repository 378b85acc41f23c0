"""Phrases: strings whose words are joined by one blank."""

from __future__ import annotations

from itertools import permutations as _permutations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def normalised(text: Column, delimiter: str = r"\s+") -> Column:
    """A phrase of a text: trimmed of blanks and control characters, runs of the delimiter made one blank."""
    edge = r"^[\x00-\x20]+|[\x00-\x20]+$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, edge, ""), delimiter, " "), edge, "")


def words(phrase: Column) -> Column:
    return F.split(phrase, " ", -1)


def of_words(array: Column) -> Column:
    return F.concat_ws(" ", array)


def word(phrase: Column, i: int) -> Column:
    """Word ``i`` from 0; negative from the end; null beyond."""
    return F.try_element_at(words(phrase), F.lit(i + 1 if i >= 0 else i))


def without(phrase: Column, i: int) -> Column:
    """The phrase without word ``i``; any negative ``i`` drops the last word."""
    w = words(phrase)
    n = F.size(w)
    if i < 0:
        return of_words(F.slice(w, F.lit(1), n - 1))
    return of_words(F.concat(F.slice(w, F.lit(1), F.least(F.lit(i), n)), F.slice(w, F.lit(i + 2), F.greatest(n - i - 1, F.lit(0)))))


def n_words(phrase: Column) -> Column:
    return F.size(words(phrase))


def leading(phrase: Column) -> Column:
    """All words but the last."""
    return F.regexp_replace(phrase, r" [^ ]*$", "")


def trailing(phrase: Column) -> Column:
    """All words but the first."""
    return F.regexp_replace(phrase, r"^[^ ]* ", "")


def first_word(phrase: Column) -> Column:
    return F.substring_index(phrase, " ", 1)


def last_word(phrase: Column) -> Column:
    return F.substring_index(phrase, " ", -1)


def concatenated(*phrases: Column) -> Column:
    return F.concat_ws(" ", *phrases)


def delimited(phrase: Column, delimiter: str) -> Column:
    return F.replace(phrase, F.lit(" "), F.lit(delimiter))


def has_text(phrase: Column, part: Column) -> Column:
    return F.contains(phrase, part)


def has_subphrase(phrase: Column, part: Column) -> Column:
    """Whether ``part`` stands in the phrase as whole words in a row."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.contains(pad(phrase), pad(part))


@F.pandas_udf(ArrayType(StringType()))
def permutations(phrase: pd.Series) -> pd.Series:
    """All distinct orders of the words, the given one included; n! rows, so for short phrases."""
    return phrase.map(lambda p: None if p is None else sorted({" ".join(x) for x in _permutations(p.split(" "))}))
