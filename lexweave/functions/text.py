"""Text processors: a column of lines to a column of cleaned lines.

A processor is a function ``Column -> Column`` in ``PROCESSORS``; a new one is
registered by adding it there.  All are chains of built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker in replaced tokens and the ordered rules of the moderate processor.
MARKER = "zxzxpz"
MODERATE_RULES = (
    (r"[\w.\-]+@[\w\-]+\.[\w]{2,3}", f" {MARKER}email "),
    (r"[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,4}", f" {MARKER}date "),
    (r"\d{1,2}:\d{2}(:\d{2})?", f" {MARKER}time "),
    (r"(\d{3}-|\(\d{3}\) ?)\d{3}-\d{4}", f" {MARKER}phone "),
    (r"[\d\-.,~]{3,}(\D|$)", f" {MARKER}numeral $1"),
    (r"[()\[\]{}\".,;:?!]", ""),
    (r"([a-zA-Z])([~\-/&])", "$1 $2"),
    (r"([~\-/&])([a-zA-Z])", "$1 $2"),
    (r"[ \t]{4,}", f" {MARKER}newln "),
    (r"[ \t]+", " "),
    (r"([^a-zA-Z0-9])\1{2,}", "$1$1"),
)


def moderate(line: Column) -> Column:
    """Masks emails, dates, times, phones and numerals, drops punctuation, parts joined words, collapses symbols; case is kept."""
    for pattern, replacement in MODERATE_RULES:
        line = F.regexp_replace(line, pattern, replacement)
    return line


def aggressive(line: Column) -> Column:
    """Everything but words and digits to blanks, numbers between blanks dropped, lower case."""
    line = F.regexp_replace(line, r"[\W_]+", " ")
    return F.lower(F.regexp_replace(line, r"(\s)\d+\s", "$1"))


def unchanged(line: Column) -> Column:
    return line


PROCESSORS: dict[str, Callable[[Column], Column]] = {"moderate": moderate, "aggressive": aggressive, "none": unchanged}
#: Processors that put marked tokens into a text.
MARKING = {"moderate"}


def processor(name: str) -> Callable[[Column], Column]:
    """A processor by name; unknown names raise ``KeyError`` naming the known ones."""
    if name not in PROCESSORS:
        raise KeyError(f"unknown processor {name!r}; known: {', '.join(sorted(PROCESSORS))}")
    return PROCESSORS[name]


def has_marker(text: Column, name: str = "moderate") -> Column:
    """True where a text holds a token that the processor put in; only the moderate processor does."""
    return F.contains(text, F.lit(MARKER)) if name in MARKING else F.lit(False)


def is_blank(line: Column) -> Column:
    return line.rlike(r"^\s*$")
