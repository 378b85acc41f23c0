"""Streaming forms: lines that keep arriving, counted as they come.

The batch operators' expressions are used unchanged on a stream; counts are a
stateful aggregation, with a watermark so that state of past windows is let go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ngrams import tokens
from ..operators.ngrams import preprocessed as _preprocessed


def preprocessed(stream: DataFrame, processor: str) -> DataFrame:
    """Lines of a stream after a processor; blank ones are dropped."""
    return _preprocessed(stream, processor)


def windowed_counts(stream: DataFrame, max_n: int, time: str, window: str, lateness: str) -> DataFrame:
    """(``window``, ``n``, ``form``, ``cnt``) of a stream of lines with a time column; lines later than ``lateness`` are left out."""
    w = stream.withWatermark(time, lateness).select(time, tokens(F.col("line")).alias("w"))
    at = w.select(time, "w", F.posexplode("w").alias("i", "first"))
    room = F.least(F.lit(max_n), F.size("w") - F.col("i"))
    grams = F.transform(F.sequence(F.lit(1), room), lambda n: F.struct(n.alias("n"), F.concat_ws(" ", F.slice("w", F.col("i") + 1, n)).alias("form")))
    g = at.select(time, F.explode(grams).alias("g")).select(time, "g.n", "g.form")
    return g.groupBy(F.window(time, window), "n", "form").agg(F.count("*").alias("cnt"))
