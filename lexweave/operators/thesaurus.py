"""A thesaurus: pairs of terms alike in meaning and in spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import distance as D
from ..functions.phrase import normalised as normal_phrase
from ..functions.scores import overall
from ..functions.text import has_marker
from ..functions.vector import normalised
from ..scratch import save
from .similarity import similar_pairs


def with_letters(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("form").rlike("[A-Za-z]"))


def ortho_distance(a: Column, b: Column, penalty: float | None) -> Column:
    return D.reordered(a, b, penalty) / F.greatest(F.length(a), F.length(b))


def abbr_distance(a: Column, b: Column) -> Column:
    return F.least(D.abbreviation(a, b) / F.length(a), D.abbreviation(b, a) / F.length(b))


def build_thesaurus(vectors: DataFrame, s: Settings) -> DataFrame:
    """(``p1``, ``p2``, ``overall``, ``semantic``, ``ortho``, ``abbr``) from (``form``, ``vec``).

    Terms without a letter and tokens that the processor put in take no part.
    Steps by cost: dot products first, spelling distances only on pairs that
    pass, reordered words only where they can win.
    """
    terms = with_letters(vectors).where(~has_marker(F.col("form"), s.processor)).select("form", normalised(F.col("vec")).alias("vec"))
    pairs = similar_pairs(terms, s.semantic_minimum).withColumnsRenamed({"a": "p1", "b": "p2"})
    scored = pairs.withColumn("ortho", ortho_distance(F.col("p1"), F.col("p2"), s.permutation_penalty)).withColumn(
        "abbr", abbr_distance(F.col("p1"), F.col("p2"))
    )
    kept = scored.where((F.col("ortho") <= s.ortho_maximum) | (F.col("abbr") <= s.abbr_maximum))
    kept = kept.withColumn("overall", overall(F.col("semantic"), F.col("ortho"), F.col("abbr"), s.semantic_ortho_ratio))
    if s.overall_threshold is not None:
        kept = kept.where(F.col("overall") >= s.overall_threshold)
    return kept.select("p1", "p2", "overall", "semantic", "ortho", "abbr")


def trimmed(thesaurus: DataFrame, minimum: float) -> DataFrame:
    return thesaurus.where(F.col("overall") >= minimum)


def undirected(thesaurus: DataFrame) -> DataFrame:
    """One of each two entries that differ in direction only; entries with other scores stay."""
    t = thesaurus.withColumn("a", F.least("p1", "p2")).withColumn("b", F.greatest("p1", "p2"))
    return t.groupBy("a", "b", "overall", "semantic", "ortho", "abbr").agg(F.min("p1").alias("p1")).select(
        F.col("a").alias("p1"), F.col("b").alias("p2"), "overall", "semantic", "ortho", "abbr"
    )


def equivalents(thesaurus: DataFrame, asked: DataFrame, processor=None, case_sensitive: bool = False) -> DataFrame:
    """Entries of asked headwords (column ``form``); a processor cleans them first, else the form is only normalised."""
    form = processor(F.col("form")) if processor else F.col("form")
    form = normal_phrase(form if case_sensitive else F.lower(form))
    return asked.select(form.alias("p1")).distinct().join(thesaurus, "p1")


def entries(thesaurus: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries of asked pairs (``p1``, ``p2``)."""
    return thesaurus.join(pairs.select("p1", "p2").distinct(), ["p1", "p2"], "left_semi")


def with_entries(thesaurus: DataFrame, more: DataFrame) -> DataFrame:
    return thesaurus.unionByName(more)


#: Entries of a headword that are gathered in one row; those of a larger one come in several.
MOST_IN_A_ROW = 100_000


def in_rows(df: DataFrame, key: str, order: list, entry, most: int = MOST_IN_A_ROW) -> DataFrame:
    """(``key``, ``part``, ``x``): the ``entry`` structs of each key in the order, gathered.

    A key of more than ``most`` rows never meets in one task: its rows are
    range-sorted and it gets a row per task, numbered in the order by ``part``.
    """
    counts = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    heavy = save(counts.where(F.col("__n") > most).select("__k"), "heavy-keys").df  # at most rows / most
    gather = lambda d, *by: d.groupBy(key, *by).agg(F.sort_array(F.collect_list(F.struct(*order, entry.alias("__e")))).alias("x"))
    is_heavy = F.col(key).eqNullSafe(F.col("__k"))
    light = gather(df.join(F.broadcast(heavy), is_heavy, "left_anti")).withColumn("part", F.lit(0))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = df.join(F.broadcast(heavy), is_heavy, "left_semi").repartitionByRange(parts, key, *order)
    hot = gather(hot.withColumn("part", F.spark_partition_id()), "part")
    return light.unionByName(hot).select(key, "part", F.transform("x", lambda s: s["__e"]).alias("x"))


_SCORES = ("overall", "semantic", "ortho", "abbr")


def nested(thesaurus: DataFrame, most: int = MOST_IN_A_ROW) -> DataFrame:
    """A row per headword with its entries, best first; several rows, numbered by ``part``, for one of more than ``most``."""
    entry = F.struct(F.col("p2").alias("form"), *_SCORES)
    return in_rows(thesaurus, "p1", [F.coalesce(-F.col("overall"), F.lit(float("inf"))).alias("k"), F.col("p2")], entry, most).select(F.col("p1").alias("head"), "part", F.col("x").alias("entries"))
