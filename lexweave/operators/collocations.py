"""Phrases found by normalised pointwise mutual information of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import phrase as P
from ..functions.scores import npmi_of_counts
from ..scratch import save

BOOTSTRAP_SCORE = 0.1


def total_words(counts: DataFrame) -> int:
    return counts.where("n = 1").agg(F.sum("cnt")).first()[0] or 0


def _counted(counts: DataFrame, n: int, form: str, cnt: str) -> DataFrame:
    return counts.where(F.col("n") == n).select(F.col("form").alias(form), F.col("cnt").alias(cnt))


def split_scores(counts: DataFrame, n: int, total: int) -> DataFrame:
    """n-grams with ``lead_score`` (all but the last word, last word) and ``trail_score`` (first word, all but the first); 0 where a part has no count."""
    g = counts.where(F.col("n") == n).select(
        "form",
        "cnt",
        P.leading(F.col("form")).alias("lead"),
        P.last_word(F.col("form")).alias("last"),
        P.first_word(F.col("form")).alias("first"),
        P.trailing(F.col("form")).alias("trail"),
    )
    g = g.join(_counted(counts, n - 1, "lead", "c_lead"), "lead", "left").join(_counted(counts, 1, "last", "c_last"), "last", "left")
    all_words = F.lit(float(total))
    if n == 2:
        score = npmi_of_counts(F.col("c_lead"), F.col("c_last"), F.col("cnt"), all_words)
        return g.select("form", "cnt", score.alias("lead_score"), score.alias("trail_score"), "lead", "trail", "first", "last", F.lit(None).cast("long").alias("c_first"), "c_last")
    g = g.join(_counted(counts, n - 1, "trail", "c_trail"), "trail", "left").join(_counted(counts, 1, "first", "c_first"), "first", "left")
    return g.select(
        "form",
        "cnt",
        npmi_of_counts(F.col("c_lead"), F.col("c_last"), F.col("cnt"), all_words).alias("lead_score"),
        npmi_of_counts(F.col("c_first"), F.col("c_trail"), F.col("cnt"), all_words).alias("trail_score"),
        "lead",
        "trail",
        "first",
        "last",
        "c_first",
        "c_last",
    )


def next_order(counts: DataFrame, found: DataFrame, n: int, total: int, s: Settings) -> DataFrame:
    """Collocations of order ``n`` given those of ``n`` - 1."""
    g = split_scores(counts, n, total)
    if n == 2:
        return g.where(F.col("lead_score") > s.threshold(2)).select("form", F.lit(2).alias("n"), F.col("lead_score").alias("score"))
    lower = found.where(F.col("n") == n - 1).select("form")
    g = g.join(lower.select(F.col("form").alias("lead"), F.lit(True).alias("has_lead")), "lead", "left")
    g = g.join(lower.select(F.col("form").alias("trail"), F.lit(True).alias("has_trail")), "trail", "left")
    score = F.greatest(F.lit(0.0), F.when(F.col("has_lead"), F.col("lead_score")), F.when(F.col("has_trail"), F.col("trail_score")))
    passed = score >= s.threshold(n)
    kept = F.when(passed, score)
    if n == 3:
        skip = npmi_of_counts(F.col("c_first"), F.col("c_last"), F.col("cnt"), F.lit(float(total)))
        kept = F.when(passed, score).when(skip > s.threshold(2), skip)
    return g.withColumn("score", kept).where("score is not null").select("form", F.lit(n).alias("n"), "score")


def ends_in_words(found: DataFrame) -> DataFrame:
    """Without phrases whose first or last word has no letter, digit or underscore."""
    f = F.col("form")
    return found.where(P.first_word(f).rlike(r"\w") & P.last_word(f).rlike(r"\w"))


def bootstrapped(found: DataFrame, n: int) -> DataFrame:
    """Phrases of ``n`` + 1 words from two of ``n`` that overlap in all but one."""
    p = found.where(F.col("n") == n)
    a = p.select(F.col("form").alias("a"), P.trailing(F.col("form")).alias("k"))
    b = p.select(P.last_word(F.col("form")).alias("w"), P.leading(F.col("form")).alias("k"))
    return a.join(b, "k").select(F.concat_ws(" ", "a", "w").alias("form"), F.lit(n + 1).alias("n"), F.lit(BOOTSTRAP_SCORE).alias("score")).distinct()


def collocations(counts: DataFrame, s: Settings, bootstrap: bool = True, filtered: bool = True) -> DataFrame:
    """(``form``, ``n``, ``score``) of all orders.

    ``counts`` are pruned and read several times per order, so pass a written
    table.  Each order's result is small against the counts and is written, as
    the next order reads it.
    """
    total = total_words(counts)
    parts, last = [], None
    for n in range(2, s.max_ngram_order + 1):
        last = save(next_order(counts, last, n, total, s), f"collocations-{n}").df
        parts.append(last)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if filtered:
        found = ends_in_words(found)
    if bootstrap:
        grown = found.where(F.col("n") == s.max_ngram_order)
        for n in range(s.max_ngram_order, s.max_phrase_length):
            grown = save(bootstrapped(grown, n), f"collocations-{n + 1}").df
            found = found.unionByName(grown)
    return found


def phrase_scores(phrases: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """``form``, ``n``, ``best`` and ``skip`` of phrases of 2 to max order words that are counted: the better split's NPMI without any gate, and that of first and last word."""
    total, out = total_words(counts), None
    wanted = phrases.select("form").distinct()
    for n in range(2, s.max_ngram_order + 1):
        g = split_scores(counts, n, total).join(wanted, "form", "left_semi")
        skip = npmi_of_counts(F.col("c_first"), F.col("c_last"), F.col("cnt"), F.lit(float(total))) if n > 2 else F.col("lead_score")
        g = g.select("form", F.lit(n).alias("n"), F.greatest("lead_score", "trail_score").alias("best"), skip.alias("skip"))
        out = g if out is None else out.unionByName(g)
    return out


def score_summary(scored: DataFrame) -> DataFrame:
    """Phrases and mean best score per order, and of all as order 0."""
    by_n = scored.rollup("n").agg(F.count("*").alias("phrases"), F.avg("best").alias("mean_npmi"))
    return by_n.select(F.coalesce("n", F.lit(0)).alias("n"), "phrases", "mean_npmi")


def top_phrases(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` with the highest score, ties by form descending."""
    return found.orderBy(F.desc("score"), F.desc("form")).limit(n)


def precision(found: DataFrame, gold: DataFrame, top: int) -> DataFrame:
    """Share of the ``top`` phrases (below 1: of all) that are in ``gold``."""
    best = top_phrases(found, top) if top >= 1 else found
    hit = gold.select("form").distinct().withColumn("hit", F.lit(1))
    return best.join(hit, "form", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("precision"), F.count("*").alias("phrases"))


def of_length(found: DataFrame, n: int) -> DataFrame:
    return found.where(F.col("n") == n)


def put(found: DataFrame, more: DataFrame) -> DataFrame:
    """Union in which ``more`` replaces phrases of the same form."""
    return found.join(more.select("form"), "form", "left_anti").select("form", "n", "score").unionByName(more.select("form", "n", "score"))


def removed(found: DataFrame, gone: DataFrame) -> DataFrame:
    return found.join(gone.select("form"), "form", "left_anti")


def score_of(found: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked forms with their score, 0 if unknown."""
    return asked.select("form").join(found.select("form", "score"), "form", "left").select("form", F.coalesce("score", F.lit(0.0)).alias("score"))
