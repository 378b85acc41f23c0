"""Rewriting lines with collocations joined: leftmost, longest match first."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import tokens

#: Phrases whose dictionary is sent to all workers, some hundred bytes each; more are joined.
MOST_BROADCAST_PHRASES = 300_000


def _index(phrases: list[str]) -> dict[str, dict[int, set[tuple[str, ...]]]]:
    out: dict = defaultdict(lambda: defaultdict(set))
    for p in phrases:
        w = tuple(p.split(" "))
        out[w[0]][len(w)].add(w)
    return {k: dict(sorted(v.items(), reverse=True)) for k, v in out.items()}


def longest_at(words: list[str], i: int, index: dict) -> int:
    """Words of the longest phrase that starts at ``i``; 0 for none."""
    for n, forms in index.get(words[i], {}).items():
        if i + n <= len(words) and tuple(words[i : i + n]) in forms:
            return n
    return 0


def joined_words(words: list[str], index: dict) -> list[str]:
    out, i = [], 0
    while i < len(words):
        n = longest_at(words, i, index) or 1
        out.append("_".join(words[i : i + n]))
        i += n
    return out


def apply_collocations(line_table: DataFrame, found: DataFrame, keep_case: bool = True, broadcast_limit: int = MOST_BROADCAST_PHRASES) -> DataFrame:
    """``line`` with the words of each phrase joined by ``_`` and single blanks between words; other columns are kept.

    Matching is case-sensitive; lower-casing, if asked for, comes after it.  Up
    to ``broadcast_limit`` phrases the dictionary is broadcast and lines aren't
    shuffled; beyond it the n-grams of each position are joined with the
    phrases and the line is folded together from the longest match per position.
    """
    spark = line_table.sparkSession
    forms = found.select("form").where(F.col("form").contains(" ")).distinct()
    few = forms.limit(broadcast_limit + 1).collect()
    if len(few) <= broadcast_limit:
        shared = spark.sparkContext.broadcast(_index([r["form"] for r in few]))

        @F.pandas_udf("string")
        def rewrite(w: pd.Series) -> pd.Series:
            index = shared.value
            return w.map(lambda x: None if x is None else " ".join(joined_words(list(x), index)))

        line = rewrite(tokens(F.col("line")))
        return line_table.withColumn("line", line if keep_case else F.lower(line))

    keyed = line_table.withColumn("__key", F.struct(F.monotonically_increasing_id().alias("a"), F.xxhash64("line").alias("b")))
    w = keyed.select("__key", tokens(F.col("line")).alias("w"))
    longest = forms.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1
    at = w.select("__key", "w", F.posexplode("w").alias("i", "first"))
    starts = forms.select(F.substring_index("form", " ", 1).alias("first")).distinct()
    room = F.least(F.lit(longest), F.size("w") - F.col("i"))
    grams = F.transform(F.sequence(F.lit(1), room), lambda n: F.struct(n.alias("n"), F.concat_ws(" ", F.slice("w", F.col("i") + 1, n)).alias("form")))
    cand = at.join(starts, "first", "left_semi").select("__key", "i", F.explode(grams).alias("g")).select("__key", "i", "g.n", "g.form").where("n > 1")
    hits = cand.join(forms, "form", "left_semi").groupBy("__key", "i").agg(F.max("n").alias("n"))
    per_line = hits.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("hit"))
    none = F.create_map().cast("map<int,int>")
    both = w.join(per_line, "__key", "left").withColumn("hit", F.coalesce("hit", none))
    state = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))

    def fold(s, i):
        n = F.coalesce(F.try_element_at("hit", i), F.lit(1))
        word = F.array_join(F.slice("w", i + 1, n), "_")
        return F.when(i < s["free"], s).otherwise(F.struct((i + n).alias("free"), F.concat(s["out"], F.array(word)).alias("out")))

    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    line = F.array_join(F.aggregate(places, state, fold, lambda s: s["out"]), " ")
    done = both.select("__key", (line if keep_case else F.lower(line)).alias("__line"))
    return keyed.join(done, "__key").withColumn("line", F.col("__line")).drop("__key", "__line")
