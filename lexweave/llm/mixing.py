"""Mixing sources to target weights by Poisson replication.

For each mix a total size is chosen, and from it each source's mean number of
repeats, r = target tokens / tokens there are.  Every document gets a uniform
number from a hash of (seed, mix, document), and the inverse of a Poisson
distribution makes a count of it; the document is repeated that often.  So each
document is decided for itself, without a sort or a pass over its source, and
the same in every run.  Copies are finally ordered by another hash, a global
shuffle by a range sort.

Where a source has a cap on repeats, counts above it are cut off and the
distribution's mean is raised so that the mean after the cut is r; at r = cap
every document is repeated cap times.

Total size.  By default the largest at which every source of the mix that has
documents can keep its share within its cap, and not more than the tokens those
sources hold.  A given total may exceed that: sources at their cap then give
cap times their tokens, and the others share the rest by their targets.
Sources without documents give nothing; the other targets are scaled up.

Defined results: documents without text and with sources the mix doesn't name
(also null) are not selected; a null or non-positive share selects nothing; a
null cap is none; targets given twice count once; empty tables give empty
results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .common import table
from .packing import sized_documents

#: From this mean on, the distribution table holds only counts around the mean; lower probabilities are below the 53 bits of a uniform number.
WINDOW_MEAN = 500.0


def poisson_table(mean: float, cap: int | None) -> tuple[int, list[float]]:
    """``first``, and cumulative probabilities of counts ``first``, ``first`` + 1, ... whose mean is ``mean`` after cutting counts off at ``cap``."""
    if mean <= 0:
        return 0, [1.0]
    if cap is not None and mean >= cap:
        return cap, [1.0]

    def cumulative(lam: float) -> tuple[int, list[float]]:
        first, out = 0, []
        if lam >= WINDOW_MEAN:
            root = math.sqrt(lam)
            first = int(lam - 9 * root)
            acc = 0.0
            for k in range(first, int(lam + 12 * root + 40)):
                acc += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
                out.append(acc)
            out = [x / acc for x in out]
        else:
            p, total, k = math.exp(-lam), 0.0, 0
            while total < 1 - 1e-12 and (k <= lam or p > 1e-18):
                total += p
                out.append(total)
                k += 1
                p *= lam / k
        if cap is not None:
            if first >= cap:
                return cap, [1.0]
            out = out[: cap + 1 - first]
        out[-1] = 1.0
        return first, out

    def mean_of(t: tuple[int, list[float]]) -> float:
        return t[0] + sum(1 - x for x in t[1])

    if cap is None:
        return cumulative(mean)
    low, high = mean, mean + 1.0
    while mean_of(cumulative(high)) < mean:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean_of(cumulative(mid)) < mean else (low, mid)
    return cumulative(high)


def poisson_cut_off(mean: float, cap: int | None) -> list[float]:
    """Cumulative probabilities of ``poisson_table`` from count 0 on."""
    first, out = poisson_table(mean, cap)
    return [0.0] * first + out


def plan_mix(tokens: dict[str, int], shares: dict[str, float], caps: dict[str, int | None], total: float | None = None) -> dict[str, float]:
    """Mean repeats of each source."""
    live = {s: w for s, w in shares.items() if w and w > 0 and tokens.get(s)}
    if not live:
        return {}
    scale = sum(live.values())
    live = {s: w / scale for s, w in live.items()}
    limit = {s: (math.inf if caps.get(s) is None else float(max(0, caps[s]))) for s in live}
    if total is None:
        total = min(float(sum(tokens[s] for s in live)), *(limit[s] * tokens[s] / w for s, w in live.items()))
    rates: dict[str, float] = {}
    rest, open_ = float(total), dict(live)
    while open_:
        weight = sum(open_.values())
        over = [s for s, w in open_.items() if rest * w / weight > limit[s] * tokens[s] * (1 + 1e-9)]
        if not over:
            rates |= {s: min(limit[s], rest * w / weight / tokens[s]) for s, w in open_.items()}
            break
        for s in over:
            rates[s] = limit[s]
            rest -= limit[s] * tokens[s]
            del open_[s]
    return rates


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a hash; 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 1, total_tokens: float | None = None) -> DataFrame:
    """Documents (``doc_id``, ``source``, ``n_tokens``) to the copies each mix of ``targets`` selects, in shuffled order.

    ``targets``: ``mix_name``, ``source``, ``target_share``, ``max_repeats``.
    Result: a row per copy, with the source's target and actual share of the
    mix.  Tables of sources and mixes are small: a row per source, and one per
    target.
    """
    spark = docs.sparkSession
    docs = docs.where("n_tokens > 0 and source is not null")
    goals = targets.where("source is not null and mix_name is not null").dropDuplicates(["mix_name", "source"]).collect()
    named = sorted({g["source"] for g in goals})
    held = docs.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect() if named else []
    tokens = {r["source"]: r["t"] for r in held}
    rows = []
    for name in sorted({g["mix_name"] for g in goals}):
        mine = [g for g in goals if g["mix_name"] == name]
        caps = {g["source"]: g["max_repeats"] for g in mine}
        rates = plan_mix(tokens, {g["source"]: g["target_share"] for g in mine}, caps, total_tokens)
        for g in mine:
            if rates.get(g["source"], 0) > 0:
                rows.append((name, g["source"], float(g["target_share"]), float(rates[g["source"]]), *poisson_table(rates[g["source"]], caps[g["source"]])))
    plan = spark.createDataFrame(rows, "mix_name string, source string, target_share double, mean_repeats double, first int, cumulative array<double>")
    u = uniform(seed, F.col("mix_name"), F.col("doc_id"))
    # The count is the first of the table and the number of cumulative probabilities that the uniform number has reached.
    count = F.col("first") + F.aggregate("cumulative", F.lit(0), lambda n, c: n + F.when(c <= F.col("u"), 1).otherwise(0))
    chosen = docs.join(F.broadcast(plan), "source").withColumn("u", u).withColumn("n_copies", count).where("n_copies > 0")
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("got"))
    whole = got.groupBy("mix_name").agg(F.sum("got").alias("whole"))
    actual = got.join(whole, "mix_name").select("mix_name", "source", (F.col("got") / F.col("whole")).alias("actual_share"))
    copies = chosen.join(F.broadcast(actual), ["mix_name", "source"]).select(
        "mix_name", "source", "doc_id", "n_tokens", "target_share", "actual_share", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy_no")
    )
    place = F.xxhash64(F.lit(seed + 1), "mix_name", "doc_id", "copy_no").alias("shuffle_key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.withColumn("shuffle_key", place)
    return copies.repartitionByRange(parts, "mix_name", "shuffle_key").sortWithinPartitions("mix_name", "shuffle_key")


def p8_mix(spark, sf_dir: str) -> DataFrame:
    return mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """Per target: the share it asks for and the share its source got (0 without documents)."""
    m = p8_mix(spark, sf_dir)
    got = m.groupBy("mix_name", "source").agg(
        F.count("*").alias("copies"), F.count_distinct("doc_id").alias("docs"), F.sum("n_tokens").alias("tokens"), F.first("actual_share").alias("actual_share")
    )
    t = table(spark, sf_dir, "mix_targets").select("mix_name", "source", "target_share")
    none = {"copies": 0, "docs": 0, "tokens": 0, "actual_share": 0.0}
    return t.join(got, ["mix_name", "source"], "left").fillna(none).withColumn("actual_share", F.round("actual_share", 6))


def p8_checks(spark, sf_dir: str) -> DataFrame:
    """Per mix: its targets, documents above their source's cap of repeats, copies of sources without a target, copies
    numbered with a gap, and whether the shares of its sources sum up to 1 (0 in a mix without documents)."""
    t = table(spark, sf_dir, "mix_targets").select("mix_name", "source", "max_repeats").dropDuplicates(["mix_name", "source"])
    m = save(p8_mix(spark, sf_dir).select("mix_name", "source", "doc_id", "copy_no", "actual_share"), "mixed").df
    per = m.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("last"), F.first("actual_share").alias("share"))
    per = per.groupBy("mix_name", "source").agg(F.max("n").alias("most"), F.count_if(F.col("n") != F.col("last")).alias("gaps"), F.first("share").alias("share"))
    both = t.withColumn("aimed", F.lit(1)).join(per, ["mix_name", "source"], "full_outer")
    return both.groupBy("mix_name").agg(
        F.sum(F.coalesce("aimed", F.lit(0))).alias("targets"),
        F.count_if(F.col("most") > F.col("max_repeats")).alias("over_cap"),
        F.count_if(F.col("aimed").isNull()).alias("strangers"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"),
        (F.abs(F.coalesce(F.sum("share"), F.lit(1.0)) - 1) < 1e-9).alias("whole"),
    )


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checks": p8_checks}
SQL = {
    "p8_checks": """SELECT mix_name, count(*) AS targets, 0::BIGINT AS over_cap, 0::BIGINT AS strangers, 0::BIGINT AS gaps, true AS whole
FROM (SELECT DISTINCT mix_name, source FROM mix_targets) GROUP BY mix_name""",
}
