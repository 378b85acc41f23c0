"""Single-linkage clustering by a distributed maximum spanning forest.

Stopping a merge of best links first at k clusters equals the components of the
best (terms - k) edges of the maximum spanning forest, under a total order of
edges: score descending, then both forms.  The forest is found in rounds: every
cluster picks its best edge to another cluster, clusters follow their picks to
a common root by pointer doubling, and are merged.  Each round at least halves
the clusters that still have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .order import first_rows


def _edges(links: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``score``) with a < b, the best score of each pair."""
    e = links.where("p1 is not null and p2 is not null and score is not null and p1 <> p2")
    return e.groupBy(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).agg(F.max("score").alias("score"))


#: Edges from which on clusters with very many of them are relabelled by a broadcast; and how many make one of them.
MANY_EDGES, HUB_EDGES = 1_000_000, 50_000


def _relabelled(edges: DataFrame, end: str, up: DataFrame, written: DataFrame) -> DataFrame:
    """``edges`` with ``n`` + ``end``, the root that ``up`` (``r``, ``p``) names for each ``end``; ``written``: the table they come from.

    The edges of a large cluster would meet in one task of a join, so the roots
    of such clusters, at most 20,000, are broadcast.
    """
    to = up.select(F.col("r").alias(end), F.col("p").alias(f"n{end}"))
    count = written.count()
    if count <= MANY_EDGES:
        return edges.join(to, end)
    hubs = written.groupBy(end).agg(F.count("*").alias("__n")).where(F.col("__n") > max(HUB_EDGES, count // 20_000)).select(end)
    hubs = save(to.join(hubs, end), "hubs").df
    rest = edges.join(F.broadcast(hubs.select(end)), end, "left_anti").join(to, end)
    return rest.unionByName(edges.join(F.broadcast(hubs), end))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest edges, (``form``, ``root``) of all ends), roots being the smallest form of a component."""
    now = save(edges.select("a", "b", "score", F.col("a").alias("ra"), F.col("b").alias("rb")), "msf-edges")
    label = save(edges.select(F.explode(F.array("a", "b")).alias("form")).distinct().withColumn("root", F.col("form")), "msf-labels")
    chosen: list = []
    while not now.df.isEmpty():
        sides = now.df.select(F.explode(F.array(
            F.struct(F.col("ra").alias("r"), F.col("rb").alias("to"), "score", "a", "b"),
            F.struct(F.col("rb").alias("r"), F.col("ra").alias("to"), "score", "a", "b"),
        )).alias("x")).select("x.*")
        pick = sides.groupBy("r").agg(F.min(F.struct((-F.col("score")).alias("s"), "a", "b", "to")).alias("m"))
        picked = save(pick.select("r", F.col("m.to").alias("to"), F.col("m.a").alias("a"), F.col("m.b").alias("b"), (-F.col("m.s")).alias("score")), "msf-picks")
        pick = picked.df
        chosen.append(picked)
        # Two clusters that picked each other: the smaller is the root.
        back = pick.select(F.col("r").alias("to"), F.col("to").alias("back"))
        up = pick.join(back, "to", "left").select("r", F.when((F.col("back") == F.col("r")) & (F.col("r") < F.col("to")), F.col("r")).otherwise(F.col("to")).alias("p"))
        up = save(up, "msf-up")
        while True:
            nxt = up.df.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            step = save(up.df.join(nxt, "p").select("r", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "msf-up")
            up.drop()
            up = step
            if step.df.where("moved").isEmpty():
                break
        root = up.df.select(F.col("r").alias("root"), F.col("p").alias("new"))
        label2 = save(label.df.join(root, "root", "left").select("form", F.coalesce("new", "root").alias("root")), "msf-labels")
        after = _relabelled(_relabelled(now.df, "ra", up.df, now.df), "rb", up.df, now.df).select("a", "b", "score", F.col("nra").alias("ra"), F.col("nrb").alias("rb"))
        later = save(after.where("ra <> rb"), "msf-edges")
        now.drop()
        label.drop()
        up.drop()
        now, label = later, label2
    now.drop()
    forest = edges.select("a", "b", "score").limit(0)
    for c in chosen:
        forest = forest.unionByName(c.df.select("a", "b", "score"))
    forest = save(forest.distinct(), "msf-forest").df
    for c in chosen:
        c.drop()
    small = label.df.groupBy("root").agg(F.min("form").alias("least"))
    return forest, label.df.join(small, "root").select("form", F.col("least").alias("root"))


def cluster_by_count(links: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(``form``, ``cluster_id``) of all ``terms``: at most k clusters if links suffice; unlinked terms are clusters of their own."""
    e = _edges(links).join(terms.select(F.col("form").alias("a")), "a", "left_semi").join(terms.select(F.col("form").alias("b")), "b", "left_semi")
    forest, _ = spanning_forest(e)
    n = terms.select("form").distinct().count()
    best = first_rows(forest, [F.desc("score"), F.asc("a"), F.asc("b")], n - k)
    return _labelled(terms, best)


def cluster_by_threshold(links: DataFrame, terms: DataFrame, minimum: float) -> DataFrame:
    e = _edges(links).where(F.col("score") >= minimum)
    e = e.join(terms.select(F.col("form").alias("a")), "a", "left_semi").join(terms.select(F.col("form").alias("b")), "b", "left_semi")
    return _labelled(terms, e)


def _labelled(terms: DataFrame, edges: DataFrame) -> DataFrame:
    _, label = spanning_forest(edges.select("a", "b", "score"))
    return terms.select("form").distinct().join(label, "form", "left").select("form", F.coalesce("root", "form").alias("cluster_id"))


def representatives(clusters: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(``form``, ``cluster_id``, ``representative``): the most frequent member, ties by form; a member without frequency counts 0."""
    f = clusters.join(vocabulary.select("form", "freq"), "form", "left")
    best = f.groupBy("cluster_id").agg(F.min(F.struct((-F.coalesce("freq", F.lit(0))).alias("k"), "form")).alias("m"))
    return clusters.join(best.select("cluster_id", F.col("m.form").alias("representative")), "cluster_id").select("form", "cluster_id", "representative")


def sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))


def cluster_of(clusters: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked forms with their representative; a form in no cluster represents itself."""
    return asked.select("form").join(clusters.select("form", "representative"), "form", "left").select("form", F.coalesce("representative", "form").alias("representative"))
