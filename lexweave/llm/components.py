"""Consolidating pairwise matches into groups: alternating large-star and small-star.

Every form gets an integer in the order of the forms, so the smallest integer
of a component is its smallest form.  A round rewrites the edge table twice:

* large-star: each node links its larger neighbours to the smallest node of
  its neighbourhood;
* small-star: each node links itself and its smaller neighbours to the
  smallest of them.

Both are an aggregation and a join on the node.  Nodes with very many edges
(at most ``MOST_HUBS``, as the limit rises with the number of edges) take their
minimum from a broadcast table, so no task holds all edges of a hub.  Each
round is written as a table; the edge set stays unchanged at the end and is
then a star around every component's minimum.

Defined results: null members and pairs of a form with itself link nothing; a
form without a link is no row; repeated and reversed pairs count once; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import Table, save
from .common import compared_form, table, usable_number

MOST_HUBS = 20_000


def _with_minimum(d: DataFrame, n_edges: int) -> tuple[DataFrame, Table]:
    """Edges (u, v) with ``m``, the smallest v of each u; and the table of minima, to be dropped after use.

    The minima are written first, with the largest degree observed on the way,
    so the way round hubs is planned only where there are hubs.
    """
    degree = Observation()
    low = d.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    low = save(low.observe(degree, F.max("n").alias("most")), "minima")
    limit = max(1_000, 2 * n_edges // MOST_HUBS)
    minima = low.df.select("u", "m")
    if (degree.get["most"] or 0) <= limit:
        return d.join(minima, "u"), low
    hub = low.df.where(F.col("n") > limit).select("u", "m")
    at_hubs = d.join(F.broadcast(hub), "u")
    rest = d.join(F.broadcast(hub.select("u")), "u", "left_anti").join(minima, "u")
    return at_hubs.unionByName(rest), low


def _large_star(edges: DataFrame, n_edges: int) -> tuple[DataFrame, Table]:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    x, low = _with_minimum(both, n_edges)
    return x.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), low


def _small_star(edges: DataFrame, n_edges: int) -> tuple[DataFrame, Table]:
    """``edges`` has u > v."""
    x, low = _with_minimum(edges, n_edges)
    itself = F.struct(F.col("u"), F.col("m").alias("v"))
    other = F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    pairs = x.select(F.explode(F.array(itself, other)).alias("e")).select("e.u", "e.v")
    return pairs.where("u <> v").distinct(), low


def _written(edges: DataFrame, name: str) -> tuple[Table, tuple]:
    seen = Observation()
    t = save(
        edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")), name
    )
    return t, (seen.get["n"], seen.get["x"])


def star_components(edges: DataFrame) -> DataFrame:
    """(``u``, ``v``) of integers to (``node``, ``component``), the component's smallest node."""
    first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, state = _written(first, "edges")
    while state[0]:
        large, low = _large_star(now.df, state[0])
        between, met = _written(large, "edges")
        low.drop()
        small, low = _small_star(between.df, met[0])
        after, reached = _written(small, "edges")
        for gone in (low, between, now):
            gone.drop()
        now, before, state = after, state, reached
        if before == state:
            break
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v")).distinct()
    )


def group_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of forms to (``form``, ``group_form``)."""
    links = save(
        pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("a <> b")
        .distinct(),
        "links",
    )
    forms = links.df.select(F.explode(F.array("a", "b")).alias("form")).distinct()
    parts = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range order plus order within the partition makes the numbers ascend with the forms; written once, so they stay.
    numbered = save(
        forms.repartitionByRange(parts, "form")
        .sortWithinPartitions("form")
        .withColumn("id", F.monotonically_increasing_id()),
        "forms",
    ).df
    edges = (
        links.df.join(numbered.select(F.col("form").alias("a"), F.col("id").alias("v")), "a")
        .join(numbered.select(F.col("form").alias("b"), F.col("id").alias("u")), "b")
        .select("u", "v")
    )
    comp = star_components(edges)
    named = numbered.select(F.col("id").alias("component"), F.col("form").alias("group_form"))
    return (
        comp.join(numbered.select(F.col("id").alias("node"), "form"), "node")
        .join(named, "component")
        .select("form", "group_form")
    )


def p6_found(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "thesaurus").where(usable_number("overall") & (F.col("overall") >= 0.8))
    return group_pairs(t.select(compared_form("p1").alias("a"), compared_form("p2").alias("b")))


def p6_group_sizes(spark, sf_dir: str) -> DataFrame:
    return p6_found(spark, sf_dir).groupBy("group_form").agg(F.count("*").alias("n_forms"))


_GROUPS = """
WITH RECURSIVE l AS (
  SELECT DISTINCT trim(regexp_replace(lower(p1), '[\\s_]+', ' ', 'g')) AS a,
    trim(regexp_replace(lower(p2), '[\\s_]+', ' ', 'g')) AS b
  FROM thesaurus WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND overall >= 0.8 AND NOT isnan(overall)
), e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r(form, g) AS (
  SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.form WHERE r.g < e.b
), f AS (SELECT form, min(g) AS group_form FROM r GROUP BY form)
"""

QUERIES = {"p6_found": p6_found, "p6_group_sizes": p6_group_sizes}
SQL = {
    "p6_found": _GROUPS + "SELECT form, group_form FROM f",
    "p6_group_sizes": _GROUPS + "SELECT group_form, count(*) AS n_forms FROM f GROUP BY group_form",
}
