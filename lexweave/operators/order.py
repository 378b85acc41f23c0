"""Numbers and first rows of a whole table in an order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save


def numbered(df: DataFrame, order: list, name: str = "place", start: int = 0) -> DataFrame:
    """``df`` with a column ``name``: the place of each row in the order, from ``start``, without gaps.

    A range sort spreads the rows over the tasks; each row has its number in
    its task, and the counts per task, one row each, give every task its offset.
    ``order`` should settle ties.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = save(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted").df
    offsets, at = [], start
    for r in x.groupBy(F.shiftright("__at", 33).alias("p")).count().orderBy("p").collect():
        offsets += [F.lit(r["p"]), F.lit(at).cast("long")]
        at += r["count"]
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    place = F.element_at(F.create_map(*offsets), F.shiftright("__at", 33)) + local if offsets else local
    return x.withColumn(name, place.cast("long")).drop("__at")


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in an order."""
    if n <= 0:
        return df.limit(0)
    return numbered(df, order, "__place").where(F.col("__place") < n).drop("__place")
