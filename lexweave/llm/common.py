"""Expressions and readers that several operators here share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import save

#: Fixed values of the term definition: the marker the preprocessing step leaves in a line.
MARKER = "zxzxpz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compared_form(c: Column | str) -> Column:
    """A form as it is compared: lower case, runs of blanks and ``_`` made one blank, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_]+", " "))


def usable_number(c: Column | str) -> Column:
    """True where a double is neither null nor NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


#: Rows of a list of words or names that is collected and sent to every task.
MOST_LISTED = 1_000_000


def whole_list(df: DataFrame, what: str) -> list:
    """All rows of a list that must be small; ``ValueError`` if it has more than ``MOST_LISTED``, so none is left out unseen."""
    rows = df.limit(MOST_LISTED + 1).collect()
    if len(rows) > MOST_LISTED:
        raise ValueError(f"{what} has more than {MOST_LISTED} rows, too many to send to every task")
    return rows


#: Repeated keys that are broadcast, a few dozen bytes each; more of them are joined by a shuffle.
MOST_BROADCAST_KEYS = 200_000


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys found in more than one row, with a broadcast hint if they are few.

    Only the narrow key columns are read and shuffled.
    """
    known = df.select(*keys)
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    t = save(known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated-keys").df
    return F.broadcast(t) if t.count() <= MOST_BROADCAST_KEYS else t


def first_deliveries(df: DataFrame, keys: list[str], arrived: str, repeated: DataFrame) -> DataFrame:
    """One row per key, the one that arrived first, without shuffling the payload.

    The few rows of repeated keys are deduplicated; all other rows pass by an
    anti join.  Among equal arrival times any one row stays, as deliveries of a
    key have the same content.  Rows with a null key are kept as they are.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(arrived).asc_nulls_last())
    again = df.join(repeated, keys, "left_semi")
    first = again.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return df.join(repeated, keys, "left_anti").unionByName(first)
