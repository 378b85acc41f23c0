"""Lines, n-grams and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the source is a few files; a larger source keeps its splits and isn't shuffled."""
    spark = df.sparkSession
    cores = int(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def lines(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ``line_no``, ``line``) of the lines of each text; null texts have none."""
    return documents.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def preprocessed(line_table: DataFrame, processor: str) -> DataFrame:
    """Lines after a processor; blank lines are dropped."""
    return line_table.where(~T.is_blank(F.col("line"))).withColumn("line", T.processor(processor)(F.col("line")))


def tokens(line: Column) -> Column:
    """Words of a line, parted at white space; a blank line has none."""
    edge = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(edge == "", F.array().cast("array<string>")).otherwise(F.split(edge, r"\s+"))


def ngrams(line_table: DataFrame, max_n: int) -> DataFrame:
    """(``n``, ``form``) of every n-gram of 1 to ``max_n`` words; none crosses a line."""
    w = line_table.select(tokens(F.col("line")).alias("w"))
    at = w.select("w", F.posexplode("w").alias("i", "first"))
    room = F.least(F.lit(max_n), F.size("w") - F.col("i"))
    grams = F.transform(
        F.sequence(F.lit(1), room), lambda n: F.struct(n.alias("n"), F.concat_ws(" ", F.slice("w", F.col("i") + 1, n)).alias("form"))
    )
    return at.select(F.explode(grams).alias("g")).select("g.n", "g.form")


def ngram_counts(line_table: DataFrame, max_n: int, min_count: int = 1) -> DataFrame:
    """(``n``, ``form``, ``cnt``) with counts of at least ``min_count``; one shuffle, counts are summed before it."""
    counts = ngrams(line_table, max_n).groupBy("n", "form").agg(F.count("*").alias("cnt"))
    return counts.where(F.col("cnt") >= min_count)


def merged_counts(parts: DataFrame) -> DataFrame:
    """Counts of several parts summed per form, white space normalised."""
    form = F.regexp_replace(F.trim("form"), r"\s+", " ")
    return parts.where("form is not null").groupBy("n", form.alias("form")).agg(F.sum("cnt").alias("cnt"))


def pruned(counts: DataFrame, min_count: int, processor: str = "moderate") -> DataFrame:
    """Counts without forms that hold a marker or are too rare."""
    return counts.where((F.col("cnt") >= min_count) & ~T.has_marker(F.col("form"), processor))
