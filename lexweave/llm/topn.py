"""Top N items within every group: hot-cold split.

Exact group counts divide the rows.  Light groups go through an ordinary
window: one shuffle on the group.  Heavy groups never meet in one task: their
rows are range-sorted on (group, score, tie, salt), so one group covers many
tasks in the order of the ranks.  Each task numbers its rows of a group itself
and lets only the first N pass, whatever N is; a row's rank is its number plus
the rows that earlier tasks kept of its group, a table of one row per task and
group.  No task sees a heavy group whole, and none is ranked again.

Defined results: rows with a null group form a group of their own; null and
NaN scores rank last; an exact tie in score and tie columns is broken by a hash
of the whole row, so runs agree; fewer than N rows give all of them; an empty
table gives an empty result.  Columns the caller has under any name are kept.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..scratch import save
from .common import compared_form, table, usable_number

#: At most this many groups can be heavy, whatever the data, as the limit below rises with the number of rows.
MOST_HEAVY_GROUPS = 20_000


def _numbered(batches, group: str, n: int):
    """Sorted batches of a task with its number and each row's number within the group, from 1; only the first ``n`` of a group."""
    part = TaskContext.get().partitionId()
    last, count = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(group)
        if pa.types.is_floating(col.type):  # so that NaN equals itself
            col = pc.cast(col, pa.string())
        runs = pc.run_end_encode(col)
        ends, values = runs.run_ends.to_pylist(), runs.values
        first = values[0].as_py()
        if last is None or last[0] != first:
            count = 0
        keep, number, at = [], [], 0
        for end in ends:
            take = min(end - at, max(0, n - count))
            keep.append(pa.array(range(at, at + take), pa.int64()))
            number.append(pa.array(range(count + 1, count + take + 1), pa.int64()))
            final = count + end - at
            at, count = end, 0
        last, count = (values[len(values) - 1].as_py(),), final
        kept, number = b.take(pa.concat_arrays(keep)), pa.concat_arrays(number)
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.repeat(pa.scalar(part, pa.int32()), len(number)), number], [*kept.schema.names, "__part", "__number"])


def top_n_per_group(
    df: DataFrame,
    group: str,
    score: str,
    ties: list[Column],
    n: int,
    heavy_rows: int = 5_000,
    rank_col: str = "rank_no",
) -> DataFrame:
    """The first ``n`` rows of every ``group`` by ``score`` descending, then ``ties``.

    ``df`` is read three times, so pass a written table if it is costly.
    A group is heavy if it has more than max(``heavy_rows``, rows / 20,000)
    rows; the set of heavy groups therefore has at most 20,000 rows and may be
    broadcast.
    """
    total = df.count()
    limit = max(heavy_rows, total // MOST_HEAVY_GROUPS)
    heavy = save(
        df.groupBy(F.col(group).alias("__heavy")).agg(F.count("*").alias("__rows")).where(F.col("__rows") > limit),
        "heavy-groups",
    ).df.select("__heavy")
    is_heavy = df[group].eqNullSafe(heavy["__heavy"])
    light = df.join(F.broadcast(heavy), is_heavy, "left_anti")
    hot = df.join(F.broadcast(heavy), is_heavy, "left_semi")

    kind = df.schema[score].dataType.typeName()
    value = F.when(~F.isnan(score), F.col(score)) if kind in ("double", "float") else F.col(score)
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() != "map"])
    order = [value.desc_nulls_last(), *ties, salt]
    ranked = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    cold = light.withColumn(rank_col, ranked).where(F.col(rank_col) <= n)
    if heavy.isEmpty():
        return cold

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = hot.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    schema = StructType([*spread.schema.fields, StructField("__part", IntegerType()), StructField("__number", LongType())])
    kept = save(spread.mapInArrow(lambda batches: _numbered(batches, group, n), schema), "hot-rows").df
    size = kept.groupBy(F.col("__part").alias("__p"), F.col(group).alias("__g")).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    # Sorted tasks meet a group in a row, so there are at most as many rows as tasks and heavy groups together.
    size = size.select("__p", "__g", F.coalesce(before, F.lit(0)).alias("__before"))
    hot = kept.join(F.broadcast(size), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    hot = hot.withColumn(rank_col, (F.col("__number") + F.col("__before")).cast("int")).where(F.col(rank_col) <= n)
    return cold.unionByName(hot.select(*cold.columns))


def thesaurus_candidates(thesaurus: DataFrame) -> DataFrame:
    """One entry per pair of compared forms: the highest ``overall``, then the smallest ``entry_id``."""
    t = thesaurus.where(F.col("p1").isNotNull() & F.col("p2").isNotNull() & usable_number("overall"))
    t = t.select(compared_form("p1").alias("form_1"), compared_form("p2").alias("form_2"), "overall", "entry_id")
    t = t.where(F.col("form_1") != F.col("form_2"))
    best = F.max(F.struct(F.col("overall"), (-F.col("entry_id")).alias("neg_id"))).alias("best")
    return (
        t.groupBy("form_1", "form_2")
        .agg(best)
        .select("form_1", "form_2", F.col("best.overall").alias("overall"), (-F.col("best.neg_id")).alias("entry_id"))
    )


def best_entries(thesaurus: DataFrame, n: int) -> DataFrame:
    one = save(thesaurus_candidates(thesaurus), "candidates").df
    return top_n_per_group(one, "form_1", "overall", [F.col("form_2").asc()], n)


def p2_found(spark, sf_dir: str) -> DataFrame:
    return best_entries(table(spark, sf_dir, "thesaurus"), 5).select("entry_id")


def p2_top_entries(spark, sf_dir: str) -> DataFrame:
    """The same with rank and forms, ten per headword."""
    t = best_entries(table(spark, sf_dir, "thesaurus"), 10)
    return t.select("form_1", "form_2", "overall", "entry_id", F.col("rank_no").cast("long").alias("rank_no"))


_CANDIDATES = """
WITH t AS (
  SELECT entry_id, overall,
    trim(regexp_replace(lower(p1), '[\\s_]+', ' ', 'g')) AS form_1,
    trim(regexp_replace(lower(p2), '[\\s_]+', ' ', 'g')) AS form_2
  FROM thesaurus WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND overall IS NOT NULL AND NOT isnan(overall)
), one AS (
  SELECT form_1, form_2, overall, entry_id FROM t WHERE form_1 <> form_2
  QUALIFY row_number() OVER (PARTITION BY form_1, form_2 ORDER BY overall DESC, entry_id) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY form_1 ORDER BY overall DESC, form_2) AS rank_no FROM one
)
"""

QUERIES = {"p2_found": p2_found, "p2_top_entries": p2_top_entries}
SQL = {
    "p2_found": _CANDIDATES + "SELECT entry_id FROM ranked WHERE rank_no <= 5",
    "p2_top_entries": _CANDIDATES + "SELECT form_1, form_2, overall, entry_id, rank_no FROM ranked WHERE rank_no <= 10",
}
