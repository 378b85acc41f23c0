"""Vectors: pairs above a similarity, nearest vectors, analogies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..scratch import save
from .order import numbered

#: Rows a block of the pairwise comparison holds at most and at least; two of the largest are some 80 MB at 300 columns.
BLOCK_ROWS, LEAST_BLOCK_ROWS = 32_768, 1_024
#: Queries whose vectors are broadcast at once; more are compared in several blocks.
MOST_BROADCAST_QUERIES = 50_000


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def similar_pairs(vectors: DataFrame, minimum: float, key: str = "form", vec: str = "vec") -> DataFrame:
    """(``a``, ``b``, ``semantic``) of all ordered pairs of different keys whose dot product is at least ``minimum``.

    An exact comparison in blocks: keys are hashed to blocks of at most some
    ``BLOCK_ROWS`` rows, smaller ones only to give every core a pair of them,
    and each pair of blocks is one task that multiplies two matrices in tiles.
    A vector travels once per block.  Rows near the limit are settled in double.  Keys
    are distinct; null vectors and keys take no part; a pair is computed once
    and given in both orders.
    """
    v = vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")).where("key is not null and vec is not null")
    rows = v.count()
    tasks = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-rows // BLOCK_ROWS), min(rows // LEAST_BLOCK_ROWS, int((2 * tasks) ** 0.5)))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    tasks = v.withColumn("own", own).select("key", "vec", "own", F.explode(other).alias("x"))
    tasks = tasks.select("key", "vec", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own = t.column("own").to_numpy()
        keys, m = t.column("key").combine_chunks(), _matrix(t.column("vec"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        pa_, pb_, ps = [], [], []
        for s in range(0, len(left), 2_048):
            l = left[s : s + 2_048]
            for q in range(0, len(right), 4_096):
                r = right[q : q + 4_096]
                x, y = np.nonzero(m[l] @ m[r].T >= minimum - 1e-3)
                x, y = l[x], r[y]
                keep = x < y if i == j else np.ones(len(x), bool)
                x, y = x[keep], y[keep]
                dot = np.einsum("ij,ij->i", m[x].astype(np.float64), m[y].astype(np.float64))
                ok = dot >= minimum
                pa_.append(x[ok])
                pb_.append(y[ok])
                ps.append(dot[ok])
        x, y, d = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (pa_, pb_, ps))
        a, b = np.concatenate([x, y]).astype(np.int64), np.concatenate([y, x]).astype(np.int64)
        return pa.table({"a": keys.take(pa.array(a)), "b": keys.take(pa.array(b)), "semantic": pa.array(np.concatenate([d, d]).astype(np.float64))})

    kind = v.schema["key"].dataType.simpleString()
    return tasks.groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, semantic double")


def top_n_similar(vectors: DataFrame, queries: DataFrame, n: int, key: str = "rank", vec: str = "vec") -> DataFrame:
    """(``query``, ``key``, ``similarity``, ``place``): the ``n`` rows with the highest dot product with each query vector, ties by smaller key; the query itself takes part.

    ``queries`` has ``query`` and ``vec``.  Up to ``MOST_BROADCAST_QUERIES`` are
    broadcast; more are hashed to blocks of at most about that many, and each
    block is compared with all rows.  Every task keeps only ``n`` rows of each
    query before the shuffle.
    """
    asked = queries.where("vec is not null").select("query", "vec")
    count = asked.count()
    if count <= MOST_BROADCAST_QUERIES:
        return _top_n_of_block(vectors, asked, n, key, vec)[0]
    blocks = -(-count * 21 // (20 * MOST_BROADCAST_QUERIES))  # hashed, they differ by a few hundredths
    asked = save(asked.withColumn("block", F.pmod(F.xxhash64("query", "vec"), F.lit(blocks))), "queries").df
    out = None
    for b in range(blocks):
        part, shared = _top_n_of_block(vectors, asked.where(F.col("block") == b).drop("block"), n, key, vec)
        part = save(part.drop("place"), "top-n").df  # so that the vectors of one block are held at a time
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return _placed(out, n)


def _placed(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _top_n_of_block(vectors: DataFrame, queries: DataFrame, n: int, key: str, vec: str):
    held = queries.toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((held.column("query").combine_chunks() if held.num_rows else None, _matrix(held.column("vec"))))

    def nearest(batches):
        asked, q = shared.value
        if asked is None:
            return
        q = q.astype(np.float64)
        for b in batches:
            if not b.num_rows:
                continue
            keys, m = b.column("key").to_numpy(zero_copy_only=False), _matrix(b.column("vec")).astype(np.float64)
            for s in range(0, len(q), 1_024):
                sim = q[s : s + 1_024] @ m.T
                k = min(n, sim.shape[1])
                # Ties at the cut stay in, so the order by key below is exact.
                cut = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
                x, y = np.nonzero(sim >= cut[:, None] - 1e-9)
                yield pa.RecordBatch.from_arrays(
                    [asked.take(pa.array(x + s)), pa.array(keys[y]), pa.array(sim[x, y])], ["query", "key", "similarity"]
                )

    source = vectors.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec")).where("vec is not null")
    kind = queries.schema["query"].dataType.simpleString()
    part = source.mapInArrow(nearest, f"query {kind}, key long, similarity double")
    return _placed(part, n), shared


def most_similar(vectors: DataFrame, queries: DataFrame, key: str = "rank", vec: str = "vec") -> DataFrame:
    return top_n_similar(vectors, queries, 1, key, vec).select("query", "key", "similarity")


def analogy_vector(vectors: DataFrame, plus: list, minus: list, key: str = "rank", vec: str = "vec") -> DataFrame:
    """One row ``vec``: the sum of the vectors of ``plus`` less those of ``minus``; unknown keys are ignored."""
    sign = F.when(F.col(key).isin(plus), 1.0).otherwise(0.0) - F.when(F.col(key).isin(minus), 1.0).otherwise(0.0)
    at = vectors.where(F.col(key).isin([*plus, *minus])).select(sign.alias("sign"), F.posexplode(vec).alias("i", "x"))
    summed = at.groupBy("i").agg(F.sum(F.col("sign") * F.col("x").cast("double")).alias("x"))
    ordered = summed.agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))  # a row per component
    return ordered.select(F.transform("v", lambda s: s["x"].cast("float")).alias("vec"))


def kept_terms(vectors: DataFrame, terms: DataFrame) -> DataFrame:
    """Vectors of the listed terms, ranked anew without gaps."""
    kept = vectors.join(terms.select("form"), "form", "left_semi")
    return numbered(kept.withColumnRenamed("rank", "__rank"), [F.col("__rank")], "rank").drop("__rank")


def first_of_each_term(vectors: DataFrame) -> DataFrame:
    """One row per term, the one of the lowest rank, as terms that come again are ignored."""
    rest = [c for c in vectors.columns if c not in ("form", "rank")]
    one = vectors.groupBy("form").agg(F.min("rank").alias("rank"), F.min_by(F.struct(*rest), "rank").alias("x"))
    return one.select("rank", "form", "x.*")


def with_frequencies(vectors: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``vectors`` with ``freq`` of those terms that ``frequencies`` (``form``, ``freq``) names, -1 where it names none; unknown terms are ignored."""
    return vectors.drop("freq").join(frequencies.select("form", "freq"), "form", "left").withColumn("freq", F.coalesce("freq", F.lit(-1).cast("long")))


def all_words_known(phrases: DataFrame, vectors: DataFrame) -> DataFrame:
    """Phrases of which every word has a vector."""
    w = phrases.select("form", F.explode(F.split("form", " ")).alias("w")).distinct()
    unknown = w.join(vectors.select(F.col("form").alias("w")), "w", "left_anti").select("form")
    return phrases.join(unknown, "form", "left_anti")


def scored_by(vectors: DataFrame, query: list[float], vec: str = "vec") -> DataFrame:
    """All rows with their dot product with one vector."""
    return vectors.withColumn("similarity", V.dot(F.col(vec), F.array(*[F.lit(float(x)) for x in query])))
