"""Most similar vectors for every vector: inverted lists with an adaptive dimension scan.

Index.  Vectors are scaled to length 1 and turned by a random rotation, after
which every block of columns carries the same share of a distance on average.
A k-means on a bounded sample gives the list centres (crowded centres are split
again); every row is assigned to its nearest list and, as a query, to its
``probes`` nearest lists.  A list of more than ``MOST_HOME`` rows is cut into
parts by a hash of the id, and what probes the list goes to each part, so no
task holds more than some ``MOST_HOME`` rows and their visitors.  Rows travel as
16-bit codes, whose rounding changes a cosine by some 1e-5.

Search.  A task holds one list.  Partial distances over the first block of
columns are computed for its queries against its rows.  Of a difference vector
turned at random, the share d' / whole of the first d of D columns has a
Beta(d/2, (D-d)/2) distribution; the hypothesis that the whole distance is
within the limit is rejected, and the candidate abandoned, if d' is more than
the limit times the 1 - ``ERROR`` quantile.  Survivors go on to the next block
of columns, at last to the whole distance.  The limit is the k-th best distance
of the query so far, or the distance at ``min_similarity`` if that is smaller;
it is tightened after every tile of rows, those nearest to the middle of the
list first.  A first round compares the rows of a list with each other; each
row takes the limit it has then along to the other lists it probes.

A pair met in a list counts for both of its rows, so it is found if either row
probes the other's list, and is abandoned only if the limits of both reject it.

Exact copies are searched once: they are grouped by a 128-bit hash of the
vector, the smallest id stands for them, and answers are expanded afterwards to
what each copy's own k best are, ties by smaller id.

A part of the rows.  Where only some rows ask, only they probe other lists, and
rows that don't ask have no limit to keep a pair for.  ``nearest_of_asked`` is
the exact comparison with all rows, by which recall is measured.

Defined results: a vector is unusable if null, of another length, not finite or
all zero, and is then neither query nor answer; a null id makes a row unusable;
rows loaded twice (same id and content) count once; fewer than k others give
fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from .common import table

#: Rows the centres are trained on, taken by a hash of the id: 16 a list, at least and at most this many (100 MB at 96 columns).
FEWEST_SAMPLED, MOST_SAMPLED = 32_768, 262_144
#: Rows of a list that one task compares; a larger list is cut into parts.
MOST_HOME = 8_192
#: Rows and queries that are compared at once; limits are tightened after each tile of rows.
TILE, QUERY_TILE = 256, 4_096
#: Chance that one test abandons a pair that is just within the limit.
ERROR = 1e-3
#: By how much similarities of codes may be off.
SLACK = 1e-4
#: Bytes of codes a task of the search reads.
TASK_BYTES = 32 << 20
#: Asked rows whose vectors are broadcast at once, some 16 MB at 96 columns; more are compared in several blocks.
MOST_ASKED = 20_000


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def column_blocks(dim: int) -> list[tuple[int, int]]:
    cuts = sorted({0, max(1, dim // 4), max(1, dim // 2), max(1, 3 * dim // 4), dim})
    return list(zip(cuts, cuts[1:]))


def largest_share(d: int, dim: int, error: float = ERROR) -> float:
    """The 1 - ``error`` quantile of the share that ``d`` of ``dim`` columns have in a squared distance."""
    if d >= dim:
        return 1.0
    x = (np.arange(200_000) + 0.5) / 200_000
    log = (d / 2 - 1) * np.log(x) + ((dim - d) / 2 - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(log - log.max()))
    return float(x[np.searchsorted(mass, (1 - error) * mass[-1])])


def usable_rows(vec: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable vectors of a list array."""
    import pyarrow.compute as pc

    ok = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vec), dim), False).to_numpy(zero_copy_only=False), bool)
    rows = np.flatnonzero(ok)
    flat = vec.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null components become NaN
    good = np.isfinite(x).all(1)
    top = np.abs(np.where(np.isfinite(x), x, 0)).max(1, initial=0)
    good &= top > 0
    x, rows = x[good] / top[good][:, None], rows[good]
    return rows, x / np.sqrt((x * x).sum(1))[:, None]


def encode(u: np.ndarray) -> np.ndarray:
    """Codes of rotated unit vectors: a float scale and 16-bit columns, as bytes."""
    scale = (np.abs(u).max(1) / 32_767).astype("<f4")
    q = np.rint(u / scale[:, None]).astype("<i2")
    return np.concatenate([scale.view(np.uint8).reshape(-1, 4), q.view(np.uint8).reshape(len(u), -1)], axis=1)


def decode(col: pa.Array, dim: int) -> np.ndarray:
    n, width = len(col), 4 + 2 * dim
    raw = np.frombuffer(col.buffers()[2], np.uint8)[: (col.offset + n) * width].reshape(-1, width)[col.offset :]
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    x = np.ascontiguousarray(raw[:, 4:]).view("<i2").astype(np.float32) * scale
    return x / np.sqrt((x * x).sum(1))[:, None]


def train_centres(x: np.ndarray, lists: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; a centre with over four times the mean share is split until none is left or it can't be."""
    rng = np.random.default_rng(seed)

    def nearest(c):
        return np.concatenate([(x[s : s + 8192] @ c.T).argmax(1) for s in range(0, len(x), 8192)])

    def kmeans(rows, k):
        pts = x[rows]
        c = pts[rng.choice(len(pts), min(k, len(pts)), replace=False)].copy()
        for _ in range(rounds):
            a = np.concatenate([(pts[s : s + 8192] @ c.T).argmax(1) for s in range(0, len(pts), 8192)])
            m = np.zeros_like(c)
            np.add.at(m, a, pts)
            norm = np.linalg.norm(m, axis=1)
            c[norm > 0] = m[norm > 0] / norm[norm > 0, None]
        return c

    if not len(x):
        return np.zeros((1, x.shape[1]), np.float32)
    c = kmeans(np.arange(len(x)), lists)
    for _ in range(3):
        a = nearest(c)
        size = np.bincount(a, minlength=len(c))
        mean = max(8, len(x) / lists)
        big = np.flatnonzero(size > 4 * mean)
        if not len(big):
            break
        parts = [np.delete(c, big, axis=0)]
        parts += [kmeans(np.flatnonzero(a == b), int(np.ceil(size[b] / mean))) for b in big]
        c = np.concatenate(parts)
    return c.astype(np.float32)


class Best:
    """The ``k`` highest similarities each row has met, and its limit: the k-th of them, at least ``least``."""

    def __init__(self, limit: np.ndarray, k: int) -> None:
        self.k, self.limit = k, limit.astype(np.float32)
        self.top = np.full((len(limit), k), -np.inf, np.float32)

    def add(self, owner: np.ndarray, sim: np.ndarray) -> None:
        near = sim > np.maximum(self.limit[owner], self.top[owner, -1])
        owner, sim = owner[near], sim[near]
        if not len(owner):
            return
        o = np.lexsort((-sim, owner))
        owner, sim = owner[o], sim[o]
        start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
        row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(owner))))
        keep = place < self.k
        fresh = np.full((len(start), self.k), -np.inf, np.float32)
        fresh[row[keep], place[keep]] = sim[keep]
        rows = owner[start]
        both = np.concatenate([self.top[rows], fresh], axis=1)
        self.top[rows] = -np.sort(-both, axis=1)[:, : self.k]
        self.limit[rows] = np.maximum(self.limit[rows], self.top[rows, -1])


def scan(q: np.ndarray, x: np.ndarray, limit_q: np.ndarray, limit_x: np.ndarray, k: int, same: bool = False, met: np.ndarray | None = None):
    """(query row, list row, similarity) of pairs that may be among the ``k`` best of either, and the queries' limits.

    ``limit_q`` and ``limit_x`` are similarities a pair must reach for either
    row; infinite for a row that asks for nothing.  ``same``: both are the same
    rows, and each pair is met once.  ``met`` counts the pairs that enter each
    block of columns.
    """
    dim = x.shape[1]
    blocks = column_blocks(dim)
    share = [largest_share(b, dim) for _, b in blocks]
    best_q = Best(limit_q, k)
    best_x = best_q if same else Best(limit_x, k)
    # Half the squared length of the columns up to each block's end.
    half_q, half_x = ([(m[:, :b] ** 2).sum(1) / 2 for _, b in blocks] for m in (q, x))
    found = []
    for xs in range(0, len(x), TILE):
        xe = min(len(x), xs + TILE)
        for qs in range(xs if same else 0, len(q), QUERY_TILE):
            qe = min(len(q), qs + QUERY_TILE)
            # Of a pair, half the partial distance is half_q + half_x - dot; half the limit is 1 - similarity.
            lim_q = 1 - best_q.limit[qs:qe] + SLACK
            lim_x = 1 - best_x.limit[xs:xe] + SLACK
            dot = np.zeros((qe - qs, xe - xs), np.float32)
            i = j = None
            for (a, b), s, hq, hx in zip(blocks, share, half_q, half_x, strict=True):
                if met is not None:
                    met[blocks.index((a, b))] += dot.size if i is None else len(i)
                if i is None:
                    dot += q[qs:qe, a:b] @ x[xs:xe, a:b].T
                    rest = dot - hx[None, xs:xe]
                    near = rest >= (hq[qs:qe] - lim_q * s)[:, None]
                    if np.isfinite(lim_x).any():
                        near |= rest - hq[qs:qe, None] >= -(lim_x * s)[None, :]
                    if b == dim or np.count_nonzero(near) < 0.2 * near.size:  # few are left: go on pair by pair
                        i, j = np.nonzero(near)
                        part = dot[i, j]
                    continue
                for c in range(0, len(i), 1 << 18):
                    e = c + (1 << 18)
                    part[c:e] += np.einsum("ij,ij->i", q[qs + i[c:e], a:b], x[xs + j[c:e], a:b])
                live = hq[qs + i] + hx[xs + j] - part <= np.maximum(lim_q[i], lim_x[j]) * s
                i, j, part = i[live], j[live], part[live]
            i, j = i + qs, j + xs
            if same:
                once = i > j
                i, j, part = i[once], j[once], part[once]
            found.append((i, j, part))
            best_q.add(i, part)
            best_x.add(j, part)
    if not found:
        return (*(np.zeros(0, int),) * 2, np.zeros(0, np.float32), best_q.limit)
    return (*(np.concatenate(z) for z in zip(*found, strict=True)), best_q.limit)


def best_of(owner: np.ndarray, sim: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Mask of rows that are among the k best of their owner, or within ``slack`` of the k-th."""
    o = np.lexsort((-sim, owner))
    w, s = owner[o], sim[o]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, int)
    size = np.diff(np.append(start, len(w)))
    kth = np.repeat(s[start + np.minimum(size, k) - 1], size)
    mask = np.zeros(len(owner), bool)
    mask[o] = s >= kth - slack
    return mask


class Nearest:
    """The k best rows of each asked vector so far, ties by smaller id.

    ``q``: unit vectors in double; ``q_ids``: their ids, which are no answers
    to themselves.  Similarities are settled in double and to 9 places.
    """

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> None:
        self.q, self.q_ids, self.k = q, q_ids, k
        self.single = q.astype(np.float32)
        self.sim = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), -1, np.int64)

    def add(self, ids: np.ndarray, u: np.ndarray) -> None:
        ids, first = np.unique(ids, return_index=True)  # loaded twice: the same vector
        u = u[first]
        x, k = u.astype(np.float32), self.k
        for s in range(0, len(self.q), 1_024):
            e = min(len(self.q), s + 1_024)
            dot = self.single[s:e] @ x.T
            cut = self.sim[s:e, -1]
            if len(x) > k and not np.isfinite(cut).all():  # k others besides the query itself
                cut = np.maximum(cut, np.partition(dot, len(x) - k - 1, axis=1)[:, len(x) - k - 1])
            i, j = np.nonzero(dot >= (cut - 1e-5).astype(np.float32)[:, None])
            other = self.q_ids[s + i] != ids[j]
            i, j = i[other] + s, j[other]
            if not len(i):
                continue
            sim = np.concatenate([np.einsum("ij,ij->i", self.q[i[a : a + 65_536]], u[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)])
            open_ = np.unique(i)
            held = np.repeat(open_, k)
            i, near = np.concatenate([held, i]), np.concatenate([self.ids[open_].ravel(), ids[j]])
            sim = np.concatenate([self.sim[open_].ravel(), np.round(sim, 9)])
            o = np.lexsort((near, -sim, i))
            i, near, sim = i[o], near[o], sim[o]
            once = np.concatenate([[True], (i[1:] != i[:-1]) | (near[1:] != near[:-1])]) | (near < 0) & np.isneginf(sim)
            i, near, sim = i[once], near[once], sim[once]
            start = np.searchsorted(i, open_)
            rows = start[:, None] + np.arange(k)
            self.ids[open_], self.sim[open_] = near[rows], sim[rows]


def nearest_of_asked(d: DataFrame, k: int, dim: int, min_similarity: float, queries) -> DataFrame:
    """The answer of ``similar_vectors`` for the rows of ``d`` (``id``, ``vec``) that meet ``queries``: exact, compared with every row.

    A task keeps the k best of each asked row over all of its rows, so it hands
    on k rows for each at most.  Every block of asked rows reads the table again.
    """
    spark = d.sparkSession
    asked = d.withColumnRenamed("id", "query_id").where(queries).dropDuplicates(["query_id"])
    if (count := asked.count()) > MOST_ASKED:
        blocks = -(-count * 21 // (20 * MOST_ASKED))  # hashed, they differ by a few hundredths
        asked = save(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(blocks))), "asked").df
        parts = [asked.where(F.col("block") == b).drop("block") for b in range(blocks)]
    else:
        parts = [asked]

    def of_part(part: DataFrame) -> DataFrame:
        held = part.select("query_id", "vec").toArrow()
        keep, unit = usable_rows(held.column("vec").combine_chunks(), dim) if held.num_rows else (np.zeros(0, int), np.zeros((0, dim)))
        shared = spark.sparkContext.broadcast((unit, held.column("query_id").to_numpy()[keep]))

        def compare(batches):
            best = Nearest(*shared.value, k)
            for b in batches:
                rows, u = usable_rows(b.column("vec"), dim)
                if len(rows):
                    best.add(b.column("id").to_numpy()[rows], u)
            i, c = np.nonzero(np.isfinite(best.sim) & (best.sim >= min_similarity))
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.q_ids[i]), pa.array(best.ids[i, c]), pa.array(best.sim[i, c])], ["query_id", "near_id", "similarity"]
            )

        met = d.mapInArrow(compare, "query_id long, near_id long, similarity double")
        met = met.groupBy("query_id", "near_id").agg(F.max("similarity").alias("similarity"))
        by_query = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "near_id")
        out = met.withColumn("rank_no", F.row_number().over(by_query)).where(F.col("rank_no") <= k)
        if len(parts) > 1:  # one block's vectors are held at a time
            out = save(out, "nearest").df
            shared.destroy()
        return out

    out = of_part(parts[0])
    for part in parts[1:]:
        out = out.unionByName(of_part(part))
    return out.select("query_id", "near_id", "similarity", "rank_no")


def exact_similarities(d: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (``rep``, ``near``) with the cosine of both rows of ``d`` (``id``, ``vec``), in double and to 9 places."""
    needed = pairs.select(F.explode(F.array("rep", "near")).alias("id")).distinct()
    double = F.transform("vec", lambda x: x.cast("double"))
    v = d.join(needed, "id", "left_semi").dropDuplicates(["id"]).select("id", double.alias("v"))
    v = save(v.withColumn("size", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "exact").df
    a = v.select(F.col("id").alias("rep"), F.col("v").alias("va"), F.col("size").alias("na"))
    b = v.select(F.col("id").alias("near"), F.col("v").alias("vb"), F.col("size").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "rep").join(b, "near").select("rep", "near", F.round(dot / F.col("na") / F.col("nb"), 9).alias("similarity"))


_ROWS = "id long, near long, similarity double, part int, lists array<int>, code binary"


def similar_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int,
    dim: int,
    min_similarity: float = -1.0,
    probes: int | None = None,
    queries=None,
) -> DataFrame:
    """(``query_id``, ``near_id``, ``similarity``, ``rank_no``): up to ``k`` most similar rows of each usable row, itself left out.

    Rows below ``min_similarity`` are left out; it also starts the limit of the
    scan, so a high value makes the search faster.  ``queries`` is a condition
    (Column) on ``query_id`` for the rows that ask.  ``probes`` is the number of
    lists a row visits, by default a sixth of them, at least 8, as near rows
    lie in any list if nothing is very similar.  The number of lists rises with
    the rows: rows / 600 while small, then 1.2 times their root, as far as the
    sample has 8 rows a list; with fewer lists than probes the search is
    exhaustive but for the tests' error.
    """
    spark = df.sparkSession
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    if queries is not None:
        ask = d.select("id", "vec", F.col("id").alias("query_id")).withColumn("ask", F.coalesce(queries, F.lit(False))).select("id", "vec", "ask")
    else:
        ask = d.withColumn("ask", F.lit(True))
    rows = d.count()
    lists = int(max(1, min(rows // 600, 1.2 * np.sqrt(rows), MOST_SAMPLED // 8)))
    turn = rotation(dim)
    wanted = min(MOST_SAMPLED, max(FEWEST_SAMPLED, 16 * lists))
    step = -(-rows // wanted)
    sample = d.where(F.pmod(F.xxhash64("id"), F.lit(max(1, step))) == 0).dropDuplicates(["id"]).orderBy("id").limit(2 * MOST_SAMPLED).select("vec").toArrow()
    vec = sample.column("vec").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float32()))
    _, unit = usable_rows(vec, dim)
    centres = train_centres((unit @ turn).astype(np.float32), lists)
    probes = min(max(8, len(centres) // 6) if probes is None else probes, len(centres))
    shared = spark.sparkContext.broadcast((turn, centres))  # at most some 13 MB at 96 columns

    def index(batches):
        turn, centres = shared.value
        for b in batches:
            keep, unit = usable_rows(b.column("vec"), dim)
            raw = b.column("vec").take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            digest = [hashlib.blake2b((r + 0.0).tobytes(), digest_size=16).digest() for r in raw]
            x = (unit @ turn).astype(np.float32)
            s = x @ centres.T
            near = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1).astype(np.int32)
            ask = b.column("ask").take(pa.array(keep))
            # A row that doesn't ask visits no list but its own.
            size = np.where(ask.to_numpy(zero_copy_only=False).astype(bool), probes, 1) if len(x) else np.zeros(0, int)
            near = near[np.arange(probes)[None] < size[:, None]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(near))
            width = 4 + 2 * dim
            code = pa.Array.from_buffers(
                pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(encode(x).tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(keep)), pa.array(digest, pa.binary()), ask, lists, code], ["id", "digest", "ask", "lists", "code"]
            )

    indexed = save(ask.mapInArrow(index, "id long, digest binary, ask boolean, lists array<int>, code binary"), "index")
    member = indexed.df.select("id", "digest", "ask").distinct()
    rep = member.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("ask").alias("rep_ask"))
    member = save(member.join(rep, "digest").select("id", "ask", "rep", "copies", "rep_ask"), "members").df
    # Only copies that stand for nobody are taken out; where there are none, this is a join with an empty table.
    one = indexed.df.join(member.where("id <> rep").select("id"), "id", "left_anti").drop("digest")
    if queries is not None:  # the row that stands for a copy that asks may have visited no list itself
        late = member.where("rep_ask and id = rep and not ask").select("id", F.lit(True).alias("late"))
        found = indexed.df.where("ask").join(member.where("copies > 1 and ask").select("id", "rep"), "id").groupBy(F.col("rep").alias("id")).agg(F.first("lists").alias("own"))
        one = one.join(late, "id", "left").join(found, "id", "left")
        one = one.select("id", (F.col("ask") | F.coalesce("late", F.lit(False))).alias("ask"), F.when(F.col("late"), F.col("own")).otherwise(F.col("lists")).alias("lists"), "code")
    # Parts of lists that are larger than a task should hold: a row per such list.
    size = indexed.df.groupBy(F.col("lists")[0].alias("list")).count().where(F.col("count") > MOST_HOME).collect()
    parts_of = {r["list"]: -(-r["count"] // MOST_HOME) for r in size}
    parts_of = F.create_map(*[F.lit(x) for kv in parts_of.items() for x in kv]) if parts_of else F.create_map().cast("map<int,int>")
    n_parts = lambda c: F.coalesce(F.try_element_at(parts_of, c), F.lit(1))
    one = one.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), n_parts(F.col("lists")[0])).cast("int"))
    tasks = lambda n: max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n * (2 * dim + 40) / TASK_BYTES) + 1)

    def columns(group: pa.Table, *names):
        ids = group.column("id").to_numpy()
        _, first = np.unique(ids, return_index=True)  # loaded twice: the same list and code
        t = group.take(pa.array(first))
        return t, t.column("id").to_numpy(), decode(t.column("code").combine_chunks(), dim)

    def result(pairs, t: pa.Table | None, limit: np.ndarray | None) -> pa.Table:
        a, b, sim = pairs
        n, m = len(a), 0 if t is None else t.num_rows
        out = {"id": pa.array(a), "near": pa.array(b), "similarity": pa.array(sim.astype(np.float64)), "part": pa.nulls(n, pa.int32()), "lists": pa.nulls(n, pa.list_(pa.int32())), "code": pa.nulls(n, pa.binary())}
        out = pa.table(out)
        if m:
            rows = {"id": t.column("id"), "near": pa.nulls(m, pa.int64()), "similarity": pa.array(limit.astype(np.float64)), "part": t.column("part"), "lists": t.column("lists"), "code": t.column("code")}
            out = pa.concat_tables([out, pa.table(rows).cast(out.schema)])
        return out

    def both_ways(a, b, sim, asks_a, asks_b):
        """Each pair for those of its rows that ask, and of each row the best."""
        owner, other = np.concatenate([a[asks_a], b[asks_b]]), np.concatenate([b[asks_a], a[asks_b]])
        both = np.concatenate([sim[asks_a], sim[asks_b]])
        keep = both >= min_similarity - SLACK
        owner, other, both = owner[keep], other[keep], both[keep]
        keep = best_of(owner, both, k, SLACK)
        return owner[keep], other[keep], both[keep]

    def at_home(group: pa.Table) -> pa.Table:
        t, ids, x = columns(group)
        asks = t.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(-(x @ x.mean(0)), kind="stable")  # rows near the middle are near to most
        start = np.where(asks, np.float32(min_similarity), np.float32(np.inf))
        if asks.all():
            i, j, sim, limit = scan(x[order], x[order], start[order], start[order], k, same=True)
            i, j, out = order[i], order[j], np.empty_like(limit)
            out[order] = limit
        else:
            q = np.flatnonzero(asks)
            i, j, sim, limit = scan(x[q], x[order], start[q], np.full(len(x), np.inf, np.float32), k + 1)  # a query meets itself
            i, j, out = q[i], order[j], start.copy()
            out[q] = limit
            keep = i != j
            i, j, sim = i[keep], j[keep], sim[keep]
            return result(both_ways(ids[i], ids[j], sim, np.ones(len(i), bool), np.zeros(len(i), bool)), t, out)
        return result(both_ways(ids[i], ids[j], sim, asks[i], asks[j]), t, out)

    home = one.select("id", "ask", "lists", "code", "part", F.col("lists")[0].alias("list"))
    first = save(home.repartition(tasks(rows), "list", "part").groupBy("list", "part").applyInArrow(at_home, _ROWS), "at-home").df
    kept = first.where("near is null").withColumnRenamed("similarity", "limit")

    def abroad(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        if home.all() or not home.any():
            return result((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), None, None)
        h, hid, x = columns(group.filter(pa.array(home)))
        v, vid, q = columns(group.filter(pa.array(~home)))
        lh, lv = h.column("limit").to_numpy().astype(np.float32), v.column("limit").to_numpy().astype(np.float32)
        order = np.argsort(-(x @ x.mean(0)), kind="stable")
        i, j, sim, _ = scan(q, x[order], lv, lh[order], k)
        j = order[j]
        return result(both_ways(vid[i], hid[j], sim, np.isfinite(lv[i]), np.isfinite(lh[j])), None, None)

    # A row visits all parts of the other lists, and of its own list the parts after its own (all others, if some rows don't ask).
    visits = kept.where(F.size("lists") > 1).select("id", "code", "limit", F.explode(F.slice("lists", 2, probes)).alias("list"))
    visits = visits.select("id", "code", "limit", "list", F.explode(F.sequence(F.lit(0), n_parts(F.col("list")) - 1)).alias("part"))
    own = kept.where(~F.isnan("limit") & (F.col("limit") < F.lit(float("inf")))).select("id", "code", "limit", F.col("lists")[0].alias("list"), F.col("part").alias("mine"))
    own = own.where(n_parts(F.col("list")) > 1).select("id", "code", "limit", "list", "mine", F.explode(F.sequence(F.lit(0), n_parts(F.col("list")) - 1)).alias("part"))
    own = own.where(F.col("part") > F.col("mine") if queries is None else F.col("part") != F.col("mine")).drop("mine")
    there = kept.select("id", "code", "limit", F.col("lists")[0].alias("list"), "part").withColumn("home", F.lit(True))
    visitors = visits.unionByName(own).withColumn("home", F.lit(False))
    asked_rows = rows if queries is None else member.where("ask").count()
    second = there.unionByName(visitors).repartition(tasks(rows + asked_rows * probes), "list", "part").groupBy("list", "part").applyInArrow(abroad, _ROWS)
    pairs = first.where("near is not null").unionByName(second).select(F.col("id").alias("rep"), "near", "similarity")
    met = pairs.groupBy("rep", "near").agg(F.max("similarity").alias("similarity"))
    by_rep = Window.partitionBy("rep").orderBy(F.desc("similarity"), "near")
    met = met.withColumn("rn", F.row_number().over(by_rep))
    if queries is None:
        met = save(met.where(F.col("rn") <= k).drop("rn"), "nearest").df
    else:  # few enough to settle what the rounding of codes leaves open
        last = F.max(F.when(F.col("rn") == k, F.col("similarity"))).over(Window.partitionBy("rep"))
        close = save(met.withColumn("last", last).where((F.col("rn") <= k) | (F.col("similarity") >= F.col("last") - SLACK)).select("rep", "near"), "nearest").df
        met = exact_similarities(d, close).where(F.col("similarity") >= min_similarity)

    # Back to all ids: the k + 1 first answers of a copy group hold the k first of each of its members.
    own = member.where("copies > 1 and id = rep").select("rep", F.col("rep").alias("near"), F.lit(1.0).alias("similarity"))
    first_copies = Window.partitionBy("rep").orderBy("id")
    copies = member.where("copies > 1").withColumn("rn", F.row_number().over(first_copies)).where(F.col("rn") <= k + 1)
    copies = copies.select(F.col("rep").alias("near"), "id")
    answers = met.unionByName(own).join(copies, "near", "left").select("rep", F.coalesce("id", "near").alias("near_id"), "similarity")
    by_answer = Window.partitionBy("rep").orderBy(F.desc("similarity"), "near_id")
    answers = answers.withColumn("rn", F.row_number().over(by_answer)).where(F.col("rn") <= k + 1).drop("rn")
    asked = member.where("ask").select(F.col("id").alias("query_id"), "rep")
    out = asked.join(answers, "rep").where("query_id <> near_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "near_id")
    out = out.withColumn("rank_no", F.row_number().over(by_query)).where(F.col("rank_no") <= k)
    return out.select("query_id", "near_id", "similarity", "rank_no")


DIM, K = 96, 5


def p1_found(spark, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "vectors"), "vec_id", "vec", K, DIM, min_similarity=0.8, probes=5)
    return near.select(
        F.least("query_id", "near_id").alias("vec_id_a"), F.greatest("query_id", "near_id").alias("vec_id_b")
    ).distinct()


def p1_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose id is divisible by 50, among all rows, whatever their similarity."""
    near = similar_vectors(table(spark, sf_dir, "vectors"), "vec_id", "vec", K, DIM, queries=F.col("query_id") % 50 == 0)
    return near.select("query_id", "near_id", F.round("similarity", 3).alias("similarity"))


def p1_recall(spark, sf_dir: str) -> DataFrame:
    """Of ``p1_nearest``: the pairs an exact comparison with all rows gives, and whether at least 95 of 100 are found (by similarity, as ties may fall either way)."""
    t = table(spark, sf_dir, "vectors")
    d = t.select(F.col("vec_id").cast("long").alias("id"), F.col("vec")).where("id is not null and vec is not null")
    true = nearest_of_asked(d, K, DIM, -1.0, F.col("query_id") % 50 == 0).select("query_id", "rank_no", F.col("similarity").alias("best"))
    found = similar_vectors(t, "vec_id", "vec", K, DIM, queries=F.col("query_id") % 50 == 0).select("query_id", "rank_no", "similarity")
    # Found in descending order of similarity: the i-th found is a true one if it is as similar as some true one not below it.
    both = true.join(found, ["query_id", "rank_no"], "left")
    last = both.groupBy("query_id").agg(F.min("best").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "query_id").where(F.col("similarity") >= F.col("last") - SLACK).groupBy("query_id").agg(F.count("*").alias("hit"))
    sums = last.join(hits, "query_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("true_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return sums.select("true_pairs", (F.col("hits") >= 0.95 * F.col("true_pairs")).alias("recall_is_95"))


_NEAR = """
WITH v AS (
  SELECT vec_id, list_transform(any_value(vec), lambda x: x::DOUBLE) AS vec FROM vectors
  WHERE len(vec) = 96 AND vec_id IS NOT NULL AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(vec, lambda x: x <> 0)) GROUP BY vec_id
), u AS (SELECT vec_id, vec, sqrt(list_dot_product(vec, vec)) AS norm FROM v),
s AS (
  SELECT x.vec_id AS q, y.vec_id AS a, list_dot_product(x.vec, y.vec) / x.norm / y.norm AS cos
  FROM u x JOIN u y ON x.vec_id <> y.vec_id
), r AS (SELECT q, a, cos, row_number() OVER (PARTITION BY q ORDER BY round(cos, 9) DESC, a) AS rank_no FROM s)
"""
QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest, "p1_recall": p1_recall}
SQL = {
    "p1_found": _NEAR
    + "SELECT DISTINCT least(q, a) AS vec_id_a, greatest(q, a) AS vec_id_b FROM r WHERE rank_no <= 5 AND cos >= 0.8",
    "p1_nearest": _NEAR + "SELECT q AS query_id, a AS near_id, round(cos, 3) AS similarity FROM r WHERE rank_no <= 5 AND q % 50 = 0",
    "p1_recall": _NEAR + "SELECT count(*) AS true_pairs, true AS recall_is_95 FROM r WHERE rank_no <= 5 AND q % 50 = 0",
}
