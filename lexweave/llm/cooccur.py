"""Items that appear together: an incremental table of pair counts.

``PairCounts`` keeps, in a folder of its own, tables that later sessions open
again: pair counts in hash buckets of the pair, and term counts (records per
term) in hash buckets of the term.  A change set is a table of records with the
words they had before (``old``) and have now (``new``).  Each task turns its
changed records into signed deltas, +1 for a pair a record gains and -1 for one
it loses, sums them per chunk, and sends each bucket one compressed block.
Only buckets that some delta touches are read, merged and written again; the
others stay as they are.  A small manifest, written last, names the buckets
that hold, so an update that fails leaves the former state.

Scores are computed from both tables.  ``rescored`` computes those an update has
changed: pairs with a term that some record gained or lost, or all if the number
of records changed, as that enters every score.

A pair never becomes a row of a shuffle: pairs travel as sorted, delta-coded
and compressed arrays of about two bytes a pair; counts have 64 bits.  The
bucket is a hash of both terms, so the pairs of a very frequent term are spread
over all buckets.  Pairs of one record are made in blocks, so a very long record
doesn't exceed memory.

Term numbers only grow.  Those of the terms in a change set are broadcast after
a check of their number (``MOST_BROADCAST_TERMS``); beyond that, words are
numbered by a join before the pairs are made.

Defined results: a term counts once per record; records without a term don't
count; null words are no terms; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Table, save, shared_root
from .common import MARKER, repeated_keys, table
from .terms import chunks, words_or_split_line

#: Terms whose numbers are broadcast (some 40 bytes each); a larger vocabulary is joined.
MOST_BROADCAST_TERMS = 2_000_000
#: Pair instances a task holds at once, 8 bytes each and some copies while sorting.
PAIRS_AT_ONCE = 6_000_000
#: Folders a bucketed table is spread over before it is written together.
MOST_GENERATIONS = 16
_BLOCK = "bucket int, n long, block binary"
_TERMS = "bucket int, term string, n_records long, id long"


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted unique keys and their counts as one compressed block: byte planes of the differences."""
    d = np.diff(keys, prepend=np.int64(0)).astype("<i8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    c = np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    raw = np.int64(len(keys)).tobytes() + planes.tobytes() + c.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(block[:8], "<i8")[0])
    raw = pa.decompress(block[8:], size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    planes = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n)
    c = np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n).reshape(8, n)
    keys = np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())
    return keys, np.ascontiguousarray(c.T).view("<i8").ravel()


def summed(keys: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their weights (1 each if None); sums of zero are left out."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(weights, at)
    keep = total != 0
    return keys[at][keep], total[keep]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(buckets)).astype(np.int32)


def record_pairs(record: np.ndarray, ids: np.ndarray):
    """Keys (smaller id << 32 | larger id) of the pairs within each record, in pieces.

    ``record`` and ``ids`` are sorted by both and distinct.
    """
    start = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]])) if len(record) else np.zeros(0, int)
    size = np.diff(np.append(start, len(record)))
    for k in np.unique(size):
        if k < 2:
            continue
        first = start[size == k]
        step = max(1, PAIRS_AT_ONCE // (k * (k - 1) // 2))
        if k > 2_000:  # a very long record: one row of its triangle after another
            for s in first:
                row = ids[s : s + k]
                for i in range(k - 1):
                    yield (row[i] << 32) | row[i + 1 :]
            continue
        i, j = np.triu_indices(k, 1)
        for s in range(0, len(first), step):
            m = ids[first[s : s + step, None] + np.arange(k)]
            yield ((m[:, i] << 32) | m[:, j]).ravel()


class _Sums:
    """Keys a task has met with their signs, given out as one summed block per bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.count = buckets, [], 0

    def add(self, keys: np.ndarray, sign: int) -> bool:
        """True if it is time to flush."""
        self.held.append((keys, sign))
        self.count += len(keys)
        return self.count >= PAIRS_AT_ONCE

    def flush(self):
        if not self.held:
            return
        keys = np.concatenate([k for k, _ in self.held])
        weight = None
        if any(s != 1 for _, s in self.held):
            weight = np.concatenate([np.full(len(k), s, np.int64) for k, s in self.held])
        self.held, self.count = [], 0
        keys, total = summed(keys, weight)
        of = bucket_of(keys, self.buckets)
        order = np.argsort(of, kind="stable")
        of = of[order]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        rows = [(int(of[i]), j - i, pack(keys[order[i:j]], total[order[i:j]])) for i, j in zip(at, np.append(at[1:], len(of)))]
        if rows:
            a, n, blocks = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(n, pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "n", "block"])


def _deltas(vocabulary, buckets: int):
    """Function over (sign, words) batches to blocks per bucket; ``vocabulary`` gives terms and their numbers."""

    def run(batches):
        terms, number = vocabulary.value
        sums = _Sums(buckets)
        for c in chunks(batches, ["sign"]):
            at = pc.fill_null(pc.index_in(c.terms, value_set=terms), -1).to_numpy(zero_copy_only=False)
            to_id = np.where(at >= 0, np.append(number, -1)[at], -1)
            ids = np.append(to_id, -1)[c.code]
            rec = c.record()
            ok = ids >= 0
            pair = np.unique((rec[ok] << 32) | ids[ok])
            rec, ids = pair >> 32, pair & 0xFFFFFFFF
            for sign in np.unique(c.keys["sign"]):
                of = c.keys["sign"][rec] == sign
                for keys in record_pairs(rec[of], ids[of]):
                    if sums.add(keys, sign):
                        yield from sums.flush()
        yield from sums.flush()

    return run


def _merge(group: pa.Table) -> pa.Table:
    parts = [unpack(b.as_py()) for b in group.column("block")]
    keys, total = summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    return pa.table(
        {
            "bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()),
            "n": pa.array([len(keys)], pa.int64()),
            "block": pa.array([pack(keys, total)], pa.binary()),
        }
    )


class Buckets:
    """A table in buckets of which single ones are replaced.

    ``live`` names, per folder, the buckets that hold.  Each folder is
    partitioned by bucket, so reading some of them opens only their files.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, live: dict[str, list[int]] | None = None) -> None:
        self.spark, self.root, self.schema, self.live = spark, root, schema, live or {}
        self.dead: list[str] = []

    def df(self, of: list[int] | None = None) -> DataFrame:
        out = None
        for folder, buckets in self.live.items():
            wanted = buckets if of is None else sorted(set(buckets) & set(of))
            if wanted:
                part = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}").where(F.col("bucket").isin(wanted))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def _write(self, df: DataFrame, buckets: list[int]) -> None:
        folder = uuid.uuid4().hex[:12]
        df.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        rest = {}
        for old, held in self.live.items():
            kept = sorted(set(held) - set(buckets))
            if kept:
                rest[old] = kept
                self.dead += [f"{self.root}/{old}/bucket={b}" for b in set(held) & set(buckets)]
            else:
                self.dead.append(f"{self.root}/{old}")
        self.live = rest | {folder: buckets}

    def replace(self, df: DataFrame, buckets: list[int]) -> None:
        """``df`` holds all rows of ``buckets`` from now on."""
        if not buckets:
            return
        self._write(df, buckets)
        if len(self.live) > MOST_GENERATIONS:
            self._write(self.df().repartition("bucket"), sorted(b for held in self.live.values() for b in held))

    def sweep(self) -> None:
        """Delete what no bucket uses any more."""
        for path in self.dead:
            Table(self.spark, path, None).drop()
        self.dead = []


class PairCounts:
    """Pair counts, term counts and the number of records, kept over change sets and sessions.

    Tables read before an update must not be used after it, as replaced buckets
    are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.version, self.n_records, self.n_terms = 0, 0, 0
        self.pairs = Buckets(spark, f"{path}/pairs", _BLOCK)
        self.terms = Buckets(spark, f"{path}/terms", _TERMS)
        #: Terms of the last update that some record gained or lost; None: every score may have changed.
        self.changed: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PairCounts:
        """The state another session left in ``path``."""
        states = [json.loads(r["value"]) for r in spark.read.text(f"{path}/manifest-*").collect()]  # one row per manifest
        state = max(states, key=lambda s: s["version"])
        out = cls(spark, path, state["buckets"])
        out.version, out.n_records, out.n_terms = state["version"], state["n_records"], state["n_terms"]
        out.pairs.live, out.terms.live = state["pairs"], state["terms"]
        return out

    def _commit(self) -> None:
        self.version += 1
        state = {"version": self.version, "buckets": self.buckets, "n_records": self.n_records, "n_terms": self.n_terms}
        state |= {"pairs": self.pairs.live, "terms": self.terms.live}
        row = self.spark.createDataFrame([(json.dumps(state),)], "value string")
        row.coalesce(1).write.text(f"{self.path}/manifest-{self.version}")
        if self.version > 1:
            Table(self.spark, f"{self.path}/manifest-{self.version - 1}", None).drop()
        self.pairs.sweep()
        self.terms.sweep()

    def update(self, changes: DataFrame) -> None:
        """Merge a change set: rows of ``old`` and ``new``, arrays of words (null: no such record before or after)."""
        none = F.array().cast("array<string>")
        old, new = F.coalesce("old", none), F.coalesce("new", none)
        changes = changes.where(~F.col("old").eqNullSafe(F.col("new")))
        signed = changes.select(
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("sign"), F.col("new").alias("words")),
                    F.struct(F.lit(-1).alias("sign"), F.col("old").alias("words")),
                )
            ).alias("x")
        ).select("x.sign", "x.words")
        gain = self._add(signed.where("words is not null"))
        self.changed = None
        if not gain:
            both = changes.select(F.explode(F.concat(F.array_except(new, old), F.array_except(old, new))).alias("w"))
            both = both.select(F.lower("w").alias("term")).where(F.col("term").rlike("[a-z0-9]") & ~F.contains("term", F.lit(MARKER)))
            self.changed = save(both.distinct(), "changed-terms").df

    def load(self, records: DataFrame) -> None:
        """Merge records that are all new: rows of ``words``."""
        self._add(records.select(F.lit(1).alias("sign"), "words"))
        self.changed = None

    def _add(self, signed: DataFrame) -> int:
        """Merge signed records; the number of records gained."""
        marginal = self._marginal_deltas(signed).groupBy("term").agg(F.sum("n_records").alias("gain"))
        marginal = save(marginal.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")), "marginals")
        gain = marginal.df.where("term is null").agg(F.sum("gain")).first()[0] or 0
        delta = marginal.df.where("term is not null")
        touched = [r["bucket"] for r in delta.select("bucket").distinct().orderBy("bucket").collect()]  # a row per bucket at most
        stored = self.terms.df(touched)
        fresh = delta.join(stored.select("term"), "term", "left_anti") if self.version else delta
        # Numbers go on from the last one in the order of the new terms; counts per partition give each its offset.
        ordered = save(
            fresh.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "term")
            .sortWithinPartitions("term")
            .select("bucket", "term", F.col("gain").alias("n_records"), F.monotonically_increasing_id().alias("mid")),
            "new-terms",
        )
        offsets, at = [], self.n_terms
        for r in ordered.df.groupBy(F.shiftright("mid", 33).alias("p")).count().orderBy("p").collect():  # a row per partition of the sort
            offsets += [F.lit(r["p"]), F.lit(at).cast("long")]
            at += r["count"]
        place = F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
        number = F.element_at(F.create_map(*offsets), F.shiftright("mid", 33)) + place if offsets else place
        now = ordered.df.select("bucket", "term", "n_records", number.cast("long").alias("id"))
        if self.version:
            more = stored.join(delta.select("term", "gain"), "term", "left")
            now = now.unionByName(more.select("bucket", "term", (F.col("n_records") + F.coalesce("gain", F.lit(0))).alias("n_records"), "id"))
        self.terms.replace(now.repartition("bucket"), touched)
        self._merge_pairs(signed, delta)
        self.n_records, self.n_terms = self.n_records + gain, at
        self._commit()
        marginal.drop()
        ordered.drop()
        return gain

    def _marginal_deltas(self, signed: DataFrame) -> DataFrame:
        """(``term``, ``n_records``) per chunk, terms whose sum is 0 as well; a null term counts records."""

        def count(batches):
            for c in chunks(batches, ["sign"]):
                ok = c.code >= 0
                rec = c.record()[ok]
                width = max(1, len(c.terms))
                pair = np.unique(rec * width + c.code[ok])
                sign = c.keys["sign"].astype(np.int64)
                df = np.bincount(pair % width, weights=sign[pair // width], minlength=width).astype(np.int64)
                total = int(sign[np.unique(rec)].sum())
                seen = np.flatnonzero(np.bincount(pair % width, minlength=width))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([c.terms.take(pa.array(seen)), pa.nulls(1, pa.string())]),
                        pa.array(np.append(df[seen], total), pa.int64()),
                    ],
                    ["term", "n_records"],
                )

        return signed.mapInArrow(count, "term string, n_records long")

    def _merge_pairs(self, signed: DataFrame, met: DataFrame) -> None:
        """``met``: the terms of the change set."""
        known = self.terms.df().join(met.select("term"), "term", "left_semi").select("term", "id")
        if met.count() <= MOST_BROADCAST_TERMS:
            held = known.toArrow()
            shared = self.spark.sparkContext.broadcast((held.column("term").combine_chunks(), held.column("id").to_numpy()))
            blocks = signed.mapInArrow(_deltas(shared, self.buckets), _BLOCK)
        else:
            blocks = self._joined_blocks(signed, known)
        delta = save(blocks, "pair-deltas")
        touched = [r["bucket"] for r in delta.df.select("bucket").distinct().orderBy("bucket").collect()]  # a row per bucket at most
        merged = delta.df.unionByName(self.pairs.df(touched)).groupBy("bucket").applyInArrow(_merge, _BLOCK)
        self.pairs.replace(merged, touched)
        delta.drop()

    def _joined_blocks(self, signed: DataFrame, known: DataFrame) -> DataFrame:
        """For a vocabulary too large to broadcast: words get their numbers by a join, records are put together again."""
        words = signed.withColumn("rec", F.monotonically_increasing_id()).select("rec", "sign", F.explode("words").alias("w"))
        words = words.select("rec", "sign", F.lower("w").alias("term"))
        words = words.where(F.col("term").rlike("[a-z0-9]") & ~F.col("term").contains(MARKER)).distinct()
        lists = words.join(known, "term").groupBy("rec", "sign").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("sign", "ids")
        buckets = self.buckets

        def run(batches):
            sums = _Sums(buckets)
            for b in batches:
                ids = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                rec = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False))
                of = b.column("sign").to_numpy(zero_copy_only=False)[rec] if len(rec) else rec
                for sign in np.unique(of):
                    for keys in record_pairs(rec[of == sign], ids[of == sign]):
                        if sums.add(keys, sign):
                            yield from sums.flush()
            yield from sums.flush()

        return lists.mapInArrow(run, _BLOCK)

    def rescored(self, min_count: int, above: float | None) -> DataFrame:
        """``scores`` of the pairs the last update may have changed.

        These are the pairs with a term of ``changed``; a score kept from before
        for such a pair that isn't among them has gone.
        """
        if self.changed is None or self.changed.count() > MOST_BROADCAST_TERMS:
            return self.scores(min_count, above)
        ids = self.terms.df().join(F.broadcast(self.changed), "term", "left_semi").select("id").toArrow().column("id").to_numpy()
        return self.scores(min_count, above, np.sort(ids))

    def refreshed(self, scored: DataFrame, min_count: int, above: float | None) -> DataFrame:
        """``scored``, the result of ``scores`` before the last update, with what that update changed replaced."""
        if self.changed is None:
            return self.scores(min_count, above)
        for c in ("term_a", "term_b"):
            scored = scored.join(self.changed.withColumnRenamed("term", c), c, "left_anti")
        return scored.select("term_a", "term_b", "n_records", "npmi").unionByName(self.rescored(min_count, above))

    def scores(self, min_count: int, above: float | None, of: np.ndarray | None = None) -> DataFrame:
        """(``term_a``, ``term_b``, ``n_records``, ``npmi``), terms in order, of pairs in at least ``min_count`` records
        and with NPMI greater than ``above`` (None: all).  A pair found in every record has no NPMI (its logarithm is 0)
        and gets 1.  ``of``: only pairs with a term of these numbers."""
        terms = self.terms.df()
        total, floor = float(self.n_records), max(1, min_count)
        marginal = None
        if above is not None and self.n_terms <= MOST_BROADCAST_TERMS:
            counts = terms.select("id", "n_records").toArrow()
            df = np.zeros(self.n_terms, np.float64)
            df[counts.column("id").to_numpy()] = counts.column("n_records").to_numpy()
            marginal = self.spark.sparkContext.broadcast(df)

        def score(batches):
            for b in batches:
                for block in b.column("block"):
                    keys, n = unpack(block.as_py())
                    keep = n >= floor
                    keys, n = keys[keep], n[keep]
                    a, c = keys >> 32, keys & 0xFFFFFFFF
                    if of is not None:
                        keep = np.isin(a, of) | np.isin(c, of)
                        a, c, n = a[keep], c[keep], n[keep]
                    if marginal is not None and len(a):
                        d = marginal.value
                        with np.errstate(divide="ignore", invalid="ignore"):
                            x = np.log(n / total) - np.log(d[a] / total) - np.log(d[c] / total)
                            npmi = np.where(n >= total, 1.0, x / -np.log(n / total))
                        keep = npmi > above - 1e-9  # the exact comparison follows on the joined rows
                        a, c, n = a[keep], c[keep], n[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(n)], ["a", "b", "n_records"])

        found = self.pairs.df().select("block").mapInArrow(score, "a long, b long, n_records long")
        ta = terms.select(F.col("id").alias("a"), F.col("term").alias("ta"), F.col("n_records").alias("na"))
        tb = terms.select(F.col("id").alias("b"), F.col("term").alias("tb"), F.col("n_records").alias("nb"))
        p, pa_, pb = (F.col(c) / F.lit(total) for c in ("n_records", "na", "nb"))
        npmi = F.when(F.col("n_records") >= total, F.lit(1.0)).otherwise(F.log(p / (pa_ * pb)) / -F.log(p))
        out = found.join(ta, "a").join(tb, "b").withColumn("npmi", npmi)
        if above is not None:
            out = out.where(F.col("npmi") > above)
        return out.select(F.least("ta", "tb").alias("term_a"), F.greatest("ta", "tb").alias("term_b"), "n_records", "npmi")


def _deliveries(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "note_lines")
    return t.select("note_id", "line_no", "ingested_at", words_or_split_line().alias("words"))


def _buckets(spark, rows: int) -> int:
    """A bucket for some 100,000 records, so that a block's arrays stay near 100 MB while merged."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 100_000)


#: Shares of the deliveries after which a change set ends.
CHANGE_SETS = (0.8, 0.9)


def note_pair_counts(spark, sf_dir: str) -> PairCounts:
    """Pair counts of the note lines, built up by change sets in the order of ``ingested_at``.

    A record that comes again takes back what it counted before; one without a
    time comes first, one without a key stands for itself.
    """
    d = _deliveries(spark, sf_dir)
    seen = d.agg(F.count("*").alias("n"), F.percentile_approx(F.unix_micros("ingested_at"), list(CHANGE_SETS)).alias("cut")).first()
    cuts = [F.timestamp_micros(F.lit(c)) for c in seen["cut"] or []]
    counts = PairCounts(spark, f"{shared_root(spark)}/pair-counts-{uuid.uuid4().hex[:12]}", _buckets(spark, seen["n"]))
    keys = ["note_id", "line_no"]
    repeated = repeated_keys(d, keys)
    set_no = F.lit(0)
    for c in cuts:
        set_no = set_no + F.when(F.col("ingested_at") > c, 1).otherwise(0)
    again = d.join(repeated, keys, "left_semi").withColumn("set_no", set_no)
    again = again.groupBy(*keys, "set_no").agg(F.max_by("words", F.coalesce(F.unix_micros("ingested_at"), F.lit(-(1 << 62)))).alias("new"))
    before = F.lag("new").over(Window.partitionBy(*keys).orderBy("set_no"))
    again = save(again.withColumn("old", before).select("set_no", "old", "new"), "delivered-again").df
    once = d.join(repeated, keys, "left_anti").select(F.lit(None).cast("array<string>").alias("old"), F.col("words").alias("new"), "ingested_at")
    for k in range(len(cuts) + 1):
        mine = once
        if k:
            mine = mine.where(F.col("ingested_at") > cuts[k - 1])
        if k < len(cuts):
            mine = mine.where((F.col("ingested_at") <= cuts[k]) | (F.lit(k == 0) & F.col("ingested_at").isNull()))
        counts.update(mine.drop("ingested_at").unionByName(again.where(F.col("set_no") == k).drop("set_no")))
    return counts


def p3_found(spark, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "ngram_settings").where("n = 2").first()
    found = note_pair_counts(spark, sf_dir).scores(s["min_count"], s["npmi_threshold"])
    return found.select("term_a", "term_b")


def p3_scores(spark, sf_dir: str) -> DataFrame:
    """The same pairs with the number of shared records and the NPMI."""
    s = table(spark, sf_dir, "ngram_settings").where("n = 2").first()
    found = note_pair_counts(spark, sf_dir).scores(s["min_count"], s["npmi_threshold"])
    return found.withColumn("npmi", F.round("npmi", 6))


_PAIRS = """
WITH one AS (
  SELECT note_id, line_no, coalesce(words, regexp_split_to_array(line, '\\s+')) AS w FROM note_lines
  QUALIFY row_number() OVER (PARTITION BY note_id, line_no ORDER BY ingested_at) = 1
), t AS (
  SELECT DISTINCT note_id, line_no, lower(x) AS term FROM (SELECT note_id, line_no, unnest(w) AS x FROM one)
  WHERE regexp_matches(lower(x), '[a-z0-9]') AND NOT contains(lower(x), 'zxzxpz')
), n AS (SELECT count(DISTINCT (note_id, line_no))::DOUBLE AS n FROM t),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
s AS (SELECT min_count, npmi_threshold FROM ngram_settings WHERE n = 2),
c AS (
  SELECT x.term AS term_a, y.term AS term_b, count(*) AS n_records
  FROM t x JOIN t y ON x.note_id = y.note_id AND x.line_no = y.line_no AND x.term < y.term
  GROUP BY ALL HAVING count(*) >= (SELECT min_count FROM s)
), r AS (
  SELECT term_a, term_b, n_records,
    ln((n_records / n.n) / ((a.df / n.n) * (b.df / n.n))) / -ln(n_records / n.n) AS npmi
  FROM c JOIN d a ON a.term = term_a JOIN d b ON b.term = term_b, n
)
"""
QUERIES = {"p3_found": p3_found, "p3_scores": p3_scores}
SQL = {
    "p3_found": _PAIRS + "SELECT term_a, term_b FROM r WHERE npmi > (SELECT npmi_threshold FROM s)",
    "p3_scores": _PAIRS
    + "SELECT term_a, term_b, n_records, round(npmi, 6) AS npmi FROM r WHERE npmi > (SELECT npmi_threshold FROM s)",
}
