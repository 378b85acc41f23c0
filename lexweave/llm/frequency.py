"""Frequency of every term sequence: suffix-sorted n-gram counting.

Every position of a record emits the suffix that starts there, cut after
``max_n`` terms and at the first word that is no term.  Suffixes are routed by
their first term, so all n-grams that start with a term meet in one task.  The
task sorts its suffixes in reverse lexicographic order and keeps a stack of
the prefixes that are open: a prefix closes where the next suffix differs from
it, and is then emitted with its occurrences and the notes it was seen in.
Each position is thus shuffled once, not once per n.

Suffixes travel as one compressed block per task and route: a dictionary of
the block's terms and integer columns, duplicates within a note summed.

A first term with a large share of all positions is hot (at most ``2 * routes``
terms can be): it is routed by term and note.  A note then lies in one route of
the term, so occurrences and notes of its n-grams add up over routes; only
these rows are grouped again.

Defined results: words that are no terms break sequences and are not counted;
a null note id is one more note; an empty table gives an empty result; n-grams
never cross records.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .common import first_deliveries, repeated_keys, table
from .terms import Chunk, chunks, term_counts, words_or_split_line


def suffixes(c: Chunk, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, record): a row per position that holds a term; columns after the end of a sequence are -1."""
    code, rec = c.code, c.record()
    n = len(code)
    m = np.full((n, max_n), -1, np.int32)
    m[:, 0] = code
    for k in range(1, max_n):
        if n > k:
            same = (rec[k:] == rec[:-k]) & (m[:-k, k - 1] >= 0)
            m[:-k, k] = np.where(same, code[k:], -1)
    keep = code >= 0
    return m[keep], rec[keep]


def _write_block(terms: pa.Array, m: np.ndarray, note: np.ndarray, cnt: np.ndarray) -> bytes:
    """A route's suffixes with a dictionary of only the terms they use."""
    used, inverse = np.unique(m, return_inverse=True)
    inverse = inverse.reshape(m.shape).astype(np.int32)
    if len(used) and used[0] == -1:
        used, inverse = used[1:], inverse - 1
    cols = {f"w{k}": pa.array(np.ascontiguousarray(inverse[:, k])) for k in range(m.shape[1])}
    body = pa.table({**cols, "note": pa.array(note), "cnt": pa.array(cnt.astype(np.int32))})
    words = pa.table({"term": terms.take(pa.array(used))})
    sink = pa.BufferOutputStream()
    for t in (words, body):
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
    return sink.getvalue().to_pybytes()


def _read_block(block: pa.Buffer) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    source = pa.BufferReader(block)
    words = pa.ipc.open_stream(source).read_all().column("term")
    body = pa.ipc.open_stream(source).read_all()
    n = body.num_columns - 2
    m = np.stack([body.column(k).to_numpy() for k in range(n)], axis=1) if body.num_rows else np.zeros((0, n), np.int32)
    words = words.combine_chunks() if words.num_chunks else pa.array([], pa.string())
    return words, m, body.column("note").to_numpy(), body.column("cnt").to_numpy()


def _route(max_n: int, routes: int, hot):
    """Function over batches of records to blocks per route."""

    def run(batches):
        hot_terms = hot.value
        for c in chunks(batches, ["note_id"]):
            if not len(c.terms):
                continue
            m, rec = suffixes(c, max_n)
            note = c.keys["note_id"][rec].astype(np.int64)
            order = np.lexsort((note, *[m[:, k] for k in range(max_n - 1, -1, -1)]))
            m, note = m[order], note[order]
            first = np.concatenate([[True], (m[1:] != m[:-1]).any(1) | (note[1:] != note[:-1])]) if len(m) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            cnt = np.diff(np.append(at, len(m)))
            m, note = m[at], note[at]
            home = np.array([zlib.crc32(t.encode()) % routes for t in c.terms.to_pylist()], np.int64)
            is_hot = pc.is_in(c.terms, value_set=hot_terms).to_numpy(zero_copy_only=False).astype(bool)
            spread = (note.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            lead = m[:, 0]
            route = np.where(is_hot[lead], (home[lead] + spread) % routes, home[lead])
            key = route * 2 + is_hot[lead]
            order = np.argsort(key, kind="stable")
            cut = np.searchsorted(key[order], np.arange(2 * routes + 1))
            for k in range(2 * routes):
                o = order[cut[k] : cut[k + 1]]
                if len(o):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k // 2], pa.int32()),
                            pa.array([bool(k % 2)]),
                            pa.array([_write_block(c.terms, m[o], note[o], cnt[o])], pa.binary()),
                        ],
                        ["route", "hot", "block"],
                    )

    return run


def prefix_counts(m: np.ndarray, note: np.ndarray, cnt: np.ndarray):
    """Per prefix length k: (a row of m with the prefix, occurrences, notes).

    Rows are visited in reverse lexicographic order.  ``same`` is the length of
    the prefix that a row shares with the row before it, hence the height to
    which the stack falls there: prefixes of length k close exactly at the rows
    with ``same`` < k.  What lies between two such rows is one stack entry;
    occurrences are summed over it, and its notes are counted as a set.
    """
    width = m.shape[1]
    order = np.lexsort((note, *[m[:, k] for k in range(width - 1, -1, -1)]))[::-1]
    m, note, cnt = m[order], note[order], cnt[order]
    same = np.zeros(len(m), np.int64)
    alike = np.ones(max(0, len(m) - 1), bool)
    for k in range(width):
        alike &= m[1:, k] == m[:-1, k]
        same[1:] += alike
    for k in range(1, width + 1):
        opened = np.flatnonzero(same < k)
        entry = np.cumsum(same < k) - 1
        full = m[opened, k - 1] >= 0
        total = np.add.reduceat(cnt.astype(np.int64), opened)
        if k == width:  # the notes of an entry are in order here
            fresh = (same < k) | np.concatenate([[True], note[1:] != note[:-1]])
            notes = np.add.reduceat(fresh.astype(np.int64), opened)
        else:
            o = np.lexsort((note, entry))
            e, x = entry[o], note[o]
            fresh = np.concatenate([[True], (e[1:] != e[:-1]) | (x[1:] != x[:-1])])
            notes = np.bincount(e[fresh], minlength=len(opened))
        yield k, m[opened[full]], total[full], notes[full]


def _count(group: pa.Table) -> pa.Table:
    """All n-grams of a route."""
    terms, parts, notes, cnts, at = [], [], [], [], 0
    for block in group.column("block"):
        words, m, note, cnt = _read_block(block.as_buffer())
        parts.append(np.where(m >= 0, m + at, -1))
        terms.append(words)
        notes.append(note)
        cnts.append(cnt)
        at += len(words)
    merged = pa.concat_arrays(terms).dictionary_encode()
    words = merged.dictionary
    # Codes in order of the terms, so that sorting codes is sorting terms.
    by_term = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int32)
    place[by_term] = np.arange(len(words), dtype=np.int32)
    code = np.append(place[merged.indices.to_numpy(zero_copy_only=False)], np.int32(-1))
    words = words.take(pa.array(by_term))
    m = code[np.concatenate(parts)]
    out = []
    for k, rows, total, n_notes in prefix_counts(m, np.concatenate(notes), np.concatenate(cnts)):
        cols = [words.take(pa.array(np.ascontiguousarray(rows[:, i]))) for i in range(k)]
        form = pc.binary_join_element_wise(*cols, " ") if k > 1 else cols[0]
        out.append(
            pa.table(
                {
                    "n": pa.array(np.full(len(rows), k, np.int32)),
                    "form": form,
                    "cnt": pa.array(total),
                    "n_notes": pa.array(n_notes.astype(np.int64)),
                    "hot": pa.array(np.full(len(rows), group.column("hot")[0].as_py())),
                }
            )
        )
    return pa.concat_tables(out)


def ngram_frequencies(records: DataFrame, max_n: int) -> DataFrame:
    """Rows of ``note_id`` and ``words`` to (``n``, ``form``, ``cnt``, ``n_notes``) of every sequence of 1 to ``max_n`` terms."""
    spark = records.sparkSession
    counted = save(term_counts(records).where("term is not null").select("term", "cnt"), "term-counts").df
    positions = counted.agg(F.sum("cnt")).first()[0] or 0
    routes = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), positions // 4_000_000)
    # At most 2 * routes terms can have more than this share.
    hot_rows = counted.where(F.col("cnt") > positions / (2 * routes)).select("term").toArrow()
    hot = spark.sparkContext.broadcast(hot_rows.column("term").combine_chunks())
    blocks = records.select("note_id", "words").mapInArrow(
        _route(max_n, routes, hot), "route int, hot boolean, block binary"
    )
    rows = blocks.groupBy("route", "hot").applyInArrow(
        _count, "n int, form string, cnt long, n_notes long, hot boolean"
    )
    rows = save(rows, "frequencies").df
    whole = rows.where("not hot").drop("hot")
    split = rows.where("hot").groupBy("n", "form").agg(F.sum("cnt").alias("cnt"), F.sum("n_notes").alias("n_notes"))
    return whole.unionByName(split)


def marked(freq: DataFrame, settings: DataFrame, n_notes: int) -> DataFrame:
    """``mark``: ``rare`` (n = 1 only) below ``min_count`` occurrences, ``common`` in more than ``max_note_share`` of the notes, else null."""
    s = {r["n"]: r for r in settings.collect()}  # one row per order
    mark = F.lit(None).cast("string")
    for n, r in s.items():
        share = r["max_note_share"]
        if share is not None and share == share and n <= 2:
            mark = F.when((F.col("n") == n) & (F.col("n_notes") > F.lit(share * n_notes)), "common").otherwise(mark)
        if n == 1 and r["min_count"] is not None:
            mark = F.when((F.col("n") == 1) & (F.col("cnt") < r["min_count"]), "rare").otherwise(mark)
    return freq.withColumn("mark", mark)


def note_frequencies(spark, sf_dir: str, max_n: int = 2) -> DataFrame:
    lines = table(spark, sf_dir, "note_lines")
    n_notes = lines.agg(F.count_distinct("note_id")).first()[0]
    d = lines.select("note_id", "line_no", "ingested_at", words_or_split_line().alias("words"))
    keys = ["note_id", "line_no"]
    freq = ngram_frequencies(first_deliveries(d, keys, "ingested_at", repeated_keys(d, keys)), max_n)
    return marked(freq, table(spark, sf_dir, "ngram_settings"), n_notes)


def p4_found(spark, sf_dir: str) -> DataFrame:
    return note_frequencies(spark, sf_dir).where("mark is not null").select("n", "form", "mark")


def p4_frequencies(spark, sf_dir: str) -> DataFrame:
    """Every term and two-word sequence with its counts and mark."""
    return note_frequencies(spark, sf_dir).select("n", "form", "cnt", "n_notes", "mark")


_FREQ = """
WITH one AS (
  SELECT note_id, line_no, coalesce(words, regexp_split_to_array(line, '\\s+')) AS w FROM note_lines
  QUALIFY row_number() OVER (PARTITION BY note_id, line_no ORDER BY ingested_at) = 1
), p AS (
  SELECT note_id, line_no, unnest(list_transform(w, lambda x: lower(x))) AS term, unnest(range(len(w))) AS i FROM one
), q AS (
  SELECT note_id, i, term, lead(term) OVER w AS following, lead(i) OVER w AS j FROM p
  WINDOW w AS (PARTITION BY note_id, line_no ORDER BY i)
), u AS (
  SELECT 1::INT AS n, term AS form, note_id FROM q
  WHERE regexp_matches(term, '[a-z0-9]') AND NOT contains(term, 'zxzxpz')
  UNION ALL
  SELECT 2::INT, term || ' ' || following, note_id FROM q
  WHERE regexp_matches(term, '[a-z0-9]') AND NOT contains(term, 'zxzxpz')
    AND regexp_matches(following, '[a-z0-9]') AND NOT contains(following, 'zxzxpz')
), f AS (SELECT n, form, count(*) AS cnt, count(DISTINCT note_id) AS n_notes FROM u GROUP BY n, form),
t AS (SELECT count(DISTINCT note_id) AS notes FROM note_lines),
m AS (
  SELECT f.n, form, cnt, n_notes,
    CASE WHEN f.n = 1 AND cnt < s.min_count THEN 'rare' WHEN n_notes > s.max_note_share * t.notes THEN 'common' END AS mark
  FROM f JOIN ngram_settings s ON s.n = f.n, t
)
"""
QUERIES = {"p4_found": p4_found, "p4_frequencies": p4_frequencies}
SQL = {
    "p4_found": _FREQ + "SELECT n, form, mark FROM m WHERE mark IS NOT NULL",
    "p4_frequencies": _FREQ + "SELECT n, form, cnt, n_notes, mark FROM m",
}
