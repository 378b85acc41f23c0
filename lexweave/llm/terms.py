"""Terms of note lines as integer arrays, one Arrow chunk at a time.

Terms are the entries of ``words`` (where it is null, of ``line`` split at
blanks), lower-cased, that hold a letter a-z or a digit and not the marker.
Only the distinct words of a chunk are lower-cased and tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MARKER

#: Words a chunk holds at most; bounds the memory of a task.  A longer record makes a chunk of its own.
CHUNK_WORDS = 1_500_000


def words_or_split_line() -> Column:
    """The words of a record: ``words``, or ``line`` split at blanks, or no words."""
    split = F.split(F.col("line"), r"\s+")
    return F.coalesce(F.col("words"), split, F.array().cast("array<string>"))


class Chunk:
    """Records of a chunk: ``code`` per word (-1: no term), ``terms`` by code, ``start`` of each record (one more at the end), ``keys`` by name."""

    def __init__(self, batches: list[pa.RecordBatch], keys: list[str]) -> None:
        lists = pa.concat_arrays([b.column("words") for b in batches])
        flat = lists.flatten().dictionary_encode()
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        low = pc.utf8_lower(flat.dictionary)
        good = pc.and_(
            pc.match_substring_regex(low, "[a-z0-9]"), pc.invert(pc.match_substring(low, MARKER))
        ).to_numpy(zero_copy_only=False)
        merged = low.dictionary_encode()
        self.terms = merged.dictionary
        of = np.where(good.astype(bool), merged.indices.to_numpy(zero_copy_only=False), -1).astype(np.int32)
        index = pc.fill_null(flat.indices.cast(pa.int32()), -1).to_numpy(zero_copy_only=False)
        self.code = np.append(of, np.int32(-1))[index]
        self.keys = {
            k: pc.fill_null(pa.concat_arrays([b.column(k) for b in batches]), -1).to_numpy(zero_copy_only=False)
            for k in keys
        }

    @property
    def n_records(self) -> int:
        return len(self.start) - 1

    def record(self) -> np.ndarray:
        """Number of the record that each word stands in."""
        return np.repeat(np.arange(self.n_records), np.diff(self.start))


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[Chunk]:
    held, words = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.sum(pc.list_value_length(b.column("words"))).as_py() or 0
        if held and words + n > CHUNK_WORDS:
            yield Chunk(held, keys)
            held, words = [], 0
        held.append(b)
        words += n
    if held:
        yield Chunk(held, keys)


def term_counts(records: DataFrame) -> DataFrame:
    """(``term``, ``cnt``, ``n_records``) of records with ``words``; also one row with a null term that counts records with any term."""

    def count(batches):
        for c in chunks(batches, []):
            ok = c.code >= 0
            cnt = np.bincount(c.code[ok], minlength=len(c.terms))
            rec = c.record()[ok]
            pair = np.unique(rec * max(1, len(c.terms)) + c.code[ok])
            df = np.bincount(pair % max(1, len(c.terms)), minlength=len(c.terms))
            seen = np.flatnonzero(cnt)
            any_term = len(np.unique(rec))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([c.terms.take(pa.array(seen)), pa.nulls(1, pa.string())]),
                    pa.array(np.append(cnt[seen], 0), pa.int64()),
                    pa.array(np.append(df[seen], any_term), pa.int64()),
                ],
                ["term", "cnt", "n_records"],
            )

    part = records.select("words").mapInArrow(count, "term string, cnt long, n_records long")
    return part.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("n_records").alias("n_records"))
