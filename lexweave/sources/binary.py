"""Binary vector files as Python data sources.

Files are opened through ``pyarrow.fs`` by path or URI, so tasks read a shared
file system themselves, and no file is ever held whole in memory: there is no
limit of 2 GB.  A word2vec file has records of varying length, so a task
streams one file; a GloVe file has records of one length, and is split.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 4_096
VECTORS = "rank long, form string, vec array<float>"


def file_system(path: str):
    """(file system, path within it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The file itself, or all visible files of a folder in the order of their names."""
    from pyarrow import fs

    store, where = file_system(path)
    prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
    info = store.get_file_info(where)
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(where))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [path]


def batch(rank: list, forms: list, m: np.ndarray) -> pa.RecordBatch:
    dim = m.shape[1] if m.ndim == 2 else 0
    offsets = pa.array(np.arange(0, len(forms) * dim + 1, dim) if dim and forms else [0], pa.int32())
    vec = pa.ListArray.from_arrays(offsets, pa.array(m.astype(np.float32).ravel(), pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(rank, pa.int64()), pa.array(forms, pa.string()), vec], ["rank", "form", "vec"])


def stream_word2vec(stream, first: int = 0):
    """Batches of a stream: header ``words dim``, then per word its bytes up to a blank, ``dim`` little-endian float32, maybe a newline.

    Terms are UTF-8, runs of ``_`` are blanks, empty terms are skipped; ``first`` above 0 stops early.
    """
    f = io.BufferedReader(stream, 1 << 20) if isinstance(stream, io.RawIOBase) else stream
    n, dim = map(int, f.readline().split())
    n = min(n, first) if first > 0 else n
    rank, forms, rows = 0, [], []
    held = b""
    for _ in range(n):
        term = bytearray(held)
        while (c := f.read(1)) and c != b" ":
            term += c
        data = f.read(4 * dim)
        if len(data) < 4 * dim:
            raise EOFError("the file ends within a vector")
        held = f.read(1)
        held = b"" if held == b"\n" else held
        form = " ".join(x for x in bytes(term).decode("utf-8", "replace").strip().split("_") if x)
        if form:
            forms.append(form)
            rows.append(np.frombuffer(data, "<f4"))
            if len(forms) == BATCH_ROWS:
                yield batch(list(range(rank, rank + len(forms))), forms, np.stack(rows))
                rank, forms, rows = rank + len(forms), [], []
    if forms:
        yield batch(list(range(rank, rank + len(forms))), forms, np.stack(rows))


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int = 0) -> None:
        self.path, self.start, self.end = path, start, end


class Word2vec(DataSource):
    """Options: ``path`` (a file, or a folder of files), ``first`` (words of each file at most, 0: all)."""

    @classmethod
    def name(cls) -> str:
        return "word2vec"

    def schema(self) -> str:
        return VECTORS

    def reader(self, schema) -> DataSourceReader:
        return _Word2vecReader(self.options["path"], int(self.options.get("first", 0)))


class _Word2vecReader(DataSourceReader):
    def __init__(self, path: str, first: int) -> None:
        self.path, self.first = path, first

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in files_of(self.path)]

    def read(self, partition):
        store, where = file_system(partition.path)
        with store.open_input_stream(where, buffer_size=1 << 20) as f:
            yield from stream_word2vec(io.BufferedReader(f, 1 << 20), self.first)


class Glove(DataSource):
    """Word and context vectors added and scaled to length 1, with the place of each; options ``path`` and ``words``, their number.

    The file holds little-endian float64: for each word, then for each word as
    context, its values and a bias.
    """

    @classmethod
    def name(cls) -> str:
        return "glove"

    def schema(self) -> str:
        return VECTORS

    def reader(self, schema) -> DataSourceReader:
        return _GloveReader(self.options["path"], int(self.options["words"]))


class _GloveReader(DataSourceReader):
    split_rows = 65_536

    def __init__(self, path: str, words: int) -> None:
        self.path, self.words = path, words

    def partitions(self) -> list[InputPartition]:
        return [_File(self.path, s, min(self.words, s + self.split_rows)) for s in range(0, self.words, self.split_rows)] or [_File(self.path)]

    def read(self, partition):
        store, where = file_system(partition.path)
        if not self.words:
            return
        width = store.get_file_info(where).size // 8 // 2 // self.words  # values and a bias
        with store.open_input_file(where) as f:
            for s in range(partition.start, partition.end, BATCH_ROWS):
                e = min(partition.end, s + BATCH_ROWS)
                m = np.zeros((e - s, width - 1))
                for first in (s, self.words + s):
                    f.seek(8 * width * first)
                    m += np.frombuffer(f.read(8 * width * (e - s)), "<f8").reshape(-1, width)[:, :-1]
                size = np.sqrt((m * m).sum(1, keepdims=True))
                yield batch(list(range(s, e)), [""] * (e - s), m / np.where(size > 0, size, 1))
