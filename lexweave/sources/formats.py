"""Readers and writers of the text and binary formats around the pipeline.

Text formats are read by Spark's own scans, binary vector files by the data
sources of ``binary``.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.apply import apply_collocations
from ..operators.order import numbered
from ..operators.similarity import first_of_each_term
from ..operators.thesaurus import in_rows
from . import binary


# Corpora and counts


def read_corpus(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(``file``, ``line``) of text files, of all folders below if ``recursive``."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    return r.select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(F.col(line).alias("value")).write.text(path)


def write_files(lines: DataFrame, path: str, prefix: str = "bigrammed_") -> None:
    """Lines of several files (``file``, ``line``) to one folder per file, named after it with a prefix, in the order of the lines.

    Files of one name in different folders come together.
    """
    name = F.concat(F.lit(prefix), F.regexp_extract("file", r"([^/]*)$", 1))
    place = F.monotonically_increasing_id()
    rows = lines.select(name.alias("name"), place.alias("at"), F.col("line").alias("value"))
    # Large files stay in several parts; a part holds a file's lines in their order.
    rows.repartitionByRange("name", "at").sortWithinPartitions("name", "at").drop("at").write.partitionBy("name").text(path)


def apply_to_files(spark: SparkSession, source: str, target: str, found: DataFrame, keep_case: bool = True) -> None:
    """Every file below ``source`` with collocations joined, to a folder of its own below ``target``."""
    write_files(apply_collocations(read_corpus(spark, source, recursive=True), found, keep_case), target)


def read_counts(spark: SparkSession, path: str, n: int, min_count: int = 1, marker: str | None = None) -> DataFrame:
    """(``n``, ``form``, ``cnt``) of lines ``words TAB count``; lines with the marker or too small a count are skipped."""
    t = spark.read.option("quote", "").csv(path, sep="\t", schema="form string, cnt long")
    if marker:
        t = t.where(~F.contains("form", F.lit(marker)))
    return t.where(F.col("cnt") >= min_count).select(F.lit(n).alias("n"), "form", "cnt")


def write_counts(counts: DataFrame, path: str) -> None:
    counts.select("form", "cnt", "n").write.partitionBy("n").option("quote", "").csv(path, sep="\t")


def read_collocations(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("quote", "").csv(path, sep="\t", schema="form string, score double")
    return t.select("form", F.size(F.split("form", " ")).alias("n"), "score")


def write_collocations(found: DataFrame, path: str) -> None:
    """In the order of words, then form."""
    found.orderBy("n", "form").select("form", "score").write.option("quote", "").csv(path, sep="\t")


# Vectors


def read_vocabulary(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(``rank``, ``form``, ``freq``) of lines ``term count``; the ``first`` distinct terms in file order (0: all); a later line's count holds."""
    t = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    part = F.split(F.trim("value"), r"\s+")
    t = t.where(F.size(part) >= 2).select("at", F.regexp_replace(part[0], "_+", " ").alias("form"), part[1].cast("long").alias("freq"))
    one = t.groupBy("form").agg(F.min("at").alias("at"), F.max_by("freq", "at").alias("freq"))
    ranked = numbered(one, [F.col("at")], "rank")
    return (ranked.where(F.col("rank") < first) if first > 0 else ranked).select("rank", "form", "freq")


def read_word2vec(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(``rank``, ``form``, ``vec``) of a binary file, or of all files of a folder; a term that comes again is ignored."""
    spark.dataSource.register(binary.Word2vec)
    return first_of_each_term(spark.read.format("word2vec").option("first", first).load(path))


def read_word2vec_frequent(spark: SparkSession, path: str, vocabulary: DataFrame, min_freq: int) -> DataFrame:
    """Vectors of terms counted ``min_freq`` times or more; none if there is no such term."""
    return read_word2vec(spark, path).join(vocabulary.where(F.col("freq") >= min_freq).select("form", "freq"), "form").select("rank", "form", "vec", "freq")


def decode_word2vec(data: bytes, first: int = 0):
    """(rank, forms, matrix) of the bytes of a file."""
    import io

    got = pa.Table.from_batches(binary.stream_word2vec(io.BytesIO(data), first), binary.batch([], [], np.zeros((0, 1))).schema)
    vec = got.column("vec").combine_chunks()
    return got.column("rank").to_pylist(), got.column("form").to_pylist(), vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1) if len(vec) else np.zeros((0, 0), np.float32)


def encode_word2vec(forms: list[str], m: np.ndarray) -> bytes:
    out = [f"{len(forms)} {m.shape[1]}\n".encode()]
    for form, v in zip(forms, m, strict=True):
        out += [form.replace(" ", "_").encode(), b" ", v.astype("<f4").tobytes(), b"\n"]
    return b"".join(out)


def write_word2vec(vectors: DataFrame, path: str) -> int:
    """Binary files of ``form`` and ``vec`` below ``path``, one of each task's rows, in their order; the number of words written.

    A task holds its rows in memory to know their number, so partitions bound
    it.  A repeated task writes the same file again.
    """
    from pyspark import TaskContext

    store, where = binary.file_system(path)
    store.create_dir(where, recursive=True)

    def write(batches):
        t = pa.Table.from_batches(b for b in batches if b.num_rows) if (batches := list(batches)) and sum(b.num_rows for b in batches) else None
        n = 0 if t is None else t.num_rows
        if n:
            vec = t.column("vec").combine_chunks()
            m = vec.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            store, where = binary.file_system(path)
            part = f"{where}/part-{TaskContext.get().partitionId():05d}.bin"
            temporary = f"{where}/.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(encode_word2vec(t.column("form").to_pylist(), m))
            store.move(temporary, part)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    known = vectors.where("form is not null and vec is not null").select("form", "vec")
    return known.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def encode_glove(words: np.ndarray, contexts: np.ndarray, bias: float = 0.5) -> bytes:
    """A file of word and context vectors, each followed by a bias."""
    add = np.full((len(words), 1), bias)
    return np.concatenate([np.hstack([words, add]), np.hstack([contexts, add])]).astype("<f8").tobytes()


def read_glove(spark: SparkSession, path: str, vocabulary_path: str) -> DataFrame:
    """Vectors of a binary file in the order of a vocabulary file of lines ``term count``, joined by their places; ``_`` in a term is a blank."""
    spark.dataSource.register(binary.Glove)
    lines = spark.read.text(vocabulary_path).select(F.split(F.trim("value"), r"\s+")[0].alias("t"), F.monotonically_increasing_id().alias("i")).where("t <> ''")
    words = numbered(lines, [F.col("i")], "rank").select("rank", F.replace("t", F.lit("_"), F.lit(" ")).alias("form"))
    vectors = spark.read.format("glove").option("words", words.count()).load(path).select("rank", "vec")
    return first_of_each_term(words.join(vectors, "rank").select("rank", "form", "vec"))


# Thesaurus and clusters


# The first line of a thesaurus file.
CASE_SENSITIVE, NOT_CASE_SENSITIVE = "case-sensitive thesaurus", "non-case-sensitive thesaurus"


def write_thesaurus(thesaurus: DataFrame, path: str, processor: str = "none", case_sensitive: bool = False, most: int = 100_000) -> None:
    """Two header lines (case mode, processor) and a line per headword: head, then form and ``overall;semantic;ortho;abbr``, best first.

    A headword of more than ``most`` entries has several lines, which the reader unites.
    """
    scores = F.concat_ws(";", *[F.col(c).cast("string") for c in ("overall", "semantic", "ortho", "abbr")])
    order = [F.coalesce(-F.col("overall"), F.lit(float("inf"))).alias("k"), F.col("p2")]
    body = in_rows(thesaurus, "p1", order, F.array("p2", scores), most)
    line = F.concat_ws("\t", "p1", F.flatten("x"))
    spark = thesaurus.sparkSession
    head = spark.createDataFrame([(0, CASE_SENSITIVE if case_sensitive else NOT_CASE_SENSITIVE), (1, processor)], "i int, value string")
    rows = head.select("i", F.lit("").alias("p1"), F.lit(0).alias("part"), "value").unionByName(body.select(F.lit(2).alias("i"), "p1", "part", line.alias("value")))
    rows.repartitionByRange("i", "p1", "part").sortWithinPartitions("i", "p1", "part").select("value").write.text(path)


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """Flat entries; the header lines and lines without an entry are skipped."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    at = F.sequence(F.lit(1), F.size("f") - 2, F.lit(2))
    e = f.select(F.get("f", F.lit(0)).alias("p1"), F.explode(F.transform(at, lambda i: F.struct(F.get("f", i).alias("p2"), F.split(F.get("f", i + 1), ";").alias("s")))).alias("e"))
    num = lambda k: F.expr(f"try_cast(get(e.s, {k}) as double)")
    return e.select("p1", "e.p2", num(0).alias("overall"), num(1).alias("semantic"), num(2).alias("ortho"), num(3).alias("abbr"))


def read_thesaurus_header(spark: SparkSession, path: str) -> dict:
    """Case mode and processor name, without a ``class`` prefix: the first two lines of the first file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    first = [r["value"] for r in lines.where(~F.contains("value", F.lit("\t"))).orderBy("file", "at").limit(2).collect()]
    mode, name = (first + ["", ""])[:2]
    return {"case_sensitive": mode == CASE_SENSITIVE, "processor": name.removeprefix("class ")}


def write_clusters(clusters: DataFrame, path: str, separator: str = "\t", most: int = 100_000) -> None:
    """A line per cluster: the representative, then the other members in order; a cluster of more than ``most`` has several lines, each headed by it."""
    rows = in_rows(clusters.where("form <> representative"), "representative", [F.col("form").alias("k")], F.col("form"), most)
    alone = clusters.select("representative").distinct().join(rows.select("representative"), "representative", "left_anti")
    rows = rows.select("representative", "x").unionByName(alone.select("representative", F.array().cast("array<string>").alias("x")))
    rows.select(F.concat_ws(separator, "representative", "x").alias("value")).write.text(path)


def read_clusters(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    f = spark.read.text(path).select(F.split("value", re.escape(separator)).alias("f"))
    x = f.select(F.get("f", F.lit(0)).alias("representative"), F.explode("f").alias("form")).distinct()
    least = x.groupBy("representative").agg(F.min("form").alias("cluster_id"))
    return x.join(least, "representative").select("form", "cluster_id", "representative")


# Concept tables and experiments


def read_concepts(spark: SparkSession, path: str, language: str = "ENG", processor=None) -> DataFrame:
    """(``concept``, ``lui``, ``form``) of pipe-separated concept rows of a language: fields 0 concept, 1 language, 3 lexical id, 14 string."""
    f = F.split("value", r"\|", -1)
    t = spark.read.text(path).where(F.size(f) > 14).select(f[0].alias("concept"), f[1].alias("lang"), f[3].alias("lui"), f[14].alias("form"))
    form = processor(F.col("form")) if processor else F.col("form")
    return t.where(F.col("lang") == language).select("concept", "lui", form.alias("form"))


def read_abbreviations(spark: SparkSession, path: str) -> DataFrame:
    """(``abbr``, ``long``): fields 1 and 4 of pipe-separated rows."""
    f = F.split("value", r"\|", -1)
    return spark.read.text(path).where(F.size(f) > 4).select(f[1].alias("abbr"), f[4].alias("long"))


def write_experiment(df: DataFrame, path: str, compression: str = "none") -> None:
    """Tab-separated with a header; only the columns there are; nulls as ``null``."""
    df.write.option("nullValue", "null").csv(path, sep="\t", header=True, compression=compression)


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    """By the header: ``phrase1``, ``phrase2`` and those of ``semantic``, ``orthographic``, ``abbreviation`` it names."""
    t = spark.read.option("nullValue", "null").csv(path, sep="\t", header=True)
    scores = [c for c in ("semantic", "orthographic", "abbreviation") if c in t.columns]
    return t.select("phrase1", "phrase2", *[F.col(c).cast("double").alias(c) for c in scores])


def labelled_pairs(judged: DataFrame) -> DataFrame:
    """Entries with a label ``same`` or ``diff``, for a dump."""
    return judged.where("verdict <> 'unknown'").select(
        F.col("p1").alias("phrase1"), F.col("p2").alias("phrase2"), "overall", "semantic", F.col("ortho").alias("orthographic"), F.col("abbr").alias("abbreviation"),
        F.when(F.col("verdict") == "same", "same").otherwise("diff").alias("cuis"),
    )


def write_labelled_pairs(judged: DataFrame, path: str) -> None:
    """Tab-separated with a header; the pairs with a concept in common come first."""
    labelled_pairs(judged).orderBy(F.desc("cuis"), "phrase1", "phrase2").write.option("quote", "").csv(path, sep="\t", header=True)


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    kinds = "phrase1 string, phrase2 string, overall double, semantic double, orthographic double, abbreviation double, cuis string"
    return spark.read.option("quote", "").csv(path, sep="\t", header=True, schema=kinds)


def npmi_dump(scored: DataFrame) -> DataFrame:
    """(``term``, ``order``, ``score``): scores by order, and skip scores of three-word phrases as order 2.5."""
    plain = scored.select(F.col("form").alias("term"), F.col("n").cast("double").alias("order"), F.col("best").alias("score"))
    return plain.unionByName(scored.where("n = 3").select(F.col("form").alias("term"), F.lit(2.5).alias("order"), F.col("skip").alias("score")))


def write_npmi(scored: DataFrame, path: str) -> None:
    npmi_dump(scored).write.option("quote", "").csv(path, sep="\t", header=True)


def read_npmi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("quote", "").csv(path, sep="\t", header=True, schema="term string, order double, score double")
