"""Evaluation against a table of concepts, and counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.distance import abbreviation
from ..functions.phrase import n_words
from ..functions.phrase import normalised as normal_phrase
from ..functions.text import has_marker, processor
from ..functions.vector import dot, normalised
from ..scratch import save
from .collocations import phrase_scores
from .order import numbered
from .thesaurus import ortho_distance


#: Items of a group that are paired in one task; the pairs of larger groups are spread over more.
GROUP_BLOCK = 2_000
#: Items of a group that are compared at once, and pairs of one part; parts are hashed, so some are larger.
PAIR_BLOCK, PART_PAIRS = 1_000, 16_000_000
#: Groups of an item up to which its rows name them; pairs of items in more are made unique in a shuffle.
MOST_GROUPS = 100


def pairs_within(items: DataFrame, group: str, item: str, only: DataFrame | None = None) -> DataFrame:
    """(``a``, ``b``), a < b, of items that share a group, each pair once; ``only`` (``form``): pairs of listed items.

    All pairs of a group are the result, so it grows with the square of the
    group; the work of a large group is spread by blocks of its items.
    """
    x = items.select(F.col(group).alias("g"), F.col(item).alias("a")).where("g is not null and a is not null").distinct()
    if only is not None:
        x = x.join(only.select(F.col("form").alias("a")), "a", "left_semi").select("g", "a")
    x = save(x, "items").df
    blocks = x.groupBy("g").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    x = x.join(blocks, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = x.select("g", "a", F.pmod(F.xxhash64("a"), F.col("blocks").cast("long")).alias("block"))
    right = x.select("g", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("blocks") - 1).cast("long"))).alias("block"))
    return left.join(right, ["g", "block"]).where("a < b").select("a", "b").distinct()


def without_terms(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs of which neither is listed."""
    t = terms.select("form").distinct()
    return pairs.join(t.withColumnRenamed("form", "a"), "a", "left_anti").join(t.withColumnRenamed("form", "b"), "b", "left_anti").select("a", "b")


def short_phrases(phrases: DataFrame, most_words: int, form: str = "form") -> DataFrame:
    """Phrases of at most so many words; null and empty ones are left out."""
    return phrases.where((F.col(form) != "") & (n_words(F.col(form)) <= most_words))


def random_pairs(items: DataFrame, item: str, seed: int = 1, n: int | None = None) -> DataFrame:
    """Each item with that at the mirrored place of a shuffled order, or the first ``n`` of these pairs.

    The order is by a hash of seed and item, so it is the same in every run.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")))
    x = numbered(items.select(item).distinct(), [key, F.col(item)], "rn", start=1)
    count = x.count()
    y = x.select(F.col(item).alias("b"), (F.lit(count + 1) - F.col("rn")).alias("rn"))
    most = count // 2 if n is None else min(n, count // 2)
    return x.withColumnRenamed(item, "a").join(y, "rn").where(F.col("rn") <= most).select("a", "b")


def zipped(first: DataFrame, second: DataFrame, place: str = "place", form: str = "form") -> DataFrame:
    """(``a``, ``b``) of the rows of two lists at the same place."""
    a = first.select(F.col(place).alias("i"), F.col(form).alias("a"))
    return a.join(second.select(F.col(place).alias("i"), F.col(form).alias("b")), "i").select("a", "b")


def scored_pairs(pairs: DataFrame, vectors: DataFrame | None = None, permutation_penalty: float | None = 1.0, ortho: bool = True, abbr: bool = False) -> DataFrame:
    """Pairs (``a``, ``b``) as ``phrase1``, ``phrase2`` with the scores asked for.

    ``semantic``: the dot product of both terms' vectors scaled to length 1,
    null if a term has none.  ``orthographic``: the distance over the longer
    length.  ``abbreviation``: the distance of the first, as the abbreviation,
    to the second, over the first's length; this direction only.
    """
    out = pairs.select(F.col("a").alias("phrase1"), F.col("b").alias("phrase2"))
    cols = ["phrase1", "phrase2"]
    if vectors is not None:
        v = vectors.select("form", normalised(F.col("vec")).alias("vec"))
        out = out.join(v.select(F.col("form").alias("phrase1"), F.col("vec").alias("v1")), "phrase1", "left")
        out = out.join(v.select(F.col("form").alias("phrase2"), F.col("vec").alias("v2")), "phrase2", "left")
        out = out.withColumn("semantic", dot(F.col("v1"), F.col("v2")))
        cols.append("semantic")
    a, b = F.col("phrase1"), F.col("phrase2")
    if ortho:
        out = out.withColumn("orthographic", ortho_distance(a, b, permutation_penalty))
        cols.append("orthographic")
    if abbr:
        out = out.withColumn("abbreviation", abbreviation(a, b) / F.length(a))
        cols.append("abbreviation")
    return out.select(*cols)


def _padded(vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length 1 as ``normalised`` does, as rows in double, and their numbers of components, -1 where there is none or one is null."""
    size = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vec.flatten()
    m = np.zeros((len(vec), max(0, size.max(initial=0))))
    m[np.arange(m.shape[1]) < size[:, None]] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        size[np.repeat(np.arange(len(size)), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    with np.errstate(invalid="ignore"):
        m /= np.where(length == 0, 1, length)[:, None]
    return m.astype(np.float32).astype(np.float64), size


def _scored_runs(t: pa.Table, ends: np.ndarray, many: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of each run; ``ends``: where the runs end."""
    keys, earlier = t.column("a").combine_chunks(), t.column("earlier").combine_chunks()
    own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
    m, size = _padded(t.column("vec").combine_chunks())
    listed = earlier.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(keys)), pc.fill_null(pc.list_value_length(earlier), 0).to_numpy(zero_copy_only=False))
    code = earlier.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    held, waiting = [], 0

    def batch() -> pa.RecordBatch:
        x, y, dot = (np.concatenate(z) for z in zip(*held, strict=True))
        known = (size[x] >= 0) & (size[x] == size[y])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y)), pa.array(dot, mask=~known)], ["phrase1", "phrase2", "semantic"])

    for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        keep = np.triu(np.ones((hi - lo, hi - lo), bool), 1)  # rows are in order of their items
        if i[lo] != j[lo]:
            keep &= own[lo:hi, None] != own[lo:hi]
        either = ~(listed[lo:hi, None] & listed[lo:hi])
        keep &= either if many else ~either
        at = slice(*np.searchsorted(row, [lo, hi]))
        r, c = row[at] - lo, code[at]
        by = np.argsort(c, kind="stable")
        for shared in np.split(r[by], np.flatnonzero(np.diff(c[by])) + 1):
            if len(shared) > 1:
                keep[np.ix_(shared, shared)] = False  # an earlier group has the pair
        for s in range(0, hi - lo, 256):
            x, y = np.nonzero(keep[s : s + 256])
            if len(x):
                dot = m[lo + s : min(lo + s + 256, hi)] @ m[lo:hi].T
                held.append((x + lo + s, y + lo, dot[x, y]))
                waiting += len(x)
            if waiting > 100_000:
                yield batch()
                held, waiting = [], 0
    if held:
        yield batch()


def similarities_within(items: DataFrame, group: str, item: str, vectors: DataFrame) -> Iterator[DataFrame]:
    """What ``scored_pairs`` gives of ``pairs_within`` without ``orthographic``, in parts of some ``PART_PAIRS`` pairs.

    Pairs never become rows of a shuffle: items travel with their vectors, once
    per block of their group, and are paired where they meet.  An item knows its
    earlier groups, so the first group that both share gives the pair.
    A part is to be used before the next one is asked for.
    """
    x = items.select(F.col(group).alias("g"), F.col(item).alias("a")).where("g is not null and a is not null").distinct()
    x = x.join(x.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "g")
    x = x.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("gs"))
    x = x.join(vectors.select(F.col("form").alias("a"), "vec"), "a", "left")
    earlier = lambda k: F.when(F.size("gs") <= MOST_GROUPS, F.transform(F.slice("gs", F.lit(1), k), lambda e: e["g"]))
    x = x.select("a", "vec", F.inline(F.transform("gs", lambda e, k: F.struct(e["g"].alias("g"), e["n"].alias("n"), earlier(k).alias("earlier")))))
    table = save(x, "items")
    x = table.df
    pairs, many = x.agg(F.sum(F.col("n") - 1), F.count_if(F.col("earlier").isNull())).first()
    parts = max(1, -(-(pairs or 0) // (2 * PART_PAIRS)))
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("long")
    tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs or 0, 2 * PART_PAIRS) // 1_000_000)

    def part(p: int | None) -> DataFrame:
        own = F.pmod(F.xxhash64("a"), blocks)
        others = F.sequence(F.lit(0).cast("long"), blocks - 1)
        if p is not None:
            others = F.filter(others, lambda o: F.pmod(F.xxhash64("g", F.least("own", o), F.greatest("own", o), F.lit("part")), F.lit(parts)) == p)
        y = x.withColumn("own", own).withColumn("o", F.explode(others))
        y = y.select("g", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "a", "earlier", "vec")
        y = y.repartition(tasks, "g", "i", "j").sortWithinPartitions("g", "i", "j", "a")

        def compare(batches):
            rest = None
            for b in batches:
                t = pa.Table.from_batches([b])
                t = t if rest is None else pa.concat_tables([rest, t])
                if not t.num_rows:
                    continue
                new = np.zeros(t.num_rows - 1, bool)
                for c in ("g", "i", "j"):
                    v = t.column(c).combine_chunks()
                    new |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
                ends = np.flatnonzero(new) + 1
                if len(ends):  # the last run may go on
                    yield from _scored_runs(t[: ends[-1]], ends, p is None)
                rest = t[ends[-1] :] if len(ends) else t
            if rest is not None:
                yield from _scored_runs(rest, np.array([rest.num_rows]), p is None)

        kind = x.schema["a"].dataType.simpleString()
        return y.mapInArrow(compare, f"phrase1 {kind}, phrase2 {kind}, semantic double")

    for p in range(parts):
        yield part(p)
    if many:
        yield part(None).dropDuplicates(["phrase1", "phrase2"])
    table.drop()


def _usable(form, processor: str):
    return (form != "") & ~has_marker(form, processor)


def _concept_items(concepts: DataFrame, abbreviations: DataFrame | None, s: Settings, by: str) -> DataFrame:
    """(``g``, ``form``) of the forms that take part."""
    clean = F.trim(processor(s.processor)(F.col("form")))
    c = concepts.select(F.col(by).alias("g"), clean.alias("form")).where(_usable(F.col("form"), s.processor))
    if abbreviations is not None:
        a = abbreviations.select(F.trim(processor(s.processor)(F.col("abbr"))).alias("form")).where(_usable(F.col("form"), s.processor)).distinct()
        c = c.join(a, "form", "left_anti")
    c = short_phrases(c, s.max_phrase_length)
    form = F.col("form") if s.embeddings_case_sensitive else F.lower("form")
    return c.select("g", form.alias("form"))


def concept_experiment(concepts: DataFrame, abbreviations: DataFrame | None, s: Settings, by: str = "lui") -> DataFrame:
    """Pairs (``a``, ``b``) of different forms with the same lexical id (``by`` = "concept": the same concept).

    ``concepts``: ``concept``, ``lui``, ``form``; ``abbreviations``: ``abbr``.
    Forms go through the processor; those with a marker, of more than the
    longest phrase, or listed as abbreviations take no part.
    """
    return pairs_within(_concept_items(concepts, abbreviations, s, by), "g", "form")


def concept_similarities(concepts: DataFrame, abbreviations: DataFrame | None, s: Settings, vectors: DataFrame, by: str = "lui") -> Iterator[DataFrame]:
    """Pairs of ``concept_experiment`` with their similarities, in parts as of ``similarities_within``."""
    return similarities_within(_concept_items(concepts, abbreviations, s, by), "g", "form", vectors)


def abbreviation_experiment(abbreviations: DataFrame, s: Settings) -> DataFrame:
    """Pairs (``a``, ``b``) of abbreviation and long form, processed, without those with a marker or nothing left."""
    clean = lambda c: F.trim(processor(s.processor)(F.col(c)))
    x = abbreviations.select(clean("abbr").alias("a"), clean("long").alias("b"))
    return x.where(_usable(F.col("a"), s.processor) & _usable(F.col("b"), s.processor))


def random_experiment(concepts: DataFrame, s: Settings, n: int, seed: int = 1) -> DataFrame:
    """``n`` random pairs of forms of at most 8 words."""
    c = concepts.select(F.trim(processor(s.processor)(F.col("form"))).alias("form")).where(_usable(F.col("form"), s.processor))
    form = F.col("form") if s.embeddings_case_sensitive else F.lower("form")
    return random_pairs(short_phrases(c.select(form.alias("form")), 8), "form", seed, n)


def npmi_experiment(concepts: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """``phrase_scores`` of the concept forms of 2 to 7 words; phrases that aren't counted get 0."""
    c = concepts.select(normal_phrase(processor(s.processor)(F.col("form"))).alias("form")).where(_usable(F.col("form"), s.processor)).distinct()
    c = short_phrases(c, 7).withColumn("n", n_words(F.col("form"))).where("n > 1")
    scored = phrase_scores(c, counts, s).select("form", "best", "skip")
    zero = lambda x: F.coalesce(x, F.lit(0.0)).alias(x)
    return c.join(scored, "form", "left").select("form", "n", zero("best"), zero("skip"))


def concept_sets(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("form").agg(F.collect_set("concept").alias("concepts"))


def concept_pairs(thesaurus: DataFrame, concepts: DataFrame) -> DataFrame:
    """Entries with ``verdict``: same or different concept, or unknown if a term has none."""
    used = thesaurus.select(F.explode(F.array("p1", "p2")).alias("form")).distinct()
    c = concept_sets(concepts.join(used, "form", "left_semi"))
    t = thesaurus.join(c.select(F.col("form").alias("p1"), F.col("concepts").alias("c1")), "p1", "left")
    t = t.join(c.select(F.col("form").alias("p2"), F.col("concepts").alias("c2")), "p2", "left")
    verdict = F.when(F.col("c1").isNull() | F.col("c2").isNull(), "unknown").when(F.arrays_overlap("c1", "c2"), "same").otherwise("different")
    return t.withColumn("verdict", verdict).drop("c1", "c2")


def concept_summary(judged: DataFrame) -> DataFrame:
    known = F.count_if(F.col("verdict") != "unknown")
    return judged.agg(
        known.alias("known"),
        F.count_if(F.col("verdict") == "unknown").alias("unknown"),
        F.count_if(F.col("verdict") == "same").alias("same"),
        F.count_if(F.col("verdict") == "different").alias("different"),
        F.round(known / F.count("*"), 8).alias("coverage"),
    )


def mean_known(df: DataFrame, *cols: str) -> DataFrame:
    """Means without nulls."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def counted(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("cnt"))


def added(a: DataFrame, b: DataFrame, col: str, sign: int = 1) -> DataFrame:
    """Two counters added, or subtracted with sign -1."""
    both = a.unionByName(b.withColumn("cnt", F.col("cnt") * sign))
    return both.groupBy(col).agg(F.sum("cnt").alias("cnt"))


def by_value(df: DataFrame, value: str, key: str, reverse: bool = False) -> DataFrame:
    """Rows with their ``place`` in the order of value, then key; descending in both if ``reverse``."""
    d = F.desc if reverse else F.asc
    return numbered(df, [d(value), d(key)], "place")


def sorted_counter(counts: DataFrame, col: str) -> DataFrame:
    """A counter in ascending order of count, then key."""
    return by_value(counts, "cnt", col)


def total_sizes(thesaurus: DataFrame) -> DataFrame:
    """Headwords and entries of a thesaurus."""
    return thesaurus.agg(F.count_distinct("p1").alias("headwords"), F.count("*").alias("entries"))
