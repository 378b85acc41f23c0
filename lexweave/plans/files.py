"""Registered queries that write a format, read it again, and go on from there."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import commands, config
from ..functions.vector import component, magnitude
from ..operators import cluster as K
from ..operators import collocations as C
from ..operators import evaluate as E
from ..operators import ngrams as N
from ..scratch import Table, save, shared_root
from ..sources import formats as IO
from ..sources.binary import file_system
from . import catalog as A
from . import further as M
from .catalog import corpus, query, read


def _place(spark, name: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _put(path: str, data: bytes) -> None:
    store, where = file_system(path)
    store.create_dir(where.rpartition("/")[0], recursive=True)
    with store.open_output_stream(where) as f:
        f.write(data)


# Counts and collocations


@query(f"WITH {A.LINES} SELECT n, form, cnt FROM counts WHERE cnt >= 20 AND NOT contains(form, 'the')")
def counts_file(spark, d):
    """Counts by order, read with a higher minimum and without a marker."""
    path = _place(spark, "counts-file")
    IO.write_counts(A._counts(spark, d), path)
    parts = [IO.read_counts(spark, f"{path}/n={n}", n, 20, "the") for n in range(1, 6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {A.FOUND} SELECT form, n::INT AS n, round(score, 8) AS score FROM found")
def collocations_file(spark, d):
    path = _place(spark, "collocations-file")
    IO.write_collocations(C.collocations(A._counts(spark, d), A.SETTINGS, bootstrap=False), path)
    return IO.read_collocations(spark, path).select("form", "n", F.round("score", 8).alias("score"))


@query(r"""SELECT lang, line, count(*) AS cnt FROM (SELECT coalesce(lang, 'none') AS lang, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
WHERE line NOT LIKE '%' || chr(13) || '%' GROUP BY ALL""")
def corpus_files(spark, d):
    """Lines written to a folder per language and read from all folders below."""
    path = _place(spark, "corpus-files")
    t = read(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("none")).alias("file"), F.explode(F.split("text", "\n")).alias("line"))
    IO.write_files(t.where(~F.contains("line", F.lit("\r"))), path, prefix="in_")
    lang = F.regexp_extract("file", r"name=in_([^/]*)/", 1)
    return IO.read_corpus(spark, path, recursive=True).select(F.url_decode(lang).alias("lang"), "line").groupBy("lang", "line").agg(F.count("*").alias("cnt"))


# Vectors and vocabularies


@query(f"WITH {A._V} SELECT 'v ' || vec_id AS form, round(e[64], 6) AS last, round(sqrt(list_dot_product(e, e)), 6) AS magnitude FROM v")
def word2vec_file(spark, d):
    """Vectors to binary files and back, a term with a blank."""
    path = _place(spark, "word2vec")
    IO.write_word2vec(A._vectors(spark, d).select(F.concat(F.lit("v "), "vec_id").alias("form"), "vec"), path)
    v = IO.read_word2vec(spark, path)
    return v.select("form", F.round(component(F.col("vec"), 63).cast("double"), 6).alias("last"), F.round(magnitude(F.col("vec")), 6).alias("magnitude"))


_COUNTED = A.LINES.split(", counts AS")[0] + r""", uni AS (SELECT form, count(*) AS freq FROM (SELECT unnest(w) AS form FROM words) WHERE form NOT LIKE '%\_%' ESCAPE '\' GROUP BY form),
top AS (SELECT form, freq, row_number() OVER (ORDER BY freq DESC, form) - 1 AS rank FROM uni)"""


def _vocabulary_file(spark, d: str) -> str:
    counts = N.ngram_counts(corpus(spark, d), 1).where(~F.contains("form", F.lit("_")))
    path = _place(spark, "vocabulary")
    order = [F.desc("cnt"), F.asc("form")]
    IO.write_lines(counts.repartitionByRange(1, *order).sortWithinPartitions(*order).select(F.concat_ws(" ", "form", "cnt").alias("line")), path)
    return path


@query(f"WITH {_COUNTED} SELECT rank, form, freq FROM top WHERE rank < 300")
def vocabulary_file(spark, d):
    """The first 300 terms of a vocabulary file."""
    return IO.read_vocabulary(spark, _vocabulary_file(spark, d), 300)


@query(f"WITH {_COUNTED}, {A._V} SELECT form, freq, round(e[1], 6) AS first FROM top JOIN v ON vec_id = rank WHERE freq >= 200")
def word2vec_frequent(spark, d):
    """Vectors of the frequent terms only."""
    vocabulary = save(IO.read_vocabulary(spark, _vocabulary_file(spark, d)), "vocabulary-read").df
    v = A._vectors(spark, d).join(vocabulary, F.col("rank") == F.col("vec_id")).select("form", "vec")
    path = _place(spark, "word2vec")
    IO.write_word2vec(v, path)
    x = IO.read_word2vec_frequent(spark, path, vocabulary, 200)
    return x.select("form", "freq", F.round(component(F.col("vec"), 0).cast("double"), 6).alias("first"))


@query("""WITH t AS (SELECT i, [sin(i), cos(i), 1.0] AS w, [0.5, i / 100, -1.0] AS c FROM (SELECT unnest(range(100)) AS i)),
s AS (SELECT i, list_transform(range(1, 4), lambda k: w[k] + c[k]) AS v FROM t)
SELECT 'a b' || i AS form, i AS rank, round((v[1] / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE, 6) AS first, round((v[3] / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE, 6) AS last FROM s""")
def glove_file(spark, d):
    """A made-up file of word and context vectors with biases."""
    i = np.arange(100)
    path = _place(spark, "glove")
    _put(f"{path}/vectors.bin", IO.encode_glove(np.stack([np.sin(i), np.cos(i), np.ones(100)], 1), np.stack([np.full(100, 0.5), i / 100, -np.ones(100)], 1)))
    _put(f"{path}/vocabulary.txt", "".join(f"a_b{k} {1000 - k}\n" for k in i).encode())
    v = IO.read_glove(spark, f"{path}/vectors.bin", f"{path}/vocabulary.txt")
    at = lambda k: F.round(component(F.col("vec"), k).cast("double"), 6)
    return v.select("form", "rank", at(0).alias("first"), at(2).alias("last"))


# Thesaurus and clusters


@query(f"WITH {A._TERMS} SELECT p1, p2, {A._ROUNDED}, true AS case_sensitive, 'org.example.OwnProcessor' AS processor FROM thes")
def thesaurus_file(spark, d):
    path = _place(spark, "thesaurus-file")
    IO.write_thesaurus(A._thesaurus(spark, d), path, "org.example.OwnProcessor", case_sensitive=True, most=3)
    head = IO.read_thesaurus_header(spark, path)
    return A._rounded(IO.read_thesaurus(spark, path)).withColumns({k: F.lit(x) for k, x in head.items()})


@query(
    f"""WITH RECURSIVE {A._COMP}, r AS (SELECT form::VARCHAR AS form, cluster_id, (arg_max(form, (label, -form)) OVER (PARTITION BY cluster_id))::VARCHAR AS representative FROM comp JOIN v ON v.vec_id = form)
SELECT form, min(form) OVER (PARTITION BY representative) AS cluster_id, representative FROM r"""
)
def clusters_file(spark, d):
    links, terms = A._links(spark, d, 0.4)
    freq = A._vectors(spark, d).select(F.col("vec_id").alias("form"), F.col("label").alias("freq"))
    c = K.representatives(K.cluster_by_threshold(links, terms, 0.4), freq)
    path = _place(spark, "clusters-file")
    IO.write_clusters(c.select(*[F.col(x).cast("string") for x in ("form", "cluster_id", "representative")]), path, separator=";", most=2)
    return IO.read_clusters(spark, path, separator=";")


# Concept tables and experiments

_CLEAN = "trim(regexp_replace(replace(coalesce({c}, ''), '|', ' '), '\\s+', ' ', 'g'))"


def _concept_file(spark, d: str) -> str:
    """Headwords of the thesaurus as concept rows: the concept by their first letters, every seventh row in another language."""
    clean = F.trim(F.regexp_replace(F.replace(F.coalesce("p1", F.lit("")), F.lit("|"), F.lit(" ")), r"\s+", " "))
    t = read(spark, d, "thesaurus").select("entry_id", clean.alias("f")).distinct()
    lang = F.when(F.col("entry_id") % 7 == 0, "GER").otherwise("ENG")
    concept, lui = F.concat(F.lit("C"), F.substring("f", 1, 3)), F.concat(F.lit("L"), F.substring("f", 1, 4))
    line = F.concat_ws("|", concept, lang, F.lit("P"), lui, *[F.lit("")] * 10, "f", F.lit(""))
    path = _place(spark, "concepts")
    IO.write_lines(t.select(line.alias("line")), path)
    return path


_CONCEPTS = f"""concepts AS (SELECT 'C' || substr(f, 1, 3) AS concept, 'L' || substr(f, 1, 4) AS lui, f AS form
  FROM (SELECT DISTINCT entry_id, {_CLEAN.format(c="p1")} AS f FROM thesaurus) WHERE entry_id % 7 <> 0)"""


def _concepts(spark, d: str) -> DataFrame:
    return save(IO.read_concepts(spark, _concept_file(spark, d)), "concepts-read").df


@query(f"WITH {_CONCEPTS} SELECT concept, lui, form, count(*) AS cnt FROM concepts GROUP BY ALL")
def concept_file(spark, d):
    return _concepts(spark, d).groupBy("concept", "lui", "form").agg(F.count("*").alias("cnt"))


def _abbreviations(spark, d: str) -> DataFrame:
    """Short and long forms: the first letters of both words, and a part's name."""
    p = read(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat_ws("|", F.lit("E"), F.concat(F.substring("p_name", 1, 1), F.substring(F.substring_index("p_name", " ", -1), 1, 1)), F.lit("a"), F.lit("E1"), "p_name", F.lit("")).alias("line"))
    path = _place(spark, "abbreviations")
    IO.write_lines(p, path)
    return IO.read_abbreviations(spark, path)


_SHORT = "short AS (SELECT DISTINCT substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1) AS a, p_name AS b FROM part WHERE p_partkey % 3 = 0)"


@query(
    f"""WITH {_SHORT}, {A._abbr_sql('short')}, {A._plain_sql('short')}
SELECT s.a AS phrase1, s.b AS phrase2, round(p.distance / greatest(length(s.a), length(s.b)), 6) AS orthographic, round(x.distance / length(s.a), 6) AS abbreviation
FROM short s JOIN abbr x ON x.a = s.a AND x.b = s.b JOIN plain p ON p.a = s.a AND p.b = s.b"""
)
def abbreviation_experiment(spark, d):
    """Abbreviations against their long forms, one direction only, dumped and loaded."""
    pairs = E.abbreviation_experiment(_abbreviations(spark, d), config.Settings(processor="none")).distinct()
    path = _place(spark, "experiment")
    IO.write_experiment(E.scored_pairs(pairs, None, None, abbr=True), path)
    x = IO.read_experiment(spark, path)
    return x.select("phrase1", "phrase2", F.round("orthographic", 6).alias("orthographic"), F.round("abbreviation", 6).alias("abbreviation"))


_SAME_LUI = f"""{_CONCEPTS}, short AS (SELECT DISTINCT form FROM concepts WHERE length(form) = 4),
c AS (SELECT DISTINCT lui AS g, lower(form) AS form FROM concepts WHERE form <> '' AND form NOT IN (SELECT form FROM short) AND len(string_split(form, ' ')) <= 2),
pairs AS (SELECT DISTINCT x.form AS a, y.form AS b FROM c x JOIN c y ON x.g = y.g AND x.form < y.form)"""


def _same_lui(spark, d: str) -> tuple:
    c = _concepts(spark, d)
    short = c.where(F.length("form") == 4).select(F.col("form").alias("abbr")).distinct()
    return c, short, config.Settings(processor="none", max_phrase_length=2)


@query(f"WITH {_SAME_LUI} SELECT a, b FROM pairs")
def same_lui_pairs(spark, d):
    """Forms of at most two words with the same lexical id, listed abbreviations left out."""
    return E.concept_experiment(*_same_lui(spark, d))


@query(
    f"""WITH {_SAME_LUI}, {M._VOCABULARY}, u AS (SELECT form, list_transform(vec, lambda x: (x::DOUBLE / sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])))::FLOAT::DOUBLE) AS e FROM vocab
  WHERE list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vec, lambda x: x <> 0)))
SELECT a AS phrase1, b AS phrase2, round(list_dot_product(x.e, y.e), 5) AS semantic FROM pairs LEFT JOIN u x ON x.form = a LEFT JOIN u y ON y.form = b"""
)
def pair_similarities(spark, d):
    """Similarities of pairs, null where a term has no vector, dumped and loaded part by part, so that the text of one part is on disk at a time."""
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    out = None
    for part in E.concept_similarities(*_same_lui(spark, d), M._vocabulary(spark, d).where(ok)):
        path = _place(spark, "experiment")
        IO.write_experiment(part, path, "lz4")
        loaded = IO.read_experiment(spark, path)
        kept = save(loaded.select("phrase1", "phrase2", F.round("semantic", 5).alias("semantic")), "similarities", compression="zstd").df
        Table(spark, path, loaded.schema).drop()
        out = kept if out is None else out.unionByName(kept)
    return out


@query(
    f"""WITH {_SHORT}, {A._abbr_sql('short')}, {A._plain_sql('short')}
SELECT round(avg(p.distance / greatest(length(s.a), length(s.b))), 8) AS orthographic, round(avg(x.distance / length(s.a)), 8) AS abbreviation
FROM short s JOIN abbr x ON x.a = s.a AND x.b = s.b JOIN plain p ON p.a = s.a AND p.b = s.b"""
)
def experiment_means(spark, d):
    pairs = E.abbreviation_experiment(_abbreviations(spark, d), config.Settings(processor="none")).distinct()
    m = E.mean_known(E.scored_pairs(pairs, None, None, abbr=True), "orthographic", "abbreviation")
    return m.select(*[F.round(c, 8).alias(c) for c in m.columns])


@query(
    f"""WITH f AS (SELECT DISTINCT lower(form) AS form FROM (SELECT form FROM (WITH {_CONCEPTS} SELECT form FROM concepts)) WHERE form <> '' AND len(string_split(form, ' ')) <= 8),
p AS (SELECT form, row_number() OVER (ORDER BY md5('1:' || form), form) AS rn, count(*) OVER () AS n FROM f)
SELECT x.form AS a, y.form AS b FROM p x JOIN p y ON x.rn + y.rn = x.n + 1 WHERE x.rn <= least(500, x.n // 2)"""
)
def random_experiment(spark, d):
    return E.random_experiment(_concepts(spark, d), config.Settings(processor="none"), 500)


@query(
    f"""WITH {A.LINES}, {A.TOTALS}, {M._PHRASES}, x AS (
  {" UNION ALL ".join(f"SELECT form, {n} AS n, greatest(lead_score, trail_score) AS best, skip FROM s{n}" for n in (2, 3, 4, 5))}
), asked AS (SELECT form, n::INT AS n FROM counts WHERE n BETWEEN 2 AND 4 UNION ALL SELECT 'never seen phrase', 3),
s AS (SELECT form, a.n, coalesce(best, 0) AS best, coalesce(skip, 0) AS skip FROM asked a LEFT JOIN x USING (form))
SELECT form AS term, n::DOUBLE AS "order", round(best, 8) AS score FROM s UNION ALL SELECT form, 2.5, round(skip, 8) FROM s WHERE n = 3"""
)
def npmi_experiment(spark, d):
    """Scores of phrases by order, skip scores as order 2.5, dumped and loaded."""
    counts = A._counts(spark, d)
    asked = counts.where("n between 2 and 4").select("form").union(spark.createDataFrame([("never seen phrase",)], "form string"))
    path = _place(spark, "npmi")
    IO.write_npmi(E.npmi_experiment(asked, counts, config.Settings(processor="none")), path)
    return IO.read_npmi(spark, path).select("term", "order", F.round("score", 8).alias("score"))


@query(
    f"""WITH {A._TERMS}, k AS (SELECT form, lower(form)[1] AS c FROM terms WHERE freq % 4 <> 1),
j AS (SELECT t.*, CASE WHEN x.c = y.c THEN 'same' ELSE 'diff' END AS cuis FROM thes t JOIN k x ON x.form = p1 JOIN k y ON y.form = p2)
SELECT p1 AS phrase1, p2 AS phrase2, round(overall, 6) AS overall, round(semantic, 6) AS semantic, round(ortho, 6) AS orthographic, round(abbr, 6) AS abbreviation, cuis FROM j"""
)
def labelled_pairs_file(spark, d):
    """Entries labelled by whether both forms have a concept, here a first letter, in common; terms without one are left out."""
    v = A._term_vectors(spark, d)
    concepts = v.where("freq % 4 <> 1").select("form", F.substring(F.lower("form"), 1, 1).alias("concept"))
    path = _place(spark, "labelled")
    IO.write_labelled_pairs(E.concept_pairs(A._thesaurus(spark, d), concepts), path)
    x = IO.read_labelled_pairs(spark, path)
    return x.select("phrase1", "phrase2", *[F.round(c, 6).alias(c) for c in ("overall", "semantic", "orthographic", "abbreviation")], "cuis")


# Settings and stages

_SETTINGS_FILE = """# all of a pipeline
textProcessor=org.example.AggressiveProcessor
minCount=25
npmiThresholds=0.2,0.4
maxNgramOrder=3
embeddingsCaseSensitive=true
semanticOrthoWeightRatio=2
#overallThreshold=0
"""


@query("SELECT 'aggressive' AS processor, 25 AS min_count, 3 AS max_ngram_order, 7 AS max_phrase_length, 0.4::DOUBLE AS threshold_5, true AS embeddings_case_sensitive, 2::DOUBLE AS semantic_ortho_ratio, true AS no_overall_threshold, true AS no_permutations")
def settings_file(spark, d):
    """Settings read from a file with names in inner capitals."""
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".properties") as f:  # the driver's own file
        f.write(_SETTINGS_FILE)
        f.flush()
        s = config.load(f.name)
    row = (s.processor, s.min_count, s.max_ngram_order, s.max_phrase_length, s.threshold(5), s.embeddings_case_sensitive, s.semantic_ortho_ratio, s.overall_threshold is None, s.permutation_penalty is None)
    names = "processor string, min_count int, max_ngram_order int, max_phrase_length int, threshold_5 double, embeddings_case_sensitive boolean, semantic_ortho_ratio double, no_overall_threshold boolean, no_permutations boolean"
    return spark.createDataFrame([row], names)


def _stages(spark, d: str) -> tuple[str, config.Settings]:
    """The folder of a corpus that went through the first stages."""
    path = _place(spark, "stages")
    s = config.Settings(processor="none", min_count=10, embeddings_case_sensitive=True)
    IO.write_lines(corpus(spark, d).where(~F.contains("line", F.lit("\r"))), f"{path}/corpus")
    for stage in (("preprocess", "corpus", "clean"), ("count", "clean", "counted"), ("prune", "counted", "pruned"), ("collocations", "found", "pruned"), ("apply", "found", "clean", "joined")):
        commands.run(spark, [stage[0], *[f"{path}/{x}" for x in stage[1:]]], s)
    return path, s


@query(f"WITH {A.ALL_FOUND} SELECT form, n::INT AS n, round(score, 8) AS score FROM everything")
def stages_to_collocations(spark, d):
    """Preprocess, count, prune and find, stage by stage through files."""
    path, _ = _stages(spark, d)
    return IO.read_collocations(spark, f"{path}/found").select("form", "n", F.round("score", 8).alias("score"))


_LINKED = f"""edge AS MATERIALIZED (
  SELECT a, b, row_number() OVER (ORDER BY overall DESC, a, b) AS place FROM (
    SELECT least(p1, p2) AS a, greatest(p1, p2) AS b, max(overall) AS overall FROM thes JOIN top x ON x.form = p1 JOIN top y ON y.form = p2 WHERE thes.overall >= 0.55 GROUP BY ALL)
)"""


@query(
    f"""WITH RECURSIVE {A._TERMS}, top AS MATERIALIZED (SELECT form, freq FROM terms WHERE NOT contains(form, '_') ORDER BY freq DESC, form LIMIT 200), {_LINKED},
walk(place, node) AS (
  SELECT place, a FROM edge
  UNION SELECT w.place, CASE WHEN e.a = w.node THEN e.b ELSE e.a END FROM walk w JOIN edge e ON (e.a = w.node OR e.b = w.node) AND e.place < w.place
), forest AS (SELECT a, b, row_number() OVER (ORDER BY place) AS n FROM edge e WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.place = e.place AND w.node = e.b)),
merged AS MATERIALIZED (SELECT a, b FROM forest WHERE n <= (SELECT count(*) FROM top) - 190),
reach(form, c) AS (SELECT form, form FROM top UNION SELECT CASE WHEN m.a = r.form THEN m.b ELSE m.a END, r.c FROM reach r JOIN merged m ON m.a = r.form OR m.b = r.form),
comp AS (SELECT form, min(c) AS cluster_id FROM reach GROUP BY form)
SELECT form, cluster_id, first_value(form) OVER (PARTITION BY cluster_id ORDER BY freq DESC, form) AS representative FROM comp JOIN top USING (form)"""
)
def stages_to_clusters(spark, d):
    """Vectors to a thesaurus, trimmed and clustered, stage by stage through files."""
    path = _place(spark, "stages")
    v = A._term_vectors(spark, d).where(~F.contains("form", F.lit("_")) & F.col("form").rlike("[A-Za-z]"))
    IO.write_word2vec(v, f"{path}/vectors")
    order = [F.desc("freq"), F.asc("form")]
    IO.write_lines(v.repartitionByRange(1, *order).sortWithinPartitions(*order).select(F.concat_ws(" ", "form", "freq").alias("line")), f"{path}/vocabulary")
    s = config.Settings(processor="none")
    commands.run(spark, ["thesaurus", f"{path}/vectors", f"{path}/made"], s)
    commands.run(spark, ["trim", f"{path}/made", f"{path}/trimmed", "0.55"], s)
    commands.run(spark, ["cluster", f"{path}/vocabulary", "200", f"{path}/trimmed", "190", f"{path}/clusters"], s)
    return IO.read_clusters(spark, f"{path}/clusters")
