"""Registered queries of the smaller operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import Settings
from ..functions import distance as D
from ..functions import phrase as P
from ..functions import text as T
from ..functions import vector as V
from ..operators import cluster as K
from ..operators import collocations as C
from ..operators import evaluate as E
from ..operators import ngrams as N
from ..operators import similarity as S
from ..operators import thesaurus as H
from ..operators.order import numbered
from ..scratch import save
from . import catalog as A
from .catalog import corpus, query, read

# Text and phrases


@query(r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (unnest(range(len(string_split(text, chr(10))))))::INT AS line_no
  FROM documents WHERE text IS NOT NULL) WHERE NOT regexp_full_match(line, '\s*')""")
def preprocess_none(spark, d):
    return N.preprocessed(corpus(spark, d), "none")


@F.pandas_udf(StringType())
def _turned(s: pd.Series) -> pd.Series:
    return s.str[::-1]


@query("SELECT p_partkey, upper(p_name) AS shouted, reverse(p_name) AS turned FROM part")
def own_processors(spark, d):
    """Processors of one's own: a column expression, and an Arrow function."""
    own = {"shout": F.upper, "turn": _turned}
    known = dict(T.PROCESSORS)
    try:
        T.PROCESSORS.update(own)
        shout, turn = T.processor("shout"), T.processor("turn")
    finally:
        T.PROCESSORS.clear()
        T.PROCESSORS.update(known)
    return read(spark, d, "part").select("p_partkey", shout(F.col("p_name")).alias("shouted"), turn(F.col("p_name")).alias("turned"))


@query("""SELECT p_partkey, unnest(list_distinct([p_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)])) AS form FROM part""")
def phrase_permutations(spark, d):
    return read(spark, d, "part").select("p_partkey", F.explode(P.permutations(F.col("p_name"))).alias("form"))


_LONGER = """lists AS (
  SELECT a, b FROM (SELECT DISTINCT p_name || ' ' || lower(p_mfgr) AS a, lower(p_mfgr) || ' ' || p_name AS b FROM (SELECT p_name, split_part(p_brand, '#', 2) AS p_mfgr FROM part))
)"""


@query(
    f"""WITH {_LONGER}, w AS (SELECT a, b, string_split(b, ' ') AS w FROM lists),
o AS (SELECT a, b, unnest([[1,3,2],[2,1,3],[2,3,1],[3,1,2],[3,2,1]]) AS o, w FROM w),
m AS (SELECT a, b, min(levenshtein(a, array_to_string(list_transform(o, lambda i: w[i]), ' '))) FILTER (array_to_string(list_transform(o, lambda i: w[i]), ' ') <> b) AS best FROM o GROUP BY a, b)
SELECT a, b, least(levenshtein(a, b), 1 + best)::DOUBLE AS distance FROM m"""
)
def permuted_three_words(spark, d):
    """Three words a side, all in another order."""
    brand = F.lower(F.substring_index("p_brand", "#", -1))
    p = read(spark, d, "part").select(F.concat_ws(" ", "p_name", brand).alias("a"), F.concat_ws(" ", brand, "p_name").alias("b")).distinct()
    return p.select("a", "b", D.reordered(F.col("a"), F.col("b"), 1.0).alias("distance"))


_OWN = D.Penalties(substitute=3, delete_a=1.5, delete_b=1, delete_b_word_initial=2, delete_b_initial=2.5)
_OWN_COST = "CASE WHEN j = 1 THEN 2.5 WHEN contains(' -/_&', substr(b, (j - 1)::INT, 1)) AND NOT contains(' -/_&', substr(b, j::INT, 1)) THEN 2.0 ELSE 1.0 END::DOUBLE"


@query(
    f"""WITH {A._NAMES}, costs AS (SELECT DISTINCT a, b, list_transform(range(1, length(b) + 1), lambda j: {_OWN_COST}) AS cost FROM pairs),
starts AS (SELECT a, b, cost, list_transform(range(0, length(b) + 1), lambda j: coalesce(list_sum(cost[1:j]), 0)::DOUBLE) AS start FROM costs)
SELECT a, b, list_extract({A._FOLD.format(a="a", b="b", start="start", cost="cost", delete=1.5, substitute=3)}, -1) AS distance FROM starts"""
)
def own_penalties(spark, d):
    """The weighted distance with penalties of one's own."""
    return A._name_pairs(spark, d).select("a", "b", D.weighted(F.col("a"), F.col("b"), _OWN).alias("distance"))


# Collocations

_C = A.FOUND


def _found(spark, d: str) -> DataFrame:
    return save(C.collocations(A._counts(spark, d), A.SETTINGS, bootstrap=False), "found").df


@query(f"WITH {_C} SELECT form, n, round(score, 8) AS score FROM found WHERE n = 2")
def collocations_of_length(spark, d):
    return C.of_length(_found(spark, d), 2).select("form", "n", F.round("score", 8).alias("score"))


@query(
    f"""WITH {_C}, more AS (SELECT 'brand new phrase' AS form, 3 AS n, 0.75::DOUBLE AS score UNION ALL SELECT form, n, 0.5::DOUBLE FROM found WHERE n = 3),
put AS (SELECT form, n, score FROM found WHERE form NOT IN (SELECT form FROM more) UNION ALL SELECT * FROM more)
SELECT form, n, round(score, 8) AS score FROM put WHERE form NOT IN (SELECT form FROM found WHERE n = 4)"""
)
def collocations_put_remove(spark, d):
    """A new phrase and new scores put in, the four-word phrases taken out."""
    found = _found(spark, d)
    more = spark.createDataFrame([("brand new phrase", 3, 0.75)], "form string, n int, score double")
    more = more.unionByName(C.of_length(found, 3).select("form", "n", F.lit(0.5).alias("score")))
    return C.removed(C.put(found, more), C.of_length(found, 4)).select("form", "n", F.round("score", 8).alias("score"))


@query(f"WITH {_C} SELECT g.form, round(coalesce(f.score, 0), 8) AS score FROM (SELECT form FROM counts WHERE n = 2) g LEFT JOIN found f USING (form)")
def collocation_scores(spark, d):
    """Scores of all counted two-word forms, 0 where they are no collocation."""
    counts = A._counts(spark, d)
    found = C.collocations(counts, A.SETTINGS, bootstrap=False)
    return C.score_of(found, counts.where("n = 2")).select("form", F.round("score", 8).alias("score"))


@query(f"WITH {_C} SELECT row_number() OVER (ORDER BY n, form) - 1 AS place, form, n FROM found")
def collocation_order(spark, d):
    return numbered(_found(spark, d), [F.asc("n"), F.asc("form")]).select("place", "form", "n")


@query(
    f"""WITH {_C}, {A._GOLD}, best AS (SELECT form FROM found ORDER BY score DESC, form DESC LIMIT 100)
SELECT count(*) AS phrases, round(avg((form IN (SELECT form FROM gold))::INT), 8) AS precision FROM best"""
)
def collocation_precision_top(spark, d):
    p = C.precision(_found(spark, d), A._gold(spark, d), 100)
    return p.select("phrases", F.round("precision", 8).alias("precision"))


_PHRASES = ", ".join(A._split(n) for n in (2, 3, 4, 5))


@query(f"WITH {A.LINES}, {A.TOTALS}, {_PHRASES} SELECT form, round(skip, 8) AS skip FROM s3")
def skipped_pairs(spark, d):
    """The score of first and last word of three-word phrases."""
    c = A._counts(spark, d)
    return C.phrase_scores(c.where("n = 3"), c, A.SETTINGS).select("form", F.round("skip", 8).alias("skip"))


# Vectors and vocabularies

_FORM = r"trim(regexp_replace(lower(term), '[\s_]+', ' ', 'g'))"
_VOCABULARY = f"""vocab AS (
  SELECT form, rank, vec FROM (SELECT {_FORM} AS form, rank_no AS rank, vec, row_number() OVER (PARTITION BY {_FORM} ORDER BY rank_no, vec_id) AS k
  FROM vectors WHERE term IS NOT NULL AND rank_no IS NOT NULL AND len(vec) = 96) WHERE k = 1
)"""


def _vocabulary(spark, d: str) -> DataFrame:
    """Terms of ``vectors`` with whole vectors, ranked; a term that comes again is ignored."""
    t = read(spark, d, "vectors").where("term is not null and rank_no is not null and size(vec) = 96")
    form = F.trim(F.regexp_replace(F.lower("term"), r"[\s_]+", " "))
    t = t.select(F.struct("rank_no", "vec_id").alias("rank"), form.alias("form"), "vec", "freq")
    return S.first_of_each_term(t).select(F.col("rank.rank_no").cast("long").alias("rank"), "form", "vec", "freq")


@query(f"WITH {_VOCABULARY} SELECT form, rank::BIGINT AS rank FROM vocab")
def first_of_each_term(spark, d):
    return _vocabulary(spark, d).select("form", "rank")


@query(
    f"""WITH {_VOCABULARY}, f AS (SELECT form, cnt FROM (SELECT regexp_replace(trim(form), '\\s+', ' ', 'g') AS form, sum(cnt) AS cnt FROM (SELECT DISTINCT * FROM ngrams)
  WHERE form IS NOT NULL GROUP BY 1))
SELECT form, coalesce(cnt, -1)::BIGINT AS freq FROM vocab LEFT JOIN f USING (form)"""
)
def term_frequencies(spark, d):
    """Frequencies put to the terms, -1 for those without."""
    counts = N.merged_counts(read(spark, d, "ngrams").distinct()).groupBy("form").agg(F.sum("cnt").alias("freq"))
    return S.with_frequencies(_vocabulary(spark, d), counts).select("form", F.coalesce("freq", F.lit(-1)).alias("freq"))


@query(f"WITH {_VOCABULARY} SELECT form, row_number() OVER (ORDER BY rank, form) - 1 AS rank FROM vocab WHERE form LIKE 'a%'")
def kept_terms(spark, d):
    v = _vocabulary(spark, d).select(F.struct("rank", "form").alias("rank"), "form")
    return S.kept_terms(v, v.where(F.col("form").startswith("a"))).select("form", "rank")


@query(
    f"""WITH {_VOCABULARY}, p AS (SELECT DISTINCT trim(regexp_replace(lower(p1), '[\\s_]+', ' ', 'g')) AS form FROM thesaurus WHERE p1 IS NOT NULL),
w AS (SELECT form, unnest(string_split(form, ' ')) AS w FROM p)
SELECT form FROM p WHERE form NOT IN (SELECT form FROM w WHERE w NOT IN (SELECT form FROM vocab))"""
)
def all_words_known(spark, d):
    form = F.trim(F.regexp_replace(F.lower("p1"), r"[\s_]+", " "))
    p = read(spark, d, "thesaurus").where("p1 is not null").select(form.alias("form")).distinct()
    return S.all_words_known(p, _vocabulary(spark, d)).select("form")


@query(f"WITH {A._V} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * i / 64)), 6) AS similarity FROM v")
def scored_by_vector(spark, d):
    return S.scored_by(A._vectors(spark, d), [i / 64 for i in range(1, 65)]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A._V} SELECT vec_id, len(e) AS size, round(e[64], 6) AS last, true AS same FROM v")
def vector_parts(spark, d):
    """Length, last component, and equality with itself."""
    v = F.col("vec")
    return A._vectors(spark, d).select(
        "vec_id", F.size(v).cast("long").alias("size"), F.round(V.component(v, 63).cast("double"), 6).alias("last"), (v == F.transform(v, lambda x: x)).alias("same")
    )


# Thesaurus

_MARKED_TERMS = f"""{A._MODERATE.strip()}, uni AS (SELECT form, count(*) AS freq FROM (
    SELECT unnest(regexp_split_to_array(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS form FROM done WHERE NOT regexp_full_match(line, '\\s*')) GROUP BY form),
ranked AS (SELECT form, freq, row_number() OVER (ORDER BY freq DESC, form) - 1 AS vec_id FROM uni), {A._V},
terms AS (SELECT form, freq, list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e)))::FLOAT::DOUBLE) AS e FROM ranked JOIN v USING (vec_id)
  WHERE regexp_matches(form, '[A-Za-z]') AND NOT contains(form, 'zxzxpz')),
""" + A._TERMS[A._TERMS.index("alike AS") :]


@query(_MARKED_TERMS + f" SELECT p1, p2, {A._ROUNDED} FROM thes")
def thesaurus_of_marked_lines(spark, d):
    """Over preprocessed lines, whose masked tokens, alike in spelling as they are, take no part."""
    counts = N.ngram_counts(N.preprocessed(corpus(spark, d), "moderate"), 1)
    v = A._vectors(spark, d)
    ranked = numbered(counts, [F.desc("cnt"), F.asc("form")], "vec_id").where(F.col("vec_id") < v.count())
    return A._rounded(H.build_thesaurus(ranked.join(v.select("vec_id", "vec"), "vec_id").select("form", "vec"), A.SETTINGS))


@query(f"WITH {A._TERMS} SELECT p1, p2, {A._ROUNDED} FROM thes WHERE thes.overall >= 0.55")
def thesaurus_overall_threshold(spark, d):
    return A._rounded(H.build_thesaurus(A._term_vectors(spark, d), Settings(min_count=10, overall_threshold=0.55)))


@query(
    f"WITH {A._TERMS} SELECT p1 AS head, row_number() OVER (PARTITION BY p1 ORDER BY overall DESC, p2) - 1 AS place, p2 AS form, round(overall, 6) AS overall FROM thes"
)
def thesaurus_nested(spark, d):
    """Entries of each headword, best first."""
    n = H.nested(A._thesaurus(spark, d))
    return n.select("head", F.posexplode("entries").alias("place", "e")).select("head", F.col("place").cast("long").alias("place"), "e.form", F.round("e.overall", 6).alias("overall"))


@query(f"WITH {A._TERMS} SELECT p1, p2, {A._ROUNDED} FROM thes WHERE p1 < p2")
def thesaurus_entries(spark, d):
    """Entries of asked pairs, of which some are unknown."""
    t = save(A._thesaurus(spark, d), "thesaurus").df
    asked = t.where("p1 < p2").select("p1", "p2").union(t.select("p1", F.lit("no such form")))
    return A._rounded(H.entries(t, asked))


@query(f"WITH {A._TERMS}, more AS (SELECT * FROM thes UNION ALL SELECT 'zz', p2, 1, 1, 0, 0 FROM thes) SELECT count(DISTINCT p1) AS headwords, count(*) AS entries FROM more")
def thesaurus_sizes(spark, d):
    """Sizes after entries of a new headword were added."""
    t = save(A._thesaurus(spark, d), "thesaurus").df
    one, zero = F.lit(1.0), F.lit(0.0)
    more = t.select(F.lit("zz").alias("p1"), "p2", one.alias("overall"), one.alias("semantic"), zero.alias("ortho"), zero.alias("abbr"))
    return E.total_sizes(H.with_entries(t, more))


# Clusters, evaluation, counters


@query(
    f"""WITH RECURSIVE {A._COMP}, r AS (SELECT form, arg_max(form, (label, -form)) OVER (PARTITION BY cluster_id) AS representative FROM comp JOIN v ON v.vec_id = form),
asked AS (SELECT unnest(range(-5, 40)) AS form) SELECT form, coalesce(representative, form) AS representative FROM asked LEFT JOIN r USING (form)"""
)
def cluster_lookup(spark, d):
    """Representatives of asked forms, unknown ones too."""
    links, terms = A._links(spark, d, 0.4)
    freq = A._vectors(spark, d).select(F.col("vec_id").alias("form"), F.col("label").alias("freq"))
    found = K.representatives(K.cluster_by_threshold(links, terms, 0.4), freq)
    return K.cluster_of(found, spark.range(-5, 40).toDF("form"))


@query("SELECT event_type, cnt, row_number() OVER (ORDER BY cnt, event_type) - 1 AS place FROM (SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type)")
def sorted_counter(spark, d):
    return E.sorted_counter(E.counted(read(spark, d, "events"), "event_type"), "event_type").select("event_type", "cnt", "place")


@query(
    """WITH c AS (SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id), o AS (SELECT user_id, count(*) AS cnt FROM events WHERE value > 50 GROUP BY user_id)
SELECT user_id, (coalesce(c.cnt, 0) + coalesce(c.cnt, 0) - coalesce(o.cnt, 0))::BIGINT AS cnt FROM c FULL JOIN o USING (user_id)"""
)
def added_counters(spark, d):
    """A counter added to itself, less another."""
    e = read(spark, d, "events")
    every, some = E.counted(e, "user_id"), E.counted(e.where("value > 50"), "user_id")
    return E.added(E.added(every, every, "user_id"), some, "user_id", -1)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey DESC) - 1 AS place FROM part")
def by_value(spark, d):
    return E.by_value(read(spark, d, "part"), "p_retailprice", "p_partkey", reverse=True).select("p_partkey", "place")


@query(
    """WITH s AS (SELECT DISTINCT s_nationkey AS g, s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0)
SELECT DISTINCT x.k AS a, y.k AS b FROM s x JOIN s y ON x.g = y.g AND x.k < y.k"""
)
def group_pairs_of_listed(spark, d):
    s = read(spark, d, "supplier")
    return E.pairs_within(s, "s_nationkey", "s_suppkey", s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("form")))


@query(
    """WITH s AS (SELECT DISTINCT s_nationkey AS g, s_suppkey AS k FROM supplier)
SELECT DISTINCT x.k AS a, y.k AS b FROM s x JOIN s y ON x.g = y.g AND x.k < y.k WHERE x.k % 5 <> 0 AND y.k % 5 <> 0"""
)
def group_pairs_without(spark, d):
    s = read(spark, d, "supplier")
    return E.without_terms(E.pairs_within(s, "s_nationkey", "s_suppkey"), s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("form")))


@query(
    """SELECT a.f AS a, b.f AS b FROM (SELECT p_name AS f, row_number() OVER (ORDER BY p_partkey) AS i FROM part) a
JOIN (SELECT c_name AS f, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) b USING (i)"""
)
def zipped_lists(spark, d):
    """Two lists as pairs by their places."""
    a = numbered(read(spark, d, "part").select("p_partkey", F.col("p_name").alias("form")), [F.col("p_partkey")])
    b = numbered(read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("form")), [F.col("c_custkey")])
    return E.zipped(a, b)
