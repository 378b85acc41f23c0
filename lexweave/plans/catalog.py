"""Registered queries and the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import distance as D
from ..functions import phrase as P
from ..functions import text as T
from ..functions import vector as V
from ..operators import apply as A
from ..operators import cluster as K
from ..operators import collocations as C
from ..operators import evaluate as E
from ..operators import ngrams as N
from ..operators import similarity as S
from ..operators import thesaurus as H
from ..operators.order import numbered
from ..scratch import save

#: Settings of the registered queries; the default minimum count is meant for larger collections.
SETTINGS = Settings(min_count=10)
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark, d: str) -> DataFrame:
    return N.lines(N.spread(read(spark, d, "documents").select("doc_id", "text").where("text is not null")))


LINES = r"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    (unnest(range(len(string_split(text, chr(10))))))::INT AS line_no
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT doc_id, line_no, regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+') AS w
  FROM lines WHERE NOT regexp_full_match(line, '\s*')
), counts AS (
  SELECT n::INT AS n, form, count(*) AS cnt FROM (
    SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS form
    FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE len(w) >= n
  ) GROUP BY ALL HAVING count(*) >= 10
)
"""


def _npmi(x: str, y: str, xy: str, n: str = "total") -> str:
    x, y, xy = (f"({c} / {n}::DOUBLE)" for c in (x, y, xy))
    return f"coalesce(ln({xy} / ({x} * {y})) / -ln({xy}), 0)"


def _split(n: int) -> str:
    lead = "regexp_replace(g.form, ' [^ ]*$', '')"
    trail = "regexp_replace(g.form, '^[^ ]* ', '')"
    first, last = "split_part(g.form, ' ', 1)", "split_part(g.form, ' ', -1)"
    return f"""
s{n} AS (
  SELECT g.form, g.cnt, {lead} AS lead_form, {trail} AS trail_form,
    {_npmi('a.cnt', 'z.cnt', 'g.cnt')} AS lead_score, {_npmi('y.cnt', 'b.cnt', 'g.cnt')} AS trail_score,
    {_npmi('y.cnt', 'z.cnt', 'g.cnt')} AS skip
  FROM counts g CROSS JOIN totals
  LEFT JOIN counts a ON a.form = {lead} AND a.n = {n - 1}
  LEFT JOIN counts z ON z.form = {last} AND z.n = 1
  LEFT JOIN counts y ON y.form = {first} AND y.n = 1
  LEFT JOIN counts b ON b.form = {trail} AND b.n = {n - 1}
  WHERE g.n = {n}
)"""


def _order(n: int) -> str:
    if n == 2:
        return _split(2) + ", c2 AS (SELECT form, 2 AS n, lead_score AS score FROM s2 WHERE lead_score > 0.3)"
    gate = f"""
g{n} AS (
  SELECT s.form, s.skip, greatest(0, CASE WHEN l.form IS NOT NULL THEN lead_score END, CASE WHEN t.form IS NOT NULL THEN trail_score END) AS score
  FROM s{n} s LEFT JOIN c{n - 1} l ON l.form = lead_form LEFT JOIN c{n - 1} t ON t.form = trail_form
)"""
    skip = "WHEN skip > 0.3 THEN skip" if n == 3 else ""
    return _split(n) + "," + gate + f""", c{n} AS (
  SELECT form, {n} AS n, score FROM (SELECT form, CASE WHEN score >= 0.5 THEN score {skip} END AS score FROM g{n}) WHERE score IS NOT NULL
)"""


TOTALS = "totals AS (SELECT sum(cnt) AS total FROM counts WHERE n = 1)"
ENDS = r"regexp_matches(split_part(form, ' ', 1), '\w') AND regexp_matches(split_part(form, ' ', -1), '\w')"
FOUND = f"""{LINES}, {TOTALS}, {_order(2)}, {_order(3)}, {_order(4)}, {_order(5)},
found AS (SELECT * FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3 UNION ALL SELECT * FROM c4 UNION ALL SELECT * FROM c5) WHERE {ENDS})"""


def _boot(n: int, source: str) -> str:
    return f"""b{n + 1} AS (
  SELECT DISTINCT x.form || ' ' || split_part(y.form, ' ', -1) AS form, {n + 1} AS n, 0.1::DOUBLE AS score
  FROM {source} x JOIN {source} y ON regexp_replace(x.form, '^[^ ]* ', '') = regexp_replace(y.form, ' [^ ]*$', '')
)"""


ALL_FOUND = FOUND + ", f5 AS (SELECT * FROM found WHERE n = 5), " + _boot(5, "f5") + ", " + _boot(6, "b6") + """,
everything AS (SELECT form, n, score FROM found UNION ALL SELECT * FROM b6 UNION ALL SELECT * FROM b7)"""


# Text

_MODERATE = r"""
WITH src AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (unnest(range(len(string_split(text, chr(10))))))::INT AS line_no
  FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, line_no, regexp_replace(line, '[\w.\-]+@[\w\-]+\.[\w]{2,3}', ' zxzxpzemail ', 'g') AS x FROM src WHERE NOT regexp_full_match(line, '\s*')),
b AS (SELECT doc_id, line_no, regexp_replace(x, '[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,4}', ' zxzxpzdate ', 'g') AS x FROM a),
c AS (SELECT doc_id, line_no, regexp_replace(x, '\d{1,2}:\d{2}(:\d{2})?', ' zxzxpztime ', 'g') AS x FROM b),
d AS (SELECT doc_id, line_no, regexp_replace(x, '(\d{3}-|\(\d{3}\) ?)\d{3}-\d{4}', ' zxzxpzphone ', 'g') AS x FROM c),
e AS (SELECT doc_id, line_no, regexp_replace(x, '[\d\-.,~]{3,}(\D|$)', ' zxzxpznumeral \1', 'g') AS x FROM d),
f AS (SELECT doc_id, line_no, regexp_replace(x, '[()\[\]{}".,;:?!]', '', 'g') AS x FROM e),
g AS (SELECT doc_id, line_no, regexp_replace(x, '([a-zA-Z])([~\-/&])', '\1 \2', 'g') AS x FROM f),
h AS (SELECT doc_id, line_no, regexp_replace(x, '([~\-/&])([a-zA-Z])', '\1 \2', 'g') AS x FROM g),
i AS (SELECT doc_id, line_no, regexp_replace(x, '[ \t]{4,}', ' zxzxpznewln ', 'g') AS x FROM h),
j AS (SELECT doc_id, line_no, regexp_replace(x, '[ \t]+', ' ', 'g') AS x FROM i),
ch AS (SELECT doc_id, line_no, unnest(string_split(x, '')) AS ch, unnest(range(len(string_split(x, '')))) AS k FROM j),
runs AS (SELECT *, lag(ch, 1) OVER w AS p1, lag(ch, 2) OVER w AS p2 FROM ch WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY k)),
done AS (
  SELECT doc_id, line_no, string_agg(ch, '' ORDER BY k) FILTER (WHERE regexp_matches(ch, '[a-zA-Z0-9]') OR ch IS DISTINCT FROM p1 OR ch IS DISTINCT FROM p2) AS line
  FROM runs GROUP BY doc_id, line_no
)
"""


@query(_MODERATE + "SELECT j.doc_id, j.line_no, coalesce(done.line, '') AS line FROM j LEFT JOIN done USING (doc_id, line_no)")
def preprocess_moderate(spark, d):
    return N.preprocessed(corpus(spark, d), "moderate")


@query(
    r"""WITH src AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (unnest(range(len(string_split(text, chr(10))))))::INT AS line_no
  FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line_no, lower(regexp_replace(regexp_replace(line, '[\W_]+', ' ', 'g'), '(\s)\d+\s', '\1', 'g')) AS line
FROM src WHERE NOT regexp_full_match(line, '\s*')"""
)
def preprocess_aggressive(spark, d):
    return N.preprocessed(corpus(spark, d), "aggressive")


@query(_MODERATE + "SELECT doc_id, count(*) AS marked FROM done WHERE contains(line, 'zxzxpz') GROUP BY doc_id")
def dummy_token_lines(spark, d):
    x = N.preprocessed(corpus(spark, d), "moderate").where(T.has_marker(F.col("line")))
    return x.groupBy("doc_id").agg(F.count("*").alias("marked"))


# Counts and collocations


def _counts(spark, d: str) -> DataFrame:
    return save(N.ngram_counts(corpus(spark, d), SETTINGS.max_ngram_order, SETTINGS.min_count), "counts").df


@query(f"WITH {LINES} SELECT n, form, cnt FROM counts")
def ngram_counts(spark, d):
    return N.ngram_counts(corpus(spark, d), SETTINGS.max_ngram_order, SETTINGS.min_count)


@query(
    """SELECT n, regexp_replace(trim(form), '\\s+', ' ', 'g') AS form, sum(cnt)::BIGINT AS cnt FROM (SELECT DISTINCT * FROM ngrams)
WHERE form IS NOT NULL GROUP BY n, regexp_replace(trim(form), '\\s+', ' ', 'g') HAVING sum(cnt) >= 10 AND NOT contains(regexp_replace(trim(form), '\\s+', ' ', 'g'), 'zxzxpz')"""
)
def merged_ngrams(spark, d):
    """Counts of shards merged; rows delivered twice count once."""
    return N.pruned(N.merged_counts(read(spark, d, "ngrams").distinct()), 10)


@query(f"WITH {LINES}, {TOTALS}, {_split(2)} SELECT form, cnt, round(lead_score, 8) AS npmi FROM s2")
def bigram_npmi(spark, d):
    c = _counts(spark, d)
    return C.split_scores(c, 2, C.total_words(c)).select("form", "cnt", F.round("lead_score", 8).alias("npmi"))


@query(f"WITH {LINES}, {TOTALS}, {_order(2)} SELECT form, round(score, 8) AS score FROM c2 WHERE {ENDS}")
def collocations_2(spark, d):
    lines = corpus(spark, d)
    c = save(N.ngram_counts(lines, 2, SETTINGS.min_count), "counts").df
    found = C.next_order(c, None, 2, C.total_words(c), SETTINGS)
    return C.ends_in_words(found).select("form", F.round("score", 8).alias("score"))


@query(f"WITH {FOUND} SELECT form, n, round(score, 8) AS score FROM found WHERE n >= 3")
def collocations_3to5(spark, d):
    found = C.collocations(_counts(spark, d), SETTINGS, bootstrap=False)
    return found.where("n >= 3").select("form", "n", F.round("score", 8).alias("score"))


def _all_found(spark, d: str) -> DataFrame:
    return C.collocations(_counts(spark, d), SETTINGS)


@query(f"WITH {ALL_FOUND} SELECT form, n, score FROM everything WHERE n >= 6")
def collocations_bootstrap(spark, d):
    return _all_found(spark, d).where("n >= 6")


@query(f"WITH {FOUND} SELECT form, n, round(score, 8) AS score FROM found ORDER BY found.score DESC, form DESC LIMIT 50")
def top_collocations(spark, d):
    found = C.collocations(_counts(spark, d), SETTINGS, bootstrap=False)
    return C.top_phrases(found, 50).select("form", "n", F.round("score", 8).alias("score"))


_GOLD = """gold AS (SELECT DISTINCT f AS form FROM (
  SELECT regexp_replace(lower(f), '[\\s_]+', ' ', 'g') AS f
  FROM (SELECT p1 AS f FROM thesaurus UNION ALL SELECT p2 FROM thesaurus UNION ALL SELECT term FROM vectors)) WHERE f IS NOT NULL)"""


def _gold(spark, d: str) -> DataFrame:
    """Forms of the thesaurus and the vocabulary."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"[\s_]+", " ").alias("form")
    t = read(spark, d, "thesaurus")
    return t.select(clean("p1")).union(t.select(clean("p2"))).union(read(spark, d, "vectors").select(clean("term"))).where("form is not null").distinct()


@query(f"WITH {FOUND}, {_GOLD} SELECT count(*) AS phrases, round(avg((form IN (SELECT form FROM gold))::INT), 8) AS precision FROM found")
def collocation_precision(spark, d):
    p = C.precision(C.collocations(_counts(spark, d), SETTINGS, bootstrap=False), _gold(spark, d), 0)
    return p.select("phrases", F.round("precision", 8).alias("precision"))


_STATS = f"""WITH {LINES}, {TOTALS}, {", ".join(_split(n) for n in (2, 3, 4, 5))}, x AS (
  {" UNION ALL ".join(f"SELECT {n} AS n, greatest(lead_score, trail_score) AS best FROM s{n}" for n in (2, 3, 4, 5))}
) SELECT coalesce(n, 0)::INT AS n, count(*) AS phrases, round(avg(best), 8) AS mean_npmi FROM x GROUP BY ROLLUP (n)"""


@query(_STATS)
def phrase_npmi_stats(spark, d):
    c = _counts(spark, d)
    s = C.score_summary(C.phrase_scores(c.where("n > 1"), c, SETTINGS))
    return s.select("n", "phrases", F.round("mean_npmi", 8).alias("mean_npmi"))


@query(
    f"""WITH RECURSIVE {FOUND},
base AS (SELECT row_number() OVER () AS k, doc_id, line_no, w FROM words),
dict AS (SELECT form, n FROM found),
starts AS (SELECT k, i, max(n) AS n FROM (
  SELECT k, i, n, unnest([array_to_string(w[i:i + n - 1], ' ')]) AS form FROM base, (SELECT unnest([2, 3, 4, 5]) AS n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
) c JOIN dict USING (form, n) GROUP BY k, i),
walk(k, i, step) AS (
  SELECT k, 1::BIGINT, coalesce(s.n, 1) FROM base LEFT JOIN starts s USING (k) WHERE s.i = 1
  UNION ALL SELECT k, 1::BIGINT, 1 FROM base WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.k = base.k AND s.i = 1)
), go(k, i, step) AS (
  SELECT * FROM walk
  UNION ALL
  SELECT g.k, g.i + g.step, coalesce(s.n, 1) FROM go g JOIN base b ON b.k = g.k LEFT JOIN starts s ON s.k = g.k AND s.i = g.i + g.step WHERE g.i + g.step <= len(b.w)
)
SELECT b.doc_id, b.line_no, string_agg(array_to_string(b.w[g.i:g.i + g.step - 1], '_'), ' ' ORDER BY g.i) AS line
FROM go g JOIN base b USING (k) GROUP BY ALL"""
)
def apply_collocations(spark, d):
    found = C.collocations(_counts(spark, d), SETTINGS, bootstrap=False)
    return A.apply_collocations(corpus(spark, d).where(~T.is_blank(F.col("line"))), save(found, "found").df)


@query(
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', -1) AS last_word, len(string_split(p_name, ' ')) AS n_words,
  length(p_name) AS chars, replace(p_name, ' ', '_') AS delimited, split_part(p_name, ' ', 2) AS without_first, split_part(p_name, ' ', 1) AS without_last,
  p_name || ' ' || p_brand AS both_names, contains(' ' || p_name || ' ', ' red ') AS has_red FROM part"""
)
def phrase_functions(spark, d):
    c = P.normalised(F.col("p_name"))
    return read(spark, d, "part").select(
        "p_partkey",
        P.word(c, 0).alias("first_word"),
        P.word(c, -1).alias("last_word"),
        P.n_words(c).cast("long").alias("n_words"),
        F.length(c).cast("long").alias("chars"),
        P.delimited(c, "_").alias("delimited"),
        P.without(c, 0).alias("without_first"),
        P.without(c, -1).alias("without_last"),
        P.concatenated(c, F.col("p_brand")).alias("both_names"),
        P.has_subphrase(c, F.lit("red")).alias("has_red"),
    )


# Vectors

_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def _vectors(spark, d: str) -> DataFrame:
    return read(spark, d, "embeddings").withColumnRenamed("embedding", "vec")


def _weighted(c):
    """All components in one number: their sum, each times its place from 1."""
    places = F.sequence(F.lit(1), F.size(c))
    return F.round(V.dot(c, places), 5)


def _sum(x: str, e: str = "a.e") -> str:
    x = x.replace("x /", f"{e}[i] /")
    return f"round(list_sum(list_transform(range(1, len({e}) + 1), lambda i: i * {x})), 5)"


@query(f"WITH {_V} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS magnitude, {_sum('(x / sqrt(list_dot_product(e, e)))::FLOAT::DOUBLE', 'e')} AS components FROM v")
def vector_normalize(spark, d):
    v = _vectors(spark, d)
    return v.select(
        "vec_id", F.round(V.magnitude(F.col("vec")), 6).alias("magnitude"), _weighted(V.normalised(F.col("vec"))).alias("components")
    )


@query(
    f"""WITH {_V} SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) AS dot, round(list_distance(a.e, b.e), 6) AS distance,
  round(list_cosine_similarity(a.e, b.e), 6) AS cosine, {_sum('(a.e[i] + b.e[i])::FLOAT::DOUBLE')} AS plus, {_sum('(a.e[i] - b.e[i])::FLOAT::DOUBLE')} AS minus,
  {_sum('(a.e[i] * b.e[i])::FLOAT::DOUBLE')} AS hadamard, {_sum('(a.e[i] * 2.5)::FLOAT::DOUBLE')} AS scaled, {_sum('(a.e[i] + 0.5)::FLOAT::DOUBLE')} AS shifted
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"""
)
def vector_ops(spark, d):
    v = _vectors(spark, d)
    p = v.select("vec_id", F.col("vec").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    first = _weighted
    return p.select(
        "vec_id",
        F.round(V.dot(a, b), 6).alias("dot"),
        F.round(V.euclidean(a, b), 6).alias("distance"),
        F.round(V.cosine(a, b), 6).alias("cosine"),
        first(V.plus(a, b)).alias("plus"),
        first(V.minus(a, b)).alias("minus"),
        first(V.hadamard(a, b)).alias("hadamard"),
        first(V.times_scalar(a, 2.5)).alias("scaled"),
        first(V.plus_scalar(a, 0.5)).alias("shifted"),
    )


@query(f"WITH {_V} SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.e, y.e), 6) AS semantic FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.3")
def cosine_pairs(spark, d):
    return S.similar_pairs(_vectors(spark, d), 0.3, "vec_id").select("a", "b", F.round("semantic", 6).alias("semantic"))


@query(
    f"""WITH {_V}, s AS (SELECT q.vec_id AS query, x.vec_id AS key, list_dot_product(q.e, x.e) AS dot FROM v q, v x WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dot, 9) DESC, key) AS place FROM s)
SELECT query, key, round(dot, 6) AS similarity, place FROM r WHERE place <= 10"""
)
def top_n_similar(spark, d):
    v = _vectors(spark, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "vec")
    t = S.top_n_similar(v, q, 10, "vec_id")
    return t.select("query", "key", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


@query(
    f"""WITH {_V}, m AS (SELECT label, list(avg_x ORDER BY i) AS e FROM (
  SELECT label, i, avg(x) AS avg_x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v) GROUP BY label, i) GROUP BY label)
SELECT m.label AS query, arg_max(v.vec_id, (round(list_dot_product(m.e, v.e), 9), -v.vec_id)) AS key FROM m, v GROUP BY m.label"""
)
def most_similar(spark, d):
    """The row most like the mean of each label."""
    v = _vectors(spark, d)
    at = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    mean = at.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    q = mean.select(F.col("label").alias("query"), F.transform("v", lambda s: s["x"].cast("float")).alias("vec"))
    return S.most_similar(v, q, "vec_id").select("query", "key")


@query(
    f"""WITH {_V}, q AS (SELECT list(x ORDER BY i) AS e FROM (SELECT i, sum(CASE WHEN vec_id = 2 THEN -x ELSE x END)::FLOAT::DOUBLE AS x
  FROM (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v WHERE vec_id IN (1, 2, 3)) GROUP BY i)),
r AS (SELECT vec_id AS key, list_dot_product(q.e, v.e) AS dot FROM q, v)
SELECT key, round(dot, 6) AS similarity FROM r ORDER BY round(dot, 9) DESC, key LIMIT 10"""
)
def analogy(spark, d):
    v = _vectors(spark, d)
    q = S.analogy_vector(v, [1, 3], [2], "vec_id").select(F.lit(0).alias("query"), "vec")
    return S.top_n_similar(v, q, 10, "vec_id").select("key", F.round("similarity", 6).alias("similarity"))


# Spelling

_NAMES = "names AS (SELECT DISTINCT p_name AS form FROM part), pairs AS (SELECT x.form AS a, y.form AS b FROM names x JOIN names y ON split_part(x.form, ' ', 1) = split_part(y.form, ' ', 1) AND x.form <> y.form)"


def _name_pairs(spark, d: str) -> DataFrame:
    """Ordered pairs of different part names with the same first word."""
    n = read(spark, d, "part").select(F.col("p_name").alias("form")).distinct()
    x = n.select(F.col("form").alias("a"), P.first_word(F.col("form")).alias("k"))
    y = n.select(F.col("form").alias("b"), P.first_word(F.col("form")).alias("k"))
    return x.join(y, "k").where("a <> b").select("a", "b")


@query(f"WITH {_NAMES} SELECT a, b, levenshtein(lower(a), lower(b))::INT AS distance, round(levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 8) AS share FROM pairs")
def ortho_distance(spark, d):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, d).select("a", "b", D.plain(a, b).alias("distance"), F.round(D.plain(a, b) / F.greatest(F.length(a), F.length(b)), 8).alias("share"))


@query(
    f"""WITH {_NAMES}, t AS (SELECT a, split_part(b, ' ', 2) || ' ' || split_part(b, ' ', 1) AS b FROM pairs)
SELECT a, b, least(levenshtein(a, b), 1 + levenshtein(a, split_part(b, ' ', 2) || ' ' || split_part(b, ' ', 1)))::DOUBLE AS distance FROM t"""
)
def permuted_distance(spark, d):
    turned = F.concat_ws(" ", P.last_word(F.col("b")), P.first_word(F.col("b")))
    p = _name_pairs(spark, d).select("a", turned.alias("b"))
    return p.select("a", "b", D.reordered(F.col("a"), F.col("b"), 1.0).alias("distance"))


#: One table row per character of a; the database's own levenshtein counts bytes, so the plain distance is folded like this as well.
_FOLD = """list_reduce(list_prepend({start}, list_transform(string_split(lower({a}), ''), lambda ch: [ord(ch)::DOUBLE])),
  lambda p, q: list_reduce(list_prepend([p[1] + {delete}], list_transform(range(1, length({b}) + 1), lambda j: [j::DOUBLE])),
    lambda r, k: list_append(r, least(
      p[k[1]::INT] + CASE WHEN ord(substr(lower({b}), k[1]::INT, 1)) = q[1]::INT THEN 0 ELSE {substitute} END,
      p[k[1]::INT + 1] + {delete}, r[k[1]::INT] + {cost}[k[1]::INT]))))"""


def _abbr_sql(source: str) -> str:
    """(a, b, distance) of ``source``(a, b), by a table of costs and one fold per character."""
    return f"""costs AS (
  SELECT a, b, list_transform(range(1, length(b) + 1), lambda j: CASE WHEN j = 1 THEN 2.0 WHEN contains(' -/_&', substr(b, (j - 1)::INT, 1)) AND NOT contains(' -/_&', substr(b, j::INT, 1)) THEN 1.0 ELSE 0.0 END::DOUBLE) AS cost
  FROM (SELECT DISTINCT a, b FROM {source})
), starts AS (SELECT a, b, cost, list_transform(range(0, length(b) + 1), lambda j: coalesce(list_sum(cost[1:j]), 0)::DOUBLE) AS start FROM costs),
abbr AS (SELECT a, b, list_extract({_FOLD.format(a="a", b="b", start="start", cost="cost", delete=2, substitute=4)}, -1) AS distance FROM starts)"""


def _plain_sql(source: str) -> str:
    start = "list_transform(range(0, length(b) + 1), lambda j: j::DOUBLE)"
    ones = "list_transform(range(0, length(b) + 1), lambda j: 1::DOUBLE)"
    return f"plain AS (SELECT a, b, list_extract({_FOLD.format(a='a', b='b', start=start, cost=ones, delete=1, substitute=1)}, -1) AS distance FROM (SELECT DISTINCT a, b FROM {source}))"


@query(f"WITH {_NAMES}, t AS (SELECT DISTINCT substr(split_part(a, ' ', 1), 1, 1) || substr(split_part(a, ' ', 2), 1, 1) AS a, b FROM pairs), {_abbr_sql('t')} SELECT a, b, distance FROM abbr")
def abbr_distance(spark, d):
    p = _name_pairs(spark, d)
    first = lambda c: F.substring(c, 1, 1)
    short = F.concat(first(P.first_word(F.col("a"))), first(P.last_word(F.col("a"))))
    return p.select(short.alias("a"), "b").distinct().withColumn("distance", D.abbreviation(F.col("a"), F.col("b")))


# Thesaurus


def _term_vectors(spark, d: str) -> DataFrame:
    """The most frequent terms of the documents bound to ``embeddings`` by rank."""
    counts = N.ngram_counts(corpus(spark, d), 1)
    v = _vectors(spark, d)
    n = v.count()
    ranked = numbered(counts, [F.desc("cnt"), F.asc("form")], "vec_id").where(F.col("vec_id") < n)  # as many as there are vectors
    return save(ranked.join(v.select("vec_id", "vec"), "vec_id").select("form", F.col("cnt").alias("freq"), "vec_id", "vec"), "term-vectors").df


_TERMS = LINES.split(", counts AS")[0] + f""", uni AS (SELECT form, count(*) AS freq FROM (SELECT unnest(w) AS form FROM words) GROUP BY form),
ranked AS (SELECT form, freq, row_number() OVER (ORDER BY freq DESC, form) - 1 AS vec_id FROM uni), {_V},
terms AS (SELECT form, freq, list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e)))::FLOAT::DOUBLE) AS e FROM ranked JOIN v USING (vec_id) WHERE regexp_matches(form, '[A-Za-z]')),
alike AS (SELECT x.form AS a, y.form AS b, list_dot_product(x.e, y.e) AS semantic FROM terms x JOIN terms y ON x.form <> y.form WHERE list_dot_product(x.e, y.e) >= 0.3),
low AS (SELECT DISTINCT lower(a) AS a, lower(b) AS b FROM alike), {_abbr_sql('low')}, {_plain_sql('low')},
thes AS (
  SELECT p1, p2, (semantic + 1 - least(ortho, abbr)) / 2 AS overall, semantic, ortho, abbr FROM (
    SELECT k.a AS p1, k.b AS p2, semantic, o.distance / greatest(length(k.a), length(k.b)) AS ortho,
      least(m.distance / length(k.a), n.distance / length(k.b)) AS abbr
    FROM alike k JOIN abbr m ON m.a = lower(k.a) AND m.b = lower(k.b) JOIN abbr n ON n.a = lower(k.b) AND n.b = lower(k.a)
    JOIN plain o ON o.a = lower(k.a) AND o.b = lower(k.b)
  ) WHERE ortho <= 0.4 OR abbr <= 0.5
)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("overall", "semantic", "ortho", "abbr"))


def _rounded(t: DataFrame) -> DataFrame:
    return t.select("p1", "p2", *[F.round(c, 6).alias(c) for c in ("overall", "semantic", "ortho", "abbr")])


def _thesaurus(spark, d: str) -> DataFrame:
    return H.build_thesaurus(_term_vectors(spark, d), SETTINGS)


@query(f"WITH {_TERMS} SELECT p1, p2, {_ROUNDED} FROM thes")
def thesaurus_pairs(spark, d):
    return _rounded(_thesaurus(spark, d))


@query(f"WITH {_TERMS} SELECT p1, p2, {_ROUNDED} FROM thes WHERE thes.overall >= 0.6")
def thesaurus_trim(spark, d):
    return _rounded(H.trimmed(_thesaurus(spark, d), 0.6))


@query(f"WITH {_TERMS} SELECT p1, p2, {_ROUNDED} FROM thes WHERE p1 IN (SELECT lower(form) FROM terms)")
def thesaurus_lookup(spark, d):
    """Entries of the headwords that the lower-cased terms name."""
    v = _term_vectors(spark, d)
    t = H.build_thesaurus(v, SETTINGS)
    return _rounded(H.equivalents(t, H.with_letters(v)))


@query(f"WITH {_TERMS} SELECT DISTINCT least(p1, p2) AS p1, greatest(p1, p2) AS p2, {_ROUNDED} FROM thes")
def thesaurus_undirected(spark, d):
    return H.undirected(_rounded(_thesaurus(spark, d)))


# Clusters

_COMP = f"""{_V}, edge AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.4),
reach(form, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.form),
comp AS (SELECT form, min(c) AS cluster_id FROM reach GROUP BY form)"""


def _links(spark, d: str, minimum: float):
    v = _vectors(spark, d)
    pairs = S.similar_pairs(v, minimum, "vec_id").select(F.col("a").alias("p1"), F.col("b").alias("p2"), F.col("semantic").alias("score"))
    return save(pairs, "links").df, v.select(F.col("vec_id").alias("form"))


@query(f"WITH RECURSIVE {_COMP} SELECT form, cluster_id FROM comp")
def cluster_threshold(spark, d):
    links, terms = _links(spark, d, 0.4)
    return K.cluster_by_threshold(links, terms, 0.4)


@query(
    f"""WITH RECURSIVE {_V}, edge AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b, row_number() OVER (ORDER BY list_dot_product(x.e, y.e) DESC, x.vec_id, y.vec_id) AS place
  FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.3
), walk(place, node) AS (
  SELECT place, a FROM edge
  UNION SELECT w.place, CASE WHEN e.a = w.node THEN e.b ELSE e.a END FROM walk w JOIN edge e ON (e.a = w.node OR e.b = w.node) AND e.place < w.place
), forest AS (
  SELECT a, b, place, row_number() OVER (ORDER BY place) AS n FROM edge e WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.place = e.place AND w.node = e.b)
), merged AS MATERIALIZED (
  SELECT a, b FROM forest, (SELECT count(*) AS terms FROM v) WHERE n <= terms - floor(terms * 0.8)
), reach(form, c) AS (
  SELECT vec_id, vec_id FROM v
  UNION SELECT CASE WHEN m.a = r.form THEN m.b ELSE m.a END, r.c FROM reach r JOIN merged m ON m.a = r.form OR m.b = r.form
) SELECT form, min(c) AS cluster_id FROM reach GROUP BY form"""
)
def cluster_k(spark, d):
    links, terms = _links(spark, d, 0.3)
    return K.cluster_by_count(links, terms, int(terms.count() * 0.8))


@query(f"WITH RECURSIVE {_COMP} SELECT form, cluster_id, arg_max(form, (label, -form)) OVER (PARTITION BY cluster_id) AS representative FROM comp JOIN v ON v.vec_id = form")
def cluster_representative(spark, d):
    """The label stands for the frequency."""
    links, terms = _links(spark, d, 0.4)
    freq = _vectors(spark, d).select(F.col("vec_id").alias("form"), F.col("label").alias("freq"))
    return K.representatives(K.cluster_by_threshold(links, terms, 0.4), freq)


@query(f"WITH RECURSIVE {_COMP} SELECT size, count(*) AS clusters FROM (SELECT cluster_id, count(*) AS size FROM comp GROUP BY cluster_id) GROUP BY size")
def cluster_sizes(spark, d):
    links, terms = _links(spark, d, 0.4)
    return K.sizes(K.cluster_by_threshold(links, terms, 0.4)).groupBy("size").agg(F.count("*").alias("clusters"))


# Evaluation


def _judged(spark, d: str) -> DataFrame:
    v = _vectors(spark, d)
    t = S.similar_pairs(v, 0.3, "vec_id").select(F.col("a").alias("p1"), F.col("b").alias("p2"))
    # Every tenth row has no concept, so that unknown terms occur.
    concepts = v.where("vec_id % 10 <> 7").select(F.col("vec_id").alias("form"), F.col("label").alias("concept"))
    return E.concept_pairs(t, concepts)


_JUDGED = f"""{_V}, j AS (SELECT x.vec_id AS p1, y.vec_id AS p2, CASE WHEN x.vec_id % 10 = 7 OR y.vec_id % 10 = 7 THEN 'unknown' WHEN x.label = y.label THEN 'same' ELSE 'different' END AS verdict
FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.3)"""


@query(f"WITH {_JUDGED} SELECT p1, p2, verdict FROM j")
def concept_pairs(spark, d):
    return _judged(spark, d)


@query(
    f"""WITH {_JUDGED} SELECT count(*) FILTER (verdict <> 'unknown') AS known, count(*) FILTER (verdict = 'unknown') AS unknown, count(*) FILTER (verdict = 'same') AS same,
  count(*) FILTER (verdict = 'different') AS different, round(count(*) FILTER (verdict <> 'unknown') / count(*), 8) AS coverage FROM j"""
)
def concept_eval(spark, d):
    return E.concept_summary(_judged(spark, d))


@query("SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
def group_pairs(spark, d):
    """Pairs of suppliers of the same nation, as pairs of terms of the same concept."""
    return E.pairs_within(read(spark, d, "supplier"), "s_nationkey", "s_suppkey")


@query(
    """WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('1:' || p_partkey), p_partkey) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT p_partkey FROM part))
SELECT x.p_partkey AS a, y.p_partkey AS b FROM p x JOIN p y ON x.rn + y.rn = x.n + 1 WHERE x.rn <= x.n // 2"""
)
def random_pairs(spark, d):
    return E.random_pairs(read(spark, d, "part"), "p_partkey")


@query("SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type")
def counter(spark, d):
    return E.counted(read(spark, d, "events"), "event_type")
