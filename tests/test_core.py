"""Core operators on hand-made cases and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave import config
from lexweave.functions import distance as D
from lexweave.functions import phrase as P
from lexweave.functions import text as T
from lexweave.functions import vector as V
from lexweave.operators import apply as A
from lexweave.operators import cluster as K
from lexweave.operators import collocations as C
from lexweave.operators import evaluate as E
from lexweave.operators import ngrams as N
from lexweave.operators import similarity as S
from lexweave.operators import thesaurus as H
from lexweave.sources import formats as X


def one(spark, column, **values):
    """Value of a column expression over one row."""
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<float>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("a.b@c-d.org", " zxzxpzemail "), ("on 1/2/2016", "on zxzxpzdate "), ("10:30", " zxzxpztime "), ("10:30:05", " zxzxpztime "),
        ("555-123-4567", " zxzxpzphone "), ("100 mg", " zxzxpznumeral mg"), ("3-4", " zxzxpznumeral "), ("a...", "a zxzxpznumeral "),
        ('say "no"!', "say no"), ("and/or", "and / or"), ("a    b", "a zxzxpznewln b"), ("a \t b", "a b"), ("x @@@@@ y", "x @@ y"), ("", ""),
    ],
)
def test_moderate(spark, line, want):
    assert one(spark, T.moderate(F.col("c")), c=line) == want


def test_aggressive_and_registry(spark):
    assert one(spark, T.aggressive(F.col("c")), c="A_b 1 22 c!") == "a b 22 c "
    assert one(spark, T.has_marker(F.col("c")), c="a zxzxpzdate") is True
    with pytest.raises(KeyError):
        T.processor("nothing")


def test_phrases(spark):
    c = F.col("c")
    assert one(spark, P.normalised(c), c="\t a  b ") == "a b"
    assert one(spark, P.word(c, -1), c="a b c") == "c" and one(spark, P.word(c, 5), c="a b") is None
    assert one(spark, P.without(c, 1), c="a b c") == "a c" and one(spark, P.without(c, -1), c="a b c") == "a b" and one(spark, P.without(c, 9), c="a b") == "a b"
    assert one(spark, P.has_subphrase(c, F.lit("a b")), c="xa b") is False
    assert one(spark, P.permutations(c), c="b a") == ["a b", "b a"]


def test_vectors(spark):
    zero, a = [0.0, 0.0], [3.0, 4.0]
    assert one(spark, V.magnitude(F.col("c")), c=a) == 5.0 and one(spark, V.normalised(F.col("c")), c=zero) == zero
    assert one(spark, V.normalised(F.col("c")), c=a) == pytest.approx([0.6, 0.8])
    assert one(spark, V.cosine(F.col("c"), F.col("d")), c=a, d=zero) is None


@pytest.mark.parametrize(("a", "b", "want"), [("bp", "blood pressure", 0), ("chf", "congestive heart failure", 0), ("b", "abc", 2), ("x", "y", 4), ("blood pressure", "bp", 24), ("", "ab", 2), ("ab", "", 4)])
def test_abbreviation_distance(a, b, want):
    assert D.weighted_distances([a], [b], D.ABBREVIATION)[0] == want


def test_plain_weights_are_levenshtein():
    rnd = random.Random(1)
    w = lambda: "".join(rnd.choice("ab c") for _ in range(rnd.randrange(7)))
    a, b = [w() for _ in range(200)], [w() for _ in range(200)]
    assert D.weighted_distances(a, b, D.PLAIN).tolist() == [D._advanced(list(range(len(y) + 1)), x, y)[-1] for x, y in zip(a, b)]


def test_reordered_depends_on_direction(spark):
    df = spark.createDataFrame([("bbaa a", "aa bb"), ("aa bb", "bbaa a"), (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(D.reordered(F.col("a"), F.col("b"), 1.0)).collect()]
    assert got == [3.0, 4.0, None]
    assert [r[0] for r in df.select(D.abbreviation(F.col("a"), F.col("b"))).collect()][2] is None


def test_counts_and_collocations(spark):
    lines = ["big red dog ran"] * 6 + ["big red dog sat"] * 6 + ["a b", "b c", "c a", "  ", "dog a", "a dog"] * 5
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, line string")
    counts = {(r["n"], r["form"]): r["cnt"] for r in N.ngram_counts(df, 3).collect()}
    assert counts[1, "dog"] == 22 and counts[2, "big red"] == 12 and counts[3, "big red dog"] == 12 and (3, "a b b") not in counts
    s = config.Settings(min_count=5, max_ngram_order=3, max_phrase_length=4)
    table = N.ngram_counts(df, 3, 5).cache()
    found = {r["form"]: r["score"] for r in C.collocations(table, s).collect()}
    assert found["big red"] == pytest.approx(1.0) and "big red dog" in found and found.get("big red dog ran", 0.1) == 0.1
    assert [r["form"] for r in C.top_phrases(spark.createDataFrame([("a b", 2, 1.0), ("c d", 2, 1.0)], "form string, n int, score double"), 1).collect()] == ["c d"]
    empty = N.ngram_counts(df.limit(0), 3)
    assert C.collocations(empty, s).count() == 0


def test_apply_both_ways(spark):
    found = spark.createDataFrame([("a b", 2, 1.0), ("a b c", 3, 1.0), ("c d", 2, 1.0), ("e f", 2, 1.0)], "form string, n int, score double")
    lines = [(1, "x a b  c d e f"), (2, "a b"), (3, "A b"), (4, ""), (5, None), (6, "e f e f"), (7, "c d g")]
    df = spark.createDataFrame(lines, "k long, line string")
    want = {1: "x a_b_c d e_f", 2: "a_b", 3: "A b", 4: "", 5: None, 6: "e_f e_f", 7: "c_d g"}
    got = {r["k"]: r["line"] for r in A.apply_collocations(df, found).collect()}
    assert got == want
    joined = {r["k"]: r["line"] for r in A.apply_collocations(df.where("line is not null"), found, broadcast_limit=0).collect()}
    assert joined == {k: v for k, v in want.items() if v is not None}


def test_pairs_top_and_analogy(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "rank long, vec array<float>")
    sim = m.astype(float) @ m.T.astype(float)
    want = {(i, j) for i in range(60) for j in range(60) if i != j and sim[i, j] >= 0.5}
    old, S.BLOCK_ROWS = S.BLOCK_ROWS, 16
    got = {(r["a"], r["b"]) for r in S.similar_pairs(df, 0.5, "rank").collect()}
    S.BLOCK_ROWS = old
    assert got == want
    q = df.where("rank < 3").select(F.col("rank").alias("query"), "vec")
    top = {(r["query"], r["place"]): r["key"] for r in S.top_n_similar(df, q, 4).collect()}
    assert all(top[i, k + 1] == np.argsort(-sim[i], kind="stable")[k] for i in range(3) for k in range(4))
    assert S.analogy_vector(df, [0, 1], [2]).first()["vec"] == pytest.approx((m[0] + m[1] - m[2]).tolist(), abs=1e-6)
    assert S.similar_pairs(df.limit(0), 0.5, "rank").count() == 0


def test_more_queries_than_are_broadcast_are_compared_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(31).standard_normal((300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "rank long, vec array<float>")
    q = df.where("rank < 90").select(F.col("rank").alias("query"), "vec")
    q = q.unionByName(spark.createDataFrame([(500, None)], "query long, vec array<float>"))
    monkeypatch.setattr(S, "MOST_BROADCAST_QUERIES", 20)
    got = {(r["query"], r["place"]): r["key"] for r in S.top_n_similar(df, q, 4).collect()}
    sim = np.round(x[:90].astype(float) @ x.T.astype(float), 9)
    assert got == {(i, p + 1): int(k) for i in range(90) for p, k in enumerate(np.lexsort((np.arange(300), -sim[i]))[:4])}
    assert {(r["query"], r["key"]) for r in S.most_similar(df, q).collect()} == {(i, got[i, 1]) for i in range(90)}


def _kruskal(links, terms, k):
    parent = {t: t for t in terms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = len(terms)
    for s, a, b in sorted((-s, min(a, b), max(a, b)) for a, b, s in links):
        if n <= k:
            break
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            n -= 1
    return {t: find(t) for t in terms}


@pytest.mark.parametrize("many, hub", [(K.MANY_EDGES, K.HUB_EDGES), (0, 3)])
def test_clusters_agree_with_one_task_merging(spark, monkeypatch, many, hub):
    monkeypatch.setattr(K, "MANY_EDGES", many)
    monkeypatch.setattr(K, "HUB_EDGES", hub)
    rnd = random.Random(3)
    terms = [f"t{i:02d}" for i in range(40)]
    links = [(*rnd.sample(terms, 2), round(rnd.random(), 1)) for _ in range(60)]
    best = {}
    for a, b, s in links:
        key = (min(a, b), max(a, b))
        best[key] = max(s, best.get(key, 0))
    df = spark.createDataFrame(links + [("t00", "t00", 1.0), ("t01", "zz", 1.0)], "p1 string, p2 string, score double")
    t = spark.createDataFrame([(x,) for x in terms], "form string")
    got = {r["form"]: r["cluster_id"] for r in K.cluster_by_count(df, t, 15).collect()}
    assert got == _kruskal([(a, b, s) for (a, b), s in best.items()], terms, 15)
    rep = K.representatives(spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "form string, cluster_id string"), spark.createDataFrame([("b", 5)], "form string, freq long"))
    assert {r["form"]: r["representative"] for r in rep.collect()} == {"a": "b", "b": "b", "c": "c"}


def test_thesaurus_steps(spark):
    v = spark.createDataFrame([("heart rate", [1.0, 0.0]), ("hr", [0.9, 0.1]), ("rate heart", [1.0, 0.05]), ("42", [1.0, 0.0]), ("far", [0.0, 1.0])], "form string, vec array<float>")
    t = H.build_thesaurus(v, config.Settings())
    got = {(r["p1"], r["p2"]): r for r in t.collect()}
    assert ("heart rate", "hr") in got and ("heart rate", "rate heart") in got and not any("42" in k for k in got)
    assert got["heart rate", "rate heart"]["ortho"] == pytest.approx(0.1)
    assert H.trimmed(t, 2.0).count() == 0 and H.undirected(t).count() * 2 == t.count()


def test_files_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a b", "c", 0.9, 0.8, 0.1, 0.2), ("a b", "d", 0.95, 0.8, 0.1, 0.2)], "p1 string, p2 string, overall double, semantic double, ortho double, abbr double")
    X.write_thesaurus(t, f"{tmp_path}/t", "moderate")
    assert sorted(map(tuple, X.read_thesaurus(spark, f"{tmp_path}/t").collect())) == sorted(map(tuple, t.collect()))
    assert X.read_thesaurus_header(spark, f"{tmp_path}/t") == {"case_sensitive": False, "processor": "moderate"}
    c = spark.createDataFrame([("a", "a", "b"), ("b", "a", "b"), ("c", "c", "c")], "form string, cluster_id string, representative string")
    X.write_clusters(c, f"{tmp_path}/c")
    assert sorted(map(tuple, X.read_clusters(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, c.collect()))
    m = np.arange(6, dtype=np.float32).reshape(2, 3)
    (tmp_path / "w.bin").write_bytes(X.encode_word2vec(["a b", "ü"], m))
    assert [(r["form"], r["vec"]) for r in X.read_word2vec(spark, f"{tmp_path}/w.bin").orderBy("rank").collect()] == [("a b", [0, 1, 2]), ("ü", [3, 4, 5])]
    (tmp_path / "v.txt").write_text("a_b 9\nü 2\n")
    vocab = X.read_vocabulary(spark, f"{tmp_path}/v.txt")
    assert X.read_word2vec_frequent(spark, f"{tmp_path}/w.bin", vocab, 5).count() == 1 and X.read_word2vec_frequent(spark, f"{tmp_path}/w.bin", vocab, 50).count() == 0
    (tmp_path / "g.bin").write_bytes(np.array([[3, 0, 7], [0, 1, 7], [0, 4, 7], [0, 0, 7]], "<f8").tobytes())
    assert [r["vec"] for r in X.read_glove(spark, f"{tmp_path}/g.bin", f"{tmp_path}/v.txt").orderBy("rank").collect()] == [pytest.approx([0.6, 0.8]), [0, 1]]
    (tmp_path / "m.rrf").write_text("C1|ENG|P|L1|" + "|" * 10 + "heart|x\nC2|GER|P|L1|" + "|" * 10 + "herz|x\n")
    assert [tuple(r) for r in X.read_concepts(spark, f"{tmp_path}/m.rrf").collect()] == [("C1", "L1", "heart")]
    e = spark.createDataFrame([("a", "b", None, 0.5)], "phrase1 string, phrase2 string, semantic double, abbreviation double")
    X.write_experiment(e, f"{tmp_path}/e")
    assert [tuple(r) for r in X.read_experiment(spark, f"{tmp_path}/e").collect()] == [("a", "b", None, 0.5)]
    n = spark.createDataFrame([(2, "a b", 7), (1, "a", 9)], "n int, form string, cnt long")
    X.write_counts(n, f"{tmp_path}/n")
    assert [tuple(r) for r in X.read_counts(spark, f"{tmp_path}/n/n=2", 2, 5).collect()] == [(2, "a b", 7)]
    (tmp_path / "s.properties").write_text("# x\nmin_count = 7\nnpmi_thresholds=0.1,0.2\noverall_threshold=\n")
    s = config.load(f"{tmp_path}/s.properties")
    assert s.min_count == 7 and s.threshold(5) == 0.2 and s.overall_threshold is None


def test_evaluation(spark):
    t = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "z")], "p1 string, p2 string")
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("a", 3)], "form string, concept int")
    judged = E.concept_pairs(t, c)
    assert {r["p2"]: r["verdict"] for r in judged.collect()} == {"b": "same", "c": "different", "z": "unknown"}
    assert E.concept_summary(judged).first()["coverage"] == pytest.approx(2 / 3, abs=1e-8)
    pairs = E.random_pairs(spark.range(11).toDF("id"), "id").collect()
    assert len(pairs) == 5 and len({x for r in pairs for x in r}) == 10


def test_streaming_counts(spark, tmp_path):
    from lexweave.streaming import counts

    spark.createDataFrame([("2024-01-01 00:00:10", "a b"), ("2024-01-01 00:00:20", "a"), ("2024-01-01 00:20:00", "a")], "t string, line string").select(F.to_timestamp("t").alias("t"), "line").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, line string").parquet(f"{tmp_path}/in")
    q = counts.windowed_counts(counts.preprocessed(stream, "none"), 2, "t", "5 minutes", "1 minute").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["window"]["start"].minute, r["form"]): r["cnt"] for r in spark.table("windowed").collect()}
    assert got == {(0, "a"): 2, (0, "b"): 1, (0, "a b"): 1, (20, "a"): 1}


# Settings, files, stages


def test_settings_with_inner_capitals(tmp_path):
    (tmp_path / "a.properties").write_text("textProcessor=org.example.NullProcessor\nminCount=9\nngramCountFilenames=a.txt,b.txt\n#overallThreshold=0\nsemanticMinimum=.35\nunknownKey=1\n")
    s = config.load(f"{tmp_path}/a.properties")
    assert (s.processor, s.min_count, s.ngram_count_filenames, s.semantic_minimum) == ("none", 9, ("a.txt", "b.txt"), 0.35)
    assert s.overall_threshold is None and s.permutation_penalty is None and s.ortho_maximum == config.Settings().ortho_maximum
    (tmp_path / "b.properties").write_text("textProcessor=org.example.Unheard\n")
    with pytest.warns(UserWarning):
        assert config.load(f"{tmp_path}/b.properties").processor == "moderate"


def test_thesaurus_file_as_other_programs_write_it(spark, tmp_path):
    (tmp_path / "t.txt").write_text("case-sensitive thesaurus\nclass org.example.OwnProcessor\nalone\nheart attack\tMI\t0.9;0.8;0.7;0.1\tinfarct\t0.5;0.4;0.3;0.2\n")
    assert X.read_thesaurus_header(spark, f"{tmp_path}/t.txt") == {"case_sensitive": True, "processor": "org.example.OwnProcessor"}
    assert sorted(r["p2"] for r in X.read_thesaurus(spark, f"{tmp_path}/t.txt").collect()) == ["MI", "infarct"]
    t = X.read_thesaurus(spark, f"{tmp_path}/t.txt")
    X.write_thesaurus(t, f"{tmp_path}/out", "p", case_sensitive=False)
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["non-case-sensitive thesaurus", "p", "heart attack\tMI\t0.9;0.8;0.7;0.1\tinfarct\t0.5;0.4;0.3;0.2"]


def test_a_large_headword_comes_in_several_rows_in_order(spark):
    data = [("hot", f"f{i:04d}", float((i * 7) % 50), 0.0, 0.0, 0.0) for i in range(900)] + [("cold", "x", None, 0.0, 0.0, 0.0), ("cold", "y", 1.0, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(data, "p1 string, p2 string, overall double, semantic double, ortho double, abbr double").repartition(3)
    got = H.nested(t, most=100).collect()
    hot = [e["form"] for r in sorted((r for r in got if r["head"] == "hot"), key=lambda r: r["part"]) for e in r["entries"]]
    assert hot == [x[1] for x in sorted((x for x in data if x[0] == "hot"), key=lambda x: (-x[2], x[1]))]
    assert sum(r["head"] == "hot" for r in got) > 1 and all(len(r["entries"]) < 900 for r in got)
    assert [[e["form"] for e in r["entries"]] for r in got if r["head"] == "cold"] == [["y", "x"]]


def test_numbers_have_no_gaps_and_follow_the_order(spark):
    from lexweave.operators.order import first_rows, numbered

    df = spark.range(1_000).select((F.col("id") * 37 % 1_000).alias("k"))
    assert sorted((r["place"], r["k"]) for r in numbered(df, [F.desc("k")], start=1).collect()) == [(i + 1, 999 - i) for i in range(1_000)]
    assert sorted(r["k"] for r in first_rows(df, [F.col("k")], 3).collect()) == [0, 1, 2]
    assert numbered(df.limit(0), [F.col("k")]).count() == 0 and first_rows(df, [F.col("k")], 0).count() == 0


def test_vector_files_stream_split_and_keep_the_first_of_a_term(spark, tmp_path, monkeypatch):
    from lexweave.sources import binary

    m = np.arange(15, dtype=np.float32).reshape(5, 3)
    (tmp_path / "no_newline.bin").write_bytes(X.encode_word2vec(["a", "b c", "a", "__", "d"], m).replace(b"\n", b"\n", 1))
    got = {r["form"]: r["vec"] for r in X.read_word2vec(spark, f"{tmp_path}/no_newline.bin").collect()}
    assert got == {"a": [0, 1, 2], "b c": [3, 4, 5], "d": [12, 13, 14]}
    dense = b"2 3\n" + b"x " + m[0].tobytes() + b"y " + m[1].tobytes()  # no newline after a vector
    assert X.decode_word2vec(dense)[1] == ["x", "y"] and X.decode_word2vec(dense, 1)[1] == ["x"]
    with pytest.raises(EOFError):
        X.decode_word2vec(dense[:-2])
    (tmp_path / "many").mkdir()
    assert X.write_word2vec(spark.createDataFrame([(f"t{i}", [float(i)] * 3) for i in range(50)], "form string, vec array<float>").repartition(3), f"{tmp_path}/many") == 50
    assert {r["form"]: r["vec"][0] for r in X.read_word2vec(spark, f"{tmp_path}/many").collect()} == {f"t{i}": float(i) for i in range(50)}
    assert len(binary.files_of(f"{tmp_path}/many")) == 3
    words, contexts = np.random.default_rng(1).standard_normal((2, 20, 4))
    (tmp_path / "g.bin").write_bytes(X.encode_glove(words, contexts))
    (tmp_path / "g.txt").write_text("".join(f"w{i} 1\n" for i in range(20)))
    monkeypatch.setattr(binary._GloveReader, "split_rows", 6)
    got = {r["form"]: r["vec"] for r in X.read_glove(spark, f"{tmp_path}/g.bin", f"{tmp_path}/g.txt").collect()}
    both = words + contexts
    for i in range(20):
        assert got[f"w{i}"] == pytest.approx(both[i] / np.linalg.norm(both[i]), abs=1e-6)


def test_pairs_of_a_large_group_are_spread(spark, monkeypatch):
    monkeypatch.setattr(E, "GROUP_BLOCK", 7)
    items = spark.createDataFrame([("g", f"i{i:02d}") for i in range(40)] + [("h", "i01"), ("h", "z"), (None, "q"), ("h", None), ("g", "i00")], "g string, i string")
    got = {tuple(r) for r in E.pairs_within(items, "g", "i").collect()}
    assert got == {(f"i{a:02d}", f"i{b:02d}") for a in range(40) for b in range(a + 1, 40)} | {("i01", "z")}


def test_reordering_many_words_takes_no_factorial_time():
    import time

    words = [f"w{i}" for i in range(10)]
    start = time.perf_counter()
    assert D.least_reordered(words, " ".join(words[1:] + words[:1])) == 0
    assert time.perf_counter() - start < 20
    assert D.least_reordered(["a"], "a") is None and D.least_reordered(["a", "a"], "a a") is None


def test_marked_tokens_take_no_part_in_a_thesaurus(spark):
    forms = ["zxzxpzdate", "zxzxpztime", "attack", "attach"]
    v = spark.createDataFrame([(f, [1.0, 0.1]) for f in forms], "form string, vec array<float>")
    s = config.Settings()
    assert {r["p1"] for r in H.build_thesaurus(v, s).collect()} == {"attack", "attach"}
    assert len(H.build_thesaurus(v, config.Settings(processor="none")).select("p1").distinct().collect()) == 4


def test_stages_as_commands(spark, tmp_path):
    from lexweave import commands

    (tmp_path / "in.txt").write_text("the red cat sat\nthe red cat ran\n\nthe red cat on 1/2/2016 ran\n" * 20)
    (tmp_path / "s.properties").write_text("minCount=5\nmaxNgramOrder=3\ntextProcessor=moderate\nembeddingsCaseSensitive=true\n")
    p = lambda x: f"{tmp_path}/{x}"
    for stage in (["preprocess", p("in.txt"), p("clean")], ["count", p("clean"), p("counts")], ["prune", p("counts"), p("pruned")], ["collocations", p("found"), p("pruned")], ["apply", p("found"), p("clean"), p("joined")]):
        commands.run(spark, [*stage, "--settings", p("s.properties")])
    found = {r["form"] for r in X.read_collocations(spark, p("found")).collect()}
    assert "red cat" in found and not any("zxzxpz" in f for f in found)
    assert any("red_cat" in r["line"] for r in X.read_corpus(spark, p("joined")).collect())
    with pytest.raises(SystemExit):
        commands.run(spark, ["no-such-stage"])


def test_experiments(spark):
    c = spark.createDataFrame([("C1", "L1", "Heart Attack"), ("C1", "L1", "attacks of the heart"), ("C1", "L2", "mi"), ("C2", "L1", "heart attack"), ("C1", "L1", "on 1/2/2016")], "concept string, lui string, form string")
    s = config.Settings(max_phrase_length=4)
    assert [tuple(r) for r in E.concept_experiment(c, None, s).collect()] == [("attacks of the heart", "heart attack")]
    short = spark.createDataFrame([("mi", "x")], "abbr string, long string")
    assert {tuple(r) for r in E.concept_experiment(c, short, s, by="concept").collect()} == {("attacks of the heart", "heart attack")}
    v = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [2.0, 2.0])], "form string, vec array<float>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "zz")], "a string, b string")
    got = {r["phrase2"]: r for r in E.scored_pairs(pairs, v, abbr=True).collect()}
    assert got["b"]["semantic"] == pytest.approx(0.5**0.5, abs=1e-6) and got["zz"]["semantic"] is None
    assert got["zz"]["abbreviation"] == 4.0 or got["zz"]["abbreviation"] > 0


@pytest.mark.parametrize("most_groups", [2, 100])
def test_similarities_within_groups_in_parts(spark, monkeypatch, most_groups):
    monkeypatch.setattr(E, "PAIR_BLOCK", 7)
    monkeypatch.setattr(E, "PART_PAIRS", 200)
    monkeypatch.setattr(E, "MOST_GROUPS", most_groups)
    rng = random.Random(5)
    rows = sorted({(f"g{rng.randrange(k)}", f"i{rng.randrange(60):02d}") for k in (2, 30, 40) for _ in range(80)})
    values = {f"i{i:02d}": [rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)] for i in range(0, 60, 3)}
    values |= {"i00": [0.0, 0.0, 0.0], "i03": [1.0, 2.0], "i06": [3.0, -1.0], "i09": [1.0, None, 2.0]}
    items = spark.createDataFrame([*rows, *rows[:20], ("g0", None), (None, "i01"), ("alone", "i01")], "g string, i string")
    vectors = spark.createDataFrame(list(values.items()), "form string, vec array<float>")
    parts = [[tuple(r) for r in p.collect()] for p in E.similarities_within(items, "g", "i", vectors)]
    want = {(r["phrase1"], r["phrase2"]): r["semantic"] for r in E.scored_pairs(E.pairs_within(items, "g", "i"), vectors, ortho=False).collect()}
    got = [r for p in parts for r in p]
    assert len(parts) > 3 and len(got) == len(want) > 600 and {r[:2] for r in got} == set(want)
    for a, b, x in got:
        assert x == (want[a, b] if want[a, b] is None else pytest.approx(want[a, b], abs=1e-9)), (a, b)
    none = items.where("g = 'no such'")
    assert [p.count() for p in E.similarities_within(none, "g", "i", vectors)] == [0]


def test_pair_similarities_leave_no_text_and_shuffle_no_pairs(spark, monkeypatch):
    import os

    from lexweave.plans import catalog, files
    from lexweave.scratch import shared_root

    dumps, write = [], X.write_experiment

    def spy(df, *args):
        write(df, *args)
        plan = df._jdf.queryExecution().executedPlan().toString()
        dumps.append((df.count(), plan[: plan.index("Scan")]))

    monkeypatch.setattr(files.IO, "write_experiment", spy)
    monkeypatch.setattr(E, "PART_PAIRS", 2_000, raising=False)
    monkeypatch.setattr(E, "PAIR_BLOCK", 20, raising=False)
    before = set(os.listdir(shared_root(spark))) if os.path.isdir(shared_root(spark)) else set()
    d = "/root/testdata/sf0.01"
    got = [tuple(r) for r in catalog.QUERIES["pair_similarities"](spark, d).select("phrase1", "phrase2").collect()]
    assert not [x for x in set(os.listdir(shared_root(spark))) - before if x.startswith("experiment")]
    assert len(dumps) > 2 and sum(n for n, _ in dumps) == len(got) and max(n for n, _ in dumps) < len(got) / 2
    assert all("Join" not in plan and "MapInArrow" in plan for _, plan in dumps)
    assert sorted(got) == sorted(tuple(r) for r in catalog.QUERIES["same_lui_pairs"](spark, d).collect())


def test_entry_leaves_out_what_cannot_be_imported(monkeypatch):
    import __spark_entry__ as entry

    real = entry.importlib.import_module
    monkeypatch.setattr(entry.importlib, "import_module", lambda n: (_ for _ in ()).throw(ImportError("gone")) if n.startswith("lexweave.llm") else real(n))
    with pytest.warns(UserWarning):
        assert "ngram_counts" in entry.queries() and not any(k.startswith("p1_") for k in entry.queries())
