"""Operators for training data against brute force, and on nulls, ties, repeats, empty tables and long texts."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import common, cooccur, frequency, knn, mixing, packing, pii, quality, topn
from lexweave.llm.common import first_deliveries, repeated_keys
from lexweave.llm.components import group_pairs
from lexweave.scratch import save

WORDS = "a b c d e f g h the the the x1 -- zxzxpztime".split()


def rows(df):
    return [tuple(r) for r in df.collect()]


# Top N


def test_top_n_heavy_and_light_agree_with_brute_force(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot"] * 6 + ["p", "q", None]), rnd.choice([1.0, 2.0, 3.0, None, float("nan")]), i, "x") for i in range(400)]
    df = spark.createDataFrame(data, "g string, s double, id long, heavy string")
    got = defaultdict(list)
    for r in topn.top_n_per_group(df, "g", "s", [F.col("id").asc()], 4, heavy_rows=50).collect():
        got[r["g"]].append((r["rank_no"], r["id"]))
        assert r["heavy"] == "x"
    for g in {"hot", "p", "q", None}:
        mine = sorted((x for x in data if x[0] == g), key=lambda x: (-(x[1] if x[1] is not None and x[1] == x[1] else -1e9), x[2]))
        assert sorted(got[g]) == [(i + 1, x[2]) for i, x in enumerate(mine[:4])]


def test_top_n_empty_and_whole_ties(spark):
    empty = spark.createDataFrame([], "g string, s double")
    assert topn.top_n_per_group(empty, "g", "s", [], 3).count() == 0
    same = spark.createDataFrame([("g", 1.0, i) for i in range(30)], "g string, s double, id long")
    a = {r["id"] for r in topn.top_n_per_group(same, "g", "s", [], 3, heavy_rows=5).collect()}
    b = {r["id"] for r in topn.top_n_per_group(same.orderBy(F.desc("id")), "g", "s", [], 3, heavy_rows=500).collect()}
    assert len(a) == 3 and a == b


def test_top_n_cuts_heavy_groups_in_every_task_whatever_n(spark, monkeypatch):
    data = [("hot", float(i % 700), i) for i in range(6_000)] + [(None, 1.0, i) for i in range(50)]
    df = spark.createDataFrame(data, "g string, s double, id long").repartition(5)
    written = []
    real = topn.save
    monkeypatch.setattr(topn, "save", lambda d, name: (lambda t: (written.append((name, t)), t)[1])(real(d, name)))
    got = {r["rank_no"]: r["id"] for r in topn.top_n_per_group(df, "g", "s", [F.col("id").asc()], 2_500, heavy_rows=100).where("g = 'hot'").collect()}
    want = sorted(range(6_000), key=lambda i: (-(i % 700), i))[:2_500]
    assert [got[k] for k in range(1, 2_501)] == want
    hot = next(t for name, t in written if name == "hot-rows").df.groupBy("__part").count().collect()
    assert len(hot) > 1 and all(r["count"] < 6_000 for r in hot)  # no task held the whole group


def test_thesaurus_candidates_forms_and_repeats(spark):
    data = [(1, "A_b", "c", 0.5), (2, "a  b", "C", 0.9), (3, "a b", "c", 0.9), (4, "a b", "A_B", 1.0), (5, None, "c", 1.0), (6, "a b", "d", None), (7, "a b", "e", float("nan"))]
    t = spark.createDataFrame(data, "entry_id long, p1 string, p2 string, overall double")
    assert rows(topn.thesaurus_candidates(t)) == [("a b", "c", 0.9, 2)]


# Groups


def test_groups_agree_with_union_find(spark):
    rnd = random.Random(2)
    pairs = [(f"n{rnd.randrange(120)}", f"n{rnd.randrange(120)}") for _ in range(70)] + [("n5", None), (None, None), ("n7", "n7")]
    pairs += [("hub", f"s{i}") for i in range(1500)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs + pairs[:5], "a string, b string")
    assert dict(rows(group_pairs(df))) == {x: find(x) for x in parent}
    assert group_pairs(spark.createDataFrame([], "a string, b string")).count() == 0


# Pairs of terms


def _records(n, seed):
    rnd = random.Random(seed)
    return [[rnd.choice(WORDS) for _ in range(rnd.randrange(0, 9))] for _ in range(n)]


def _brute_pairs(records):
    sets = [sorted({w.lower() for w in r if w and any(c.isalnum() for c in w) and "zxzxpz" not in w}) for r in records]
    sets = [s for s in sets if s]
    single, both = Counter(w for s in sets for w in s), Counter(p for s in sets for p in itertools.combinations(s, 2))
    n = len(sets)
    out = {}
    for (a, b), c in both.items():
        p = c / n
        out[a, b] = (c, 1.0 if c == n else math.log(p / (single[a] / n * single[b] / n)) / -math.log(p))
    return out


def _scores(counts, least=1):
    return {(r["term_a"], r["term_b"]): (r["n_records"], r["npmi"]) for r in counts.scores(least, None).collect()}


def _same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])


def test_pair_counts_change_by_change(spark, monkeypatch, tmp_path):
    first, more = _records(150, 3), _records(40, 4) + [["new", "NEWER", None]]
    counts = cooccur.PairCounts(spark, str(tmp_path / "a"), 5)
    counts.load(spark.createDataFrame([(r,) for r in first], "words array<string>"))
    _same(_scores(counts), _brute_pairs(first))
    changes = [(first[i], more[i]) for i in range(20)] + [(None, m) for m in more[20:]] + [(first[30], None)]
    counts.update(spark.createDataFrame(changes, "old array<string>, new array<string>"))
    now = more + first[20:30] + first[31:]
    _same(_scores(counts), _brute_pairs(now))
    monkeypatch.setattr(cooccur, "MOST_BROADCAST_TERMS", 1)
    joined = cooccur.PairCounts(spark, str(tmp_path / "b"), 3)
    joined.load(spark.createDataFrame([(r,) for r in first], "words array<string>"))
    _same(_scores(joined), _brute_pairs(first))


def _folders(path):
    return {p.relative_to(path).as_posix() for p in path.glob("pairs/*/bucket=*")}


def test_another_session_opens_pair_counts_and_rewrites_few_buckets(spark, tmp_path):
    first = _records(300, 8) + [[f"w{i}", f"w{i + 1}"] for i in range(400)]
    cooccur.PairCounts(spark, str(tmp_path), 256).load(spark.createDataFrame([(r,) for r in first], "words array<string>"))
    counts = cooccur.PairCounts.open(spark.newSession(), str(tmp_path))
    old, before = save(counts.scores(1, None), "scores").df, _folders(tmp_path)
    changes = [([f"w{i}", f"w{i + 1}"], [f"w{i}", f"w{i + 2}"]) for i in range(10, 20)]
    counts.update(spark.createDataFrame(changes, "old array<string>, new array<string>"))
    again = cooccur.PairCounts.open(spark, str(tmp_path))
    assert again.version == 2 and again.n_records == counts.n_records
    now = _folders(tmp_path)
    assert 0 < len(now - before) <= 20 < len(now & before)  # twenty pairs changed, no other bucket was written
    records = first[:]
    for a, b in changes:
        records[records.index(a)] = b
    want = _brute_pairs(records)
    _same(_scores(again), want)
    # The number of records is as before, so only pairs with a changed term were scored again.
    touched = {r["term"] for r in counts.changed.collect()}
    fresh = {(r["term_a"], r["term_b"]): r["npmi"] for r in counts.rescored(1, None).collect()}
    assert touched == {f"w{i}" for i in range(11, 22)} and fresh.keys() == {k for k in want if touched & set(k)}
    _same({(r["term_a"], r["term_b"]): (r["n_records"], r["npmi"]) for r in counts.refreshed(old, 1, None).collect()}, want)


def test_many_updates_are_written_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cooccur, "MOST_GENERATIONS", 2)
    counts, records = cooccur.PairCounts(spark, str(tmp_path), 64), []
    for i in range(4):
        records += (more := [[f"x{i}", f"y{i}"], ["x0", f"z{i}"]])
        counts.load(spark.createDataFrame([(r,) for r in more], "words array<string>"))
    assert len(counts.pairs.live) <= 2
    _same(_scores(counts), _brute_pairs(records))


def test_counts_beyond_32_bits():
    keys, n = cooccur.unpack(cooccur.pack(np.array([3, 9]), np.array([2**31 + 7, -(2**40)])))
    assert keys.tolist() == [3, 9] and n.tolist() == [2**31 + 7, -(2**40)]


def test_pair_blocks_and_long_records(spark, tmp_path):
    keys, n = np.array([1, 5, 1 << 40, (1 << 62) + 3]), np.array([1, -2, 7, 3])
    a, b = cooccur.unpack(cooccur.pack(keys, n))
    assert a.tolist() == keys.tolist() and b.tolist() == n.tolist()
    ids = np.arange(2_300)
    assert sum(len(k) for k in cooccur.record_pairs(np.zeros(2_300, np.int64), ids)) == 2_300 * 2_299 // 2
    empty = cooccur.PairCounts(spark, str(tmp_path), 2)
    empty.load(spark.createDataFrame([], "words array<string>"))
    assert _scores(empty) == {}


def test_first_deliveries(spark):
    df = spark.createDataFrame([(1, 1, 5, "x"), (1, 1, 7, "x"), (2, 1, 5, "y"), (None, 1, 5, "z"), (None, 1, 5, "z")], "k long, j long, at long, w string")
    got = first_deliveries(df, ["k", "j"], "at", repeated_keys(df, ["k", "j"]))
    assert sorted(map(str, rows(got.select("k", "at")))) == sorted(map(str, [(1, 5), (2, 5), (None, 5), (None, 5)]))


# Frequencies


def test_frequencies_agree_with_brute_force(spark):
    records = _records(300, 5)
    rnd = random.Random(6)
    notes = [rnd.choice([777, 777, 777, *range(20)]) for _ in records]
    cnt, held = Counter(), defaultdict(set)
    for r, note in zip(records, notes):
        low = [w.lower() if any(c.isalnum() for c in w) and "zxzxpz" not in w else None for w in r]
        for i in range(len(low)):
            for n in (1, 2, 3):
                g = low[i : i + n]
                if len(g) == n and None not in g:
                    cnt[n, " ".join(g)] += 1
                    held[n, " ".join(g)].add(note)
    df = spark.createDataFrame(list(zip(notes, records)), "note_id long, words array<string>")
    got = {(r["n"], r["form"]): (r["cnt"], r["n_notes"]) for r in frequency.ngram_frequencies(df, 3).collect()}
    assert got == {k: (c, len(held[k])) for k, c in cnt.items()}
    assert frequency.ngram_frequencies(df.limit(0), 2).count() == 0


def test_marks(spark):
    f = spark.createDataFrame([(1, "a", 4, 1), (1, "b", 9, 8), (2, "a b", 1, 1), (2, "b c", 9, 5)], "n int, form string, cnt long, n_notes long")
    s = spark.createDataFrame([(1, 5, 0.5, None), (2, 10, 0.4, 0.3)], "n int, min_count long, max_note_share double, npmi_threshold double")
    assert {r["form"]: r["mark"] for r in frequency.marked(f, s, 10).collect()} == {"a": "rare", "b": "common", "a b": None, "b c": "common"}


# Vectors


def test_nearest_vectors_with_copies_and_unusable_rows(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((40, 16))
    x = (centre[rng.integers(0, 40, 500)] + 0.3 * rng.standard_normal((500, 16))).astype(np.float32)
    x[100:140] = x[0]  # a group of copies
    x[200] = x[201]
    data = [(i, v.tolist(), "t") for i, v in enumerate(x)] + [(3, x[3].tolist(), "t")]
    bad = [(900, None, "t"), (901, [1.0] * 15, "t"), (902, [0.0] * 16, "t"), (903, [float("nan")] * 16, "t"), (904, [None] * 16, "t"), (None, x[1].tolist(), "t")]
    df = spark.createDataFrame(data + bad, "id long, vec array<float>, query_id string")
    got = defaultdict(list)
    for r in knn.similar_vectors(df, "id", "vec", 5, 16).collect():
        got[r["query_id"]].append((r["rank_no"], r["near_id"]))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    sim = np.round(u @ u.T, 6)
    hit = 0
    for i in range(500):
        order = sorted((j for j in range(500) if j != i), key=lambda j: (-sim[i, j], j))[:5]
        mine = [b for _, b in sorted(got[i])]
        assert len(mine) == 5
        hit += len(set(mine) & set(order))
    assert hit / 2500 > 0.99
    assert [b for _, b in sorted(got[120])] == [0, 100, 101, 102, 103]
    assert knn.similar_vectors(df.limit(0), "id", "vec", 5, 16).count() == 0


def _unit(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_adaptive_scan_loses_little_and_abandons_most():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3_000, 96))
    x[1500:] = x[:1500] + 0.4 * rng.standard_normal((1500, 96))
    x = (x / np.linalg.norm(x, axis=1)[:, None] @ knn.rotation(96)).astype(np.float32)
    met = np.zeros(4, np.int64)
    start = np.full(len(x), 0.8, np.float32)
    i, j, *_ = knn.scan(x, x, start, start, 5, same=True, met=met)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.8001)) if a > b}
    assert len(set(zip(i.tolist(), j.tolist())) & want) >= 0.995 * len(want)
    assert met[1] < 0.05 * met[0]


def test_limits_tighten_without_a_least_similarity():
    rng = np.random.default_rng(9)
    centre = _unit(30, 96, 10)
    x = centre[rng.integers(0, 30, 2_400)] + 0.08 * rng.standard_normal((2_400, 96))
    x = (x / np.linalg.norm(x, axis=1)[:, None] @ knn.rotation(96)).astype(np.float32)
    met = np.zeros(4, np.int64)
    start = np.full(len(x), -1, np.float32)
    i, j, _, limit = knn.scan(x, x, start, start, 5, same=True, met=met)
    assert met[3] < 0.3 * met[0]  # most candidates are abandoned before the last block
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    near = np.argpartition(-sim, 4, axis=1)[:, :5]
    got = set(zip(i.tolist(), j.tolist()))
    assert sum((max(a, b), min(a, b)) in got for a in range(len(x)) for b in near[a]) > 0.995 * near.size
    assert np.all(limit <= np.sort(sim, axis=1)[:, -5] + 1e-4)


def test_share_of_columns_matches_random_directions():
    u = _unit(20_000, 96, 11)
    for d in (24, 48, 72):
        assert abs((((u[:, :d] ** 2).sum(1)) > knn.largest_share(d, 96, 0.02)).mean() - 0.02) < 0.006


def test_a_large_list_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(knn, "MOST_HOME", 700)
    monkeypatch.setattr(knn, "MOST_SAMPLED", 16)  # two lists
    n, dim = 4_000, 24
    x = _unit(n, dim, 21).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, vec array<float>")
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    near = np.argpartition(-sim, 4, axis=1)[:, :5]
    got = {(r["query_id"], r["near_id"]) for r in knn.similar_vectors(df, "id", "vec", 5, dim).collect()}
    assert sum((i, int(j)) in got for i in range(n) for j in near[i]) > 0.995 * 5 * n
    asked = {(r["query_id"], r["near_id"]) for r in knn.similar_vectors(df, "id", "vec", 5, dim, queries=F.col("query_id") % 10 == 0).collect()}
    assert len(asked) == 5 * n // 10
    assert sum((i, int(j)) in asked for i in range(0, n, 10) for j in near[i]) > 0.99 * n // 2


def test_scan_keeps_pairs_of_either_limit(monkeypatch):
    monkeypatch.setattr(knn, "TILE", 64)
    x = _unit(700, 96, 22)
    q = (x @ knn.rotation(96)).astype(np.float32)
    home = np.arange(700) % 7 != 0  # the others visit
    start = np.full(700, -1, np.float32)
    i, j, *_ = knn.scan(q[~home], q[home], start[~home], start[home], 5)
    met = set(zip(np.flatnonzero(~home)[i].tolist(), np.flatnonzero(home)[j].tolist()))
    sim = x @ x.T
    for rows, cols in ((home, ~home), (~home, home)):
        part = sim[np.ix_(rows, cols)]
        near = np.argpartition(-part, 4, axis=1)[:, :5]
        want = {(int(np.flatnonzero(rows)[a]), int(np.flatnonzero(cols)[b])) for a in range(len(part)) for b in near[a]}
        want = {(b, a) for a, b in want} if rows is home else want
        assert len(met & want) > 0.995 * len(want)


def test_asked_rows_get_all_their_nearest_in_many_lists(spark, monkeypatch):
    n, dim, k = 12_000, 24, 5
    x = np.random.default_rng(23).standard_normal((n, dim)).astype(np.float32)
    x[700:708] = x[700]
    data = [(i, x[i].tolist()) for i in range(n)] + [(700, x[700].tolist()), (3, None), (4, [0.0] * dim), (n, [1.0]), (None, x[0].tolist())]
    data += [(i, x[i].tolist()) for i in range(0, n, 3)]  # loaded twice
    df = spark.createDataFrame(data, "id long, vec array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    asked = range(0, n, 50)
    want = {}
    for i in asked:
        sim = np.round(u @ u[i], 9)
        sim[i] = -2
        want[i] = np.lexsort((np.arange(n), -sim))[:k].tolist()
    for most in (knn.MOST_ASKED, 100):  # at once, and in several blocks
        monkeypatch.setattr(knn, "MOST_ASKED", most)
        got = defaultdict(list)
        plain = df.where("id is not null and vec is not null")
        for r in knn.nearest_of_asked(plain, k, dim, -1.0, F.col("query_id") % 50 == 0).orderBy("rank_no").collect():
            got[r["query_id"]].append(r["near_id"])
        assert got == want
    found = defaultdict(list)  # with all lists probed, the lists lose only what the tests do
    for r in knn.similar_vectors(df, "id", "vec", k, dim, probes=1_000, queries=F.col("query_id") % 50 == 0).collect():
        found[r["query_id"]].append(r["near_id"])
    assert found.keys() == want.keys() and sum(len(set(found[i]) & set(want[i])) for i in want) > 0.99 * k * len(want)
    assert sorted(found[700]) == want[700]
    few = knn.similar_vectors(df.where("id < 3"), "id", "vec", k, dim, queries=F.col("query_id") == 0).collect()
    assert sorted(r["near_id"] for r in few) == [1, 2]
    assert knn.similar_vectors(df.limit(0), "id", "vec", k, dim, queries=F.col("query_id") == 0).count() == 0


def test_lists_of_words_and_names_are_whole_or_refused(spark, monkeypatch):
    names = spark.createDataFrame([(f"Name{i}", "family") for i in range(7)], "name_text string, name_kind string")
    words = spark.createDataFrame([(f"word{i}",) for i in range(7)], "word string")
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label string")
    monkeypatch.setattr(common, "MOST_LISTED", 7)
    assert len(pii.known_names(names).family) == 7
    monkeypatch.setattr(common, "MOST_LISTED", 6)
    for ask in (lambda: pii.known_names(names), lambda: pii.find_personal(docs, names.limit(1), words), lambda: quality.quality(docs, labels, words)):
        with pytest.raises(ValueError, match="more than 6 rows"):
            ask()


# Packing and mixing


def test_packing_places_every_token_once(spark):
    rnd = random.Random(9)
    data = [(i, rnd.choice(["a"] * 6 + ["b", "c", None]), rnd.randrange(1, 400)) for i in range(600)] + [(1000, "a", 0), (1001, "a", None)]
    docs = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    packs = spark.createDataFrame([("s", 64), ("m", 300)], "pack_name string, capacity_tokens int")
    out = packing.pack(docs, packs).toPandas()
    for name, cap in (("s", 64), ("m", 300)):
        p = out[out.pack_name == name]
        assert p.n_tokens.sum() == sum(n or 0 for _, _, n in data)
        used = p.groupby(["shard_no", "container_no"]).n_tokens.sum()
        assert used.max() <= cap and used.mean() / cap > 0.97
        for i, _, n in data:
            mine = sorted(zip(p[p.doc_id == i].token_from, p[p.doc_id == i].n_tokens))
            ends = [0] + [a + b for a, b in mine]
            assert [a for a, _ in mine] == ends[:-1] and ends[-1] == (n or 0)
            assert len(mine) <= 1 or n > cap
        assert not p.duplicated(["shard_no", "container_no", "slot_no"]).any()
    assert packing.pack(docs.limit(0), packs).count() == 0


def _distance(item, size, window, source, share):
    per = np.zeros((window.max() + 1, len(share)))
    np.add.at(per, (window, source[item]), size)
    return 0.5 * np.abs(per / per.sum(1, keepdims=True) - share).sum(1), per.sum(1)


def test_windows_keep_the_mixture_from_first_to_last():
    rng = np.random.default_rng(10)
    sizes, source = np.exp(rng.normal(5.3, 1.0, 6_000)).astype(np.int64) + 5, rng.choice(4, 6_000, p=[0.5, 0.3, 0.15, 0.05])
    share = np.bincount(source, weights=sizes) / sizes.sum()
    for capacity in (2_048, 8_192):
        item, at, size, window, _ = packing.pack_windows(sizes, source, None, np.zeros(4), capacity)
        far, used = _distance(item, size, window, source, share)
        order, w, room, plain = rng.permutation(len(sizes)), 0, capacity, np.zeros(len(sizes), np.int64)
        for i in order:  # as they come
            z = min(sizes[i], capacity)
            w, room = (w + 1, capacity) if z > room else (w, room)
            plain[i], room = w, room - z
        random_far, _ = _distance(np.arange(len(sizes)), np.minimum(sizes, capacity), plain, source, share)
        fifth = len(far) // 5
        assert used.max() <= capacity and used.mean() > 0.99 * capacity
        for part in (far, far[:fifth], far[-fifth:]):
            assert part.mean() < 0.6 * random_far.mean()


def test_windows_follow_given_targets_while_sources_last():
    rng = np.random.default_rng(11)
    sizes, source = rng.integers(5, 60, 6_000), np.repeat([0, 1], 3_000)
    item, at, size, window, _ = packing.pack_windows(sizes, source, np.array([0.75, 0.25]), np.zeros(2), 1_024)
    per = np.zeros((window.max() + 1, 2))
    np.add.at(per, (window, source[item]), size)
    first = np.sort((per / per.sum(1, keepdims=True))[:, 0])[::-1][: int(0.6 * len(per))]
    assert abs(first.mean() - 0.75) < 0.03  # the others hold what is left of the second source


def test_sizes_of_one_session_do_not_mix(spark, tmp_path):
    packs = spark.createDataFrame([("p", 64)], "pack_name string, capacity_tokens int")
    want = {}
    for k, n in (("a", 30), ("b", 7)):
        docs = spark.createDataFrame([(i, "x y z " * (i + 1), "s") for i in range(n)], "doc_id long, text string, source string")
        docs.write.parquet(str(tmp_path / k / "documents.parquet"))
        packs.write.parquet(str(tmp_path / k / "pack_sizes.parquet"))
    for k in "abab":
        got = packing.p7_fill(spark, str(tmp_path / k)).first()["tokens"]
        assert got == want.setdefault(k, got)
    assert want["a"] > want["b"]


def test_poisson_with_a_cap_keeps_its_mean():
    for mean, cap in ((0.3, 1), (0.97, 1), (2.5, 4), (7.3, None), (900.0, None)):
        c = mixing.poisson_cut_off(mean, cap)
        assert sum(1 - x for x in c) == pytest.approx(mean, rel=1e-3)
        assert cap is None or len(c) <= cap + 1


def test_large_means_are_not_cut(spark):
    for mean, cap in ((499.0, None), (744.0, None), (3_000.0, None), (250_000.0, None), (700.0, 701), (2_999.0, 5_000), (4_000.0, 4_000)):
        c = mixing.poisson_cut_off(mean, cap)
        assert sum(1 - x for x in c) == pytest.approx(mean, rel=1e-3)
        assert c[-1] == 1 and (cap is None or len(c) <= cap + 1)
    docs = spark.createDataFrame([(i, "big", 1_000) for i in range(20)] + [(20, "few", 1), (21, "few", 1)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", "big", 0.5, None), ("m", "few", 0.5, None)], "mix_name string, source string, target_share double, max_repeats int")
    per = mixing.mix(docs, t).where("source = 'few'").groupBy("doc_id").count().collect()
    assert len(per) == 2 and all(abs(r["count"] - 5_005) < 500 for r in per)


def test_mixing_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else "small", 100) for i in range(5_000)] + [(9_001, None, 50), (9_002, "big", None)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("m", "big", 0.6, None), ("m", "small", 0.4, 3), ("m", "none", 0.5, 2), ("n", "small", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    m = mixing.mix(docs, t).toPandas()
    share = m[m.mix_name == "m"].groupby("source").n_tokens.sum() / m[m.mix_name == "m"].n_tokens.sum()
    assert share["big"] == pytest.approx(0.6, abs=0.03) and "none" not in share
    assert m[m.source == "small"].copy_no.max() <= 3
    assert (m[m.mix_name == "n"].groupby("doc_id").size() == 1).all() and len(m[m.mix_name == "n"]) == 500
    again = mixing.mix(docs.repartition(7), t).toPandas()
    key = lambda d: sorted(map(tuple, d[["mix_name", "doc_id", "copy_no", "shuffle_key"]].to_numpy().tolist()))
    assert key(m) == key(again)
    assert mixing.plan_mix({"a": 100, "b": 100}, {"a": 0.9, "b": 0.1}, {"a": 1, "b": None}, 400) == {"a": 1.0, "b": 3.0}
    assert mixing.mix(docs.limit(0), t).count() == 0 and mixing.mix(docs, t.limit(0)).count() == 0


# Quality


def test_quality_of_plain_cases(spark):
    texts = [
        (1, None), (2, " \n "),
        (3, "The patient was seen today and is well.\nNo further tests are planned at this time.\nWe will call her next week."),
        (4, "- milk\n- bread\n- eggs and ham\n- tea"),
        (5, "| a | b | c |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |"),
        (6, "%&/(=)(/&%$\n$%&/()=%&/(\n&%$/()=?%&\n"), (7, "x" * 200_000),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label string, rater string")
    common = spark.createDataFrame([("en", "the"), ("en", "and"), (None, None)], "lang string, word string")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels, common).collect()}
    assert [got[i]["kind"] for i in range(1, 8)] == [None, None, "prose", "list", "table", "junk", "junk"]
    assert got[3]["n_lines"] == 3 and got[3]["stop_share"] == 1.0 and got[1]["mean_word_len"] is None
    assert quality.quality(docs.limit(0), labels, common).count() == 0


def test_quality_learns_from_ratings():
    rnd = random.Random(11)
    prose = lambda: "\n".join("we saw the patient and talked about " + rnd.choice(["pain", "sleep", "food"]) for _ in range(6))
    bare = lambda: "\n".join(rnd.choice(["left knee", "right hip", "mild cough"]) + " " + rnd.choice(["pain", "rash"]) for _ in range(6))
    rated = [(prose(), "prose") for _ in range(60)] + [(bare(), "list") for _ in range(60)]
    model = quality.train(rated, {"the", "and", "we"}, rounds=120)
    held = [(prose(), "prose") for _ in range(20)] + [(bare(), "list") for _ in range(20)]
    assert sum(quality.judge(model, t)["kind"] == k for t, k in held) >= 38


def test_quality_model_is_the_same_at_any_number_of_ratings():
    listed = "\n".join(f"- item {i} of the list" for i in range(8))
    kinds = []
    for n in (0, 1, 3, 40):
        rated = [(f"They came and saw the house {i}. It was late, and we left.", "prose") for i in range(n)]
        model = quality.train(rated, {"the", "and", "we"})
        assert model.weights.shape[0] >= len(quality.LINE_FIGURES)
        kinds.append(quality.judge(model, listed)["kind"])
    assert kinds == ["list"] * 4


def test_autocorrelation():
    assert quality.autocorrelation(np.array([1.0, 5, 1, 5, 1, 5, 1, 5])) > 0.7
    assert quality.autocorrelation(np.array([1.0, 2])) == 0.0 and quality.autocorrelation(np.ones(9)) == 1.0


# Personal information


@pytest.fixture(scope="module")
def names(spark):
    given = ["Marenna", "Marolo", "Marisso", "Torenna", "Torolo", "Torisso", "Jesenna", "Jesolo"]
    family = ["Hasketti", "Haskwell", "Haskdorn", "Brametti", "Bramwell", "Bramdorn", "Yarretti", "Yarrwell", "Yarrmond", "Pelldorn"]
    return spark.createDataFrame([(x, "given") for x in given] + [(x, "family") for x in family] + [(None, None)], "name_text string, name_kind string")


def test_personal_items_are_found_and_replaced(spark, names):
    texts = {
        1: "Please call Marenna Yarrdorn at (212) 555-0134 today. MRN 12345678 was checked.",
        2: "Send it to marolo.hasketti@mail.example please. She lives at 12 Bramwell Street, Apt 4B with her son.",
        3: "The Haskwell score was 8. Order 482910 was cancelled. Doses of 120-340-1020 mg were given.",
        4: "Signed: HASKDORN, Torenna\nSeen by Dr. Brametti this morning.", 5: None, 6: "   ",
    }
    docs = spark.createDataFrame([*texts.items(), *[(100 + i, t) for i, t in enumerate([texts[1], texts[2], texts[3], texts[4]] * 10)]], "doc_id long, text string")
    common = spark.createDataFrame([(x, w) for x in ("en",) for w in "the a was at with her to it is and".split()], "lang string, word string")
    out = {r["doc_id"]: r for r in pii.find_personal(docs, names, common).collect()}
    got = {i: {(x["kind"], x["value_text"]) for x in out[i]["items"]} for i in texts}
    assert got[1] == {("name", "Marenna Yarrdorn"), ("phone", "(212) 555-0134"), ("id_number", "12345678")}
    assert got[2] == {("email", "marolo.hasketti@mail.example"), ("address", "12 Bramwell Street, Apt 4B")}
    assert got[3] == set() and out[3]["redacted"] == texts[3]
    assert got[4] == {("name", "HASKDORN, Torenna"), ("name", "Brametti")}
    assert out[1]["redacted"] == "Please call [NAME] at [PHONE] today. MRN [ID_NUMBER] was checked."
    assert out[5]["redacted"] is None and out[6]["redacted"] == "   " and got[5] == got[6] == set()
    for i, r in out.items():  # an exact round trip
        if r["redacted"] is not None:
            text, last, parts = docs.where(F.col("doc_id") == i).first()["text"], 0, []
            for x in r["items"]:
                assert text[x["start_at"] : x["end_at"]] == x["value_text"]
                parts += [text[last : x["start_at"]], f"[{x['kind'].upper()}]"]
                last = x["end_at"]
            assert "".join([*parts, text[last:]]) == r["redacted"]
    assert pii.find_personal(docs.limit(0), names, common).count() == 0
    assert pii.find_personal(docs.limit(0), names.limit(0), common).count() == 0


@pytest.fixture(scope="module")
def field():
    rnd = random.Random(3)
    given = "Marenna Marolo Marisso Torenna Torolo Torisso Jesenna Jesolo".split()
    family = "Hasketti Haskwell Haskdorn Brametti Bramwell Bramdorn Yarretti Yarrwell Yarrmond Pelldorn".split()

    def note():
        g, f, h = rnd.choice(given), *rnd.sample(family, 2)
        return rnd.choice(
            [
                f"Dr. {f} came in the morning. The plan of Dr. {f} is kept.", f"{g} {f} was seen. Later {g} {f} went home.",
                f"The {h} score was {rnd.randrange(20)}. The {h} sign was negative. Mrs. {f} was told.", f"{h} score {rnd.randrange(20)} today, {h} sign again negative.",
                f"It was {h} then. {h} score 8.", "It was late. The walk was long. Then it ended.",
            ]
        )

    common = set("the a was at with her to it is and".split())
    names = pii.Names({w.lower() for w in given}, {w.lower() for w in family})
    return pii.train([note() for _ in range(160)], names, common, steps=120), common


def _spans(field, text):
    f, common = field
    d = pii.Doc(text, f.names, {})
    return [(k, text[i:j], i) for k, i, j in pii.items(d, f.label([d], common)[0])], d.by_rules(common)


def test_skip_links_find_what_a_sentence_alone_does_not_tell(field):
    family = "Hasketti Haskwell Haskdorn Brametti Bramwell Bramdorn Yarretti Yarrwell Yarrmond Pelldorn".split()
    texts = [t for n in family for t in (f"Mrs. {n} was told. Later it was {n}", f"Dr. {n} came. The plan is {n.lower()}, later.")]
    linked = [_spans(field, t)[0] for t in texts]
    f, kept = field[0], field[0].skip
    try:
        f.skip = np.zeros_like(kept)
        alone = [_spans(field, t)[0] for t in texts]
    finally:
        f.skip = kept
    assert all(set(a) <= set(s) for a, s in zip(alone, linked))
    lost = [(t, x) for t, a, s in zip(texts, alone, linked) for x in set(s) - set(a)]
    assert len(lost) >= 10  # mentions that only the links make names
    for t, (kind, _, at) in lost:  # and that the rules leave open
        d = pii.Doc(t, f.names, {})
        assert kind == "name" and d.by_rules(field[1])[int(np.searchsorted(d.start, at))].all()


def test_skip_links_join_similar_words_and_initials(field):
    f, common = field
    d = pii.Doc("Marenna Pelldorn came. Pelldorm's son and M. Pelldorn left; then Peldorn. The Tree and the Tree.", f.names, {})
    at = {(d.words[a], d.words[b]) for a, b in f.skip_edges(d, common)}
    words = [w for w in d.words if w.startswith("Pel")]
    linked = {w for e in at for w in e}
    assert set(words) <= linked and ("Marenna", "M") in at
    many = pii.Doc("Pelldorn. " * 500, f.names, {})
    depth = {0: 0}
    for a, b in f.skip_edges(many, common):
        depth[b // 2] = depth[a // 2] + 1
    assert len(depth) == 500 and max(depth.values()) <= 9  # a telling place reaches all in few rounds


def test_an_item_needs_no_form(field):
    d = pii.Doc("Zabruck", field[0].names, {})
    assert pii.items(d, np.array([9])) == [("name", 0, 7)]
    e = pii.Doc("mail to a b at c, today", field[0].names, {})
    assert pii.items(e, np.array([0, 0, 1, 2, 2, 2, 2, 0])) == [("email", 8, 16)]


def test_no_cut_inside_an_item_however_long_the_sentence(field):
    text = "and so it went on " * 200 + "till Marenna Pelldorn came " + "and then it was over " * 100
    d = pii.Doc(text, field[0].names, {})
    at = d.spans["name"][0]
    assert all(not (a < at[1] and b > at[0]) or (a <= at[0] and at[1] <= b) for a, b in d.pieces())
    assert max(b - a for a, b in d.pieces()) < 200


def test_chain_messages_agree_with_enumeration():
    rng = np.random.default_rng(12)
    u, t = rng.standard_normal((1, 3, pii.N)), rng.standard_normal((pii.N, pii.N))
    marginal, z, *_ = pii.chain(u, np.array([3]), t)
    score = u[0, 0][:, None, None] + u[0, 1][None, :, None] + u[0, 2][None, None] + t[:, :, None] + t[None]
    assert z[0] == pytest.approx(np.log(np.exp(score).sum()))
    assert np.exp(marginal[0, 1]) == pytest.approx(np.exp(score - z[0]).sum((0, 2)))
    best = pii.viterbi(u, np.array([3]), t)[0]
    assert tuple(best) == np.unravel_index(score.argmax(), score.shape)
