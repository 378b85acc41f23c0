"""Per-document text quality statistics; prose told from lists, tables and junk.

Every non-blank line gets figures of its own (words, symbols, digits,
punctuation, common words, letter pairs) and figures of the layout around it:
whether it has the delimiters of its neighbours, whether its columns start
where theirs do (vertical alignment), its indentation and leading mark, how
often it is repeated.  The text gets the autocorrelation of its line lengths
and the periodicity of its indentation.  A softmax over these figures and a
few hundred words says for each line whether it is prose, an item of a list, a
row of a table or junk; a text of which over half the lines are no prose is of
the kind most of these have.

The softmax is trained on the rated sample: at most ``MOST_RATED`` documents,
the rating most raters gave, and at most ``MOST_LINES`` lines of them.  Its
weights start from ``PRIOR`` and are drawn back to it the more, the fewer
documents are rated, so one model serves any number of ratings, also none.
Everything else covers all texts.

Defined results: null and blank texts have zero counts, null ratios and a null
kind; a text of one line has no autocorrelation (0); null ids are kept; rated
documents that don't exist are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .share import share
from .common import table, whole_list

MOST_RATED, MOST_LINES = 6_000, 60_000
KINDS = ("prose", "list", "table", "junk")
N_WORDS = 400

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARK = re.compile(r"\s*(?:[-*•·‣–—+>o]\s+|\[[ xX]?\]\s*|\(?\d{1,3}[.)]\s+|\(?[a-z][.)]\s+)")
_PAIR = re.compile(r"(?:^|[\s,;|])[A-Za-z][\w.]*\s?=\s?\S+")
_COLUMN = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
_HEX = re.compile(r"\b[0-9a-f]{2}\b|\b[0-9a-f]{8}\b")
_FILL = re.compile(r"[_.\-*=#~]{4,}")
_ENDS = tuple(".!?:;…”\"')")
_DIGIT = re.compile(r"\d")
_VOWEL = re.compile(r"[aeiouáéíóúäöüAEIOU]")
_INNER = re.compile(r"(?<!\S)[^\s]*?\w[^\w\s'’.\-/,:]+\w")
_STRANGE = re.compile(r"[^\x00-\x7e\w]")
_DELIMITERS = "|\t;,"
LINE_FIGURES = (
    "bias words chars word_len letters digits upper symbols spaces common ends_stop ends_any mark pairs aligned columns "
    "delims delims_max hex fill repeated distinct_chars odd_pairs inner vowels autocorr indent_period near_mark near_aligned "
    "near_common near_stop near_words near_repeated doc_words doc_common doc_stop doc_commas mark_kinds one_word long_word controls"
).split()

#: Weights before any rating is seen: what makes a line an item of a list, a row of a table or junk.
PRIOR = {
    "list": {"bias": -3.0, "mark": 2.5, "near_mark": 3.0},
    "table": {"bias": -3.0, "aligned": 2.0, "near_aligned": 2.0},
    "junk": {"bias": -3.0, "symbols": 5.0, "repeated": 4.0, "fill": 5.0, "hex": 4.0, "long_word": 1.5, "one_word": 0.5},
}
#: Pull towards the prior: of any training, and what a single rated document leaves of it.
DECAY, PRIOR_DECAY = 2e-4, 0.4


def autocorrelation(x: np.ndarray, most_lag: int = 4) -> float:
    """Largest autocorrelation at lags 1 to ``most_lag``; 1 for a constant series, 0 for fewer than 4 values."""
    if len(x) < 4:
        return 0.0
    d = x - x.mean()
    v = float((d * d).mean())
    if v < 1e-9:
        return 1.0
    return max(float((d[k:] * d[:-k]).mean()) / v for k in range(1, min(most_lag, len(x) - 2) + 1))


def _around(x: np.ndarray, reach: int = 3) -> np.ndarray:
    """Mean of the neighbours within ``reach`` lines, the line itself left out."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    c = np.concatenate([[0.0], np.cumsum(x)])
    lo, hi = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
    return (c[hi] - c[lo] - x) / np.maximum(hi - lo - 1, 1)


class Reader:
    """Figures of texts.  ``common``: common words; ``pairs``: log share of letter pairs, 27 x 27."""

    def __init__(self, common: set[str], pairs: np.ndarray, vocabulary: dict[str, int]) -> None:
        self.common, self.pairs, self.vocabulary = common, pairs, vocabulary

    def lines(self, text: str):
        """(figures per non-blank line, vocabulary words per line, figures of the text)."""
        raw = [x for x in re.split(r"[\r\n]+", text) if x.strip()]
        n = len(raw)
        f = np.zeros((n, len(LINE_FIGURES)), np.float32)
        seen = Counter(x.strip() for x in raw)
        words_of, starts, shapes, delims, spelled = [], [], [], [], []
        n_words = n_chars = n_common = n_symbols = 0
        letters_in_words = 0
        for i, x in enumerate(raw):
            s = x.strip()
            words = _WORD.findall(s.lower())
            n_s = len(s)
            letters = sum(map(len, words))
            digits = len(_DIGIT.findall(s))
            tokens = s.split()
            blanks = n_s - sum(map(len, tokens))
            symbols = max(0, n_s - letters - digits - blanks)
            common = sum(w in self.common for w in words)
            mark = _MARK.match(x)
            # Without a tab and with single blanks only there is no column.
            columns = [m.end() for m in _COLUMN.finditer(x)] if blanks >= len(tokens) or "\t" in s else []
            count = [s.count(d) for d in _DELIMITERS]
            inner = len(_INNER.findall(s)) if symbols else 0
            row = f[i]
            row[0] = 1
            row[1] = min(len(tokens), 30) / 10
            row[2] = min(n_s, 200) / 100
            row[3] = min(letters / len(words), 20) / 8 if words else 0
            row[4], row[5] = letters / n_s, digits / n_s
            row[6] = sum(map(str.isupper, s)) / max(1, letters)
            row[7], row[8] = symbols / n_s, blanks / n_s
            row[9] = common / len(tokens)
            row[10] = s[-1] in ".!?"
            row[11] = s.endswith(_ENDS)
            row[12] = mark is not None
            row[13] = min(len(_PAIR.findall(s)), 4) / 2 if "=" in s else 0
            row[15] = min(len(columns), 4) / 2
            row[16] = min(sum(count[:3]), 8) / 4
            row[18] = len(_HEX.findall(s)) / len(tokens)
            row[19] = len(_FILL.findall(s)) / len(tokens) if symbols > 3 or "____" in s else 0
            row[20] = min(seen[s] - 1, 5) / 5
            row[21] = len(set(s)) / min(n_s, 40)
            row[23] = inner / len(tokens)
            row[24] = len(_VOWEL.findall(s)) / max(1, letters)
            row[38] = len(tokens) == 1
            row[39] = min(max(map(len, tokens)), 80) / 40
            row[40] = 0 if s.isascii() else len(_STRANGE.findall(s)) / n_s
            words_of.append(sorted({self.vocabulary[w] for w in words if w in self.vocabulary}))
            spelled.append(" ".join(words))
            starts.append((columns + [-1] * 4)[:4])
            shapes.append(mark.group().strip()[:1] if mark else "")
            delims.append(tuple(count))
            n_words += len(words)
            letters_in_words += letters
            n_chars += n_s - blanks
            n_common += common
            n_symbols += symbols
        f[:, 22] = self._oddness(spelled)
        # Vertical alignment: the same number of a delimiter, or columns at the same place, in a line within three before or after.
        aligned = np.zeros(n)
        if n > 1:
            col, count = np.array(starts), np.array(delims)
            count[:, 3] *= np.array([x.lstrip()[:1] in "\"'0123456789" for x in raw])
            pair = f[:, 13]
            for gap in range(1, min(4, n)):
                a, b = count[gap:], count[:-gap]
                same = np.where((a == b) & (a >= 2), a, 0).max(1)
                here = (col[gap:, :, None] == col[:-gap, None, :]) & (col[gap:, :, None] >= 0)
                same = np.maximum(same, here.any(2).sum(1))
                same = np.maximum(same, 2 * ((pair[gap:] >= 1) & (pair[gap:] == pair[:-gap])))
                same = np.minimum(same, 4) / 2
                aligned[gap:] = np.maximum(aligned[gap:], same)
                aligned[:-gap] = np.maximum(aligned[:-gap], same)
        f[:, 14] = aligned
        f[:, 17] = f[:, 16].max() if n else 0
        length = np.array([len(x) for x in raw], float)
        indent = np.array([len(x) - len(x.lstrip()) for x in raw], float)
        period = autocorrelation(indent) if indent.any() else 0.0
        auto = autocorrelation(length)
        f[:, 25], f[:, 26] = auto, period
        for k, src in ((27, 12), (28, 14), (29, 9), (30, 10), (31, 1), (32, 20)):
            f[:, k] = _around(f[:, src])
        if n:
            f[:, 33], f[:, 34], f[:, 35] = f[:, 1].mean(), f[:, 9].mean(), f[:, 10].mean()
            f[:, 36] = min(text.count(",") / n, 3) / 3
            kinds = Counter(s for s in shapes if s)
            f[:, 37] = (max(kinds.values()) / n) if kinds else 0
        figures = {
            "n_lines": n,
            "n_words": n_words,
            "mean_word_len": letters_in_words / n_words if n_words else None,
            "symbol_ratio": n_symbols / n_chars if n_chars else None,
            "stop_share": float(f[:, 10].mean()) if n else None,
            "common_share": n_common / n_words if n_words else None,
            "repeated_share": 1 - len(seen) / n if n else None,
            "aligned_share": float((aligned > 0).mean()) if n else None,
            "marked_share": float(f[:, 12].mean()) if n else None,
            "length_autocorr": auto if n else None,
            "indent_period": period if n else None,
        }
        return f, words_of, figures

    def _oddness(self, lines: list[str]) -> np.ndarray:
        """How unusual the letter pairs of each line are, on average; 0 for fewer than two letters."""
        size = np.array([len(x) for x in lines], np.int64)
        a = np.frombuffer("\n".join(lines).encode("ascii", "replace"), np.uint8).astype(np.int64) - 96
        a[(a < 1) | (a > 26)] = 0
        if len(a) < 2:
            return np.zeros(len(lines))
        sums = np.concatenate([[0.0], np.cumsum(self.pairs[a[:-1], a[1:]], dtype=np.float64)])
        start = np.minimum(np.cumsum(size + 1) - size - 1, len(sums) - 1)
        pairs = np.maximum(size - 1, 0)
        return -(sums[start + pairs] - sums[start]) / np.maximum(pairs, 1)


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Log shares of letter pairs of texts, less the mean."""
    m = np.ones((27, 27))
    for t in texts:
        a = np.frombuffer(" ".join(_WORD.findall(t.lower())).encode("ascii", "replace"), np.uint8).astype(np.int64) - 96
        a[(a < 1) | (a > 26)] = 0
        np.add.at(m, (a[:-1], a[1:]), 1)
    p = np.log(m / m.sum(1, keepdims=True))
    return (p + 3).astype(np.float32)


class LineModel:
    def __init__(self, reader: Reader, weights: np.ndarray) -> None:
        self.reader, self.weights = reader, weights

    def kinds(self, f: np.ndarray, words: list[list[int]]) -> np.ndarray:
        """Kind of each line, by number."""
        base = len(LINE_FIGURES)
        z = f @ self.weights[:base]
        for i, w in enumerate(words):
            if w:
                z[i] += self.weights[base:][w].sum(0)
        return z.argmax(1)


def prior_weights(words: int) -> np.ndarray:
    w = np.zeros((len(LINE_FIGURES) + words, len(KINDS)), np.float32)
    for kind, figures in PRIOR.items():
        for figure, x in figures.items():
            w[LINE_FIGURES.index(figure), KINDS.index(kind)] = x
    return w


def train(rated: list[tuple[str, str]], common: set[str], seed: int = 5, rounds: int = 250) -> LineModel:
    """A model from (text, kind) of rated documents."""
    rated = [(t, k) for t, k in rated if t and t.strip() and k in KINDS]
    pairs = letter_pairs([t for t, k in rated if k == "prose"])
    if not rated:
        return LineModel(Reader(common, pairs, {}), prior_weights(0))
    seen = Counter(w for t, _ in rated for w in set(_WORD.findall(t.lower())))
    vocabulary = {w: i for i, (w, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:N_WORDS])}
    reader = Reader(common, pairs, vocabulary)
    xs, ws, ys, per = [], [], [], []
    for t, k in rated:
        f, words, _ = reader.lines(t)
        xs.append(f)
        ws += words
        ys.append(np.full(len(f), KINDS.index(k)))
        per.append(np.full(len(f), 1.0 / np.sqrt(max(1, len(f)))))
    x, y, weight = np.concatenate(xs), np.concatenate(ys), np.concatenate(per)
    if len(x) > MOST_LINES:
        keep = np.sort(np.random.default_rng(seed).choice(len(x), MOST_LINES, replace=False))
        x, y, weight, ws = x[keep], y[keep], weight[keep], [ws[i] for i in keep]
    bag = np.zeros((len(x), len(vocabulary)), np.float32)
    for i, w in enumerate(ws):
        bag[i, w] = 1
    x = np.concatenate([x, bag], axis=1)
    share = np.bincount(y, weights=weight, minlength=len(KINDS))
    weight = (weight * (share.sum() / np.maximum(share, 1e-9) / len(KINDS))[y] ** 0.5).astype(np.float32)
    weight /= weight.sum()
    prior = prior_weights(len(vocabulary))
    w, decay = prior.copy(), DECAY + PRIOR_DECAY / len(rated)
    target = np.eye(len(KINDS), dtype=np.float32)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ ((p - target) * weight[:, None]) + decay * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.06 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return LineModel(reader, w)


def rated_sample(documents: DataFrame, labels: DataFrame) -> list[tuple[str, str]]:
    """(text, rating) of at most MOST_RATED rated documents; the rating most raters gave, ties in the order of the alphabet."""
    votes = labels.where("label is not null and doc_id is not null").groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("doc_id", "b.label")
    best = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_RATED)
    got = documents.join(F.broadcast(best), "doc_id").select("doc_id", "text", "label").collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: r["doc_id"])]


RESULT = (
    "doc_id long, n_lines int, n_words int, mean_word_len double, symbol_ratio double, stop_share double, common_share double, "
    "repeated_share double, aligned_share double, marked_share double, length_autocorr double, indent_period double, "
    "list_share double, table_share double, junk_share double, kind string"
)


def judge(model: LineModel, text: str | None) -> dict:
    if not text or not text.strip():
        return {"n_lines": 0, "n_words": 0, "kind": None}
    f, words, figures = model.reader.lines(text)
    count = np.bincount(model.kinds(f, words), minlength=len(KINDS))
    n = max(1, len(f))
    other = count[1:].sum()
    figures["kind"] = KINDS[1 + int(count[1:].argmax())] if 2 * other > n else "prose"
    return figures | {f"{k}_share": count[i] / n for i, k in enumerate(KINDS) if i}


def quality(documents: DataFrame, labels: DataFrame, common_words: DataFrame) -> DataFrame:
    """Figures and kind of every document."""
    spark = documents.sparkSession
    common = {r["word"].lower() for r in whole_list(common_words.where("word is not null").select("word").distinct(), "common_words")}
    shared = share(spark, train(rated_sample(documents, labels), common))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            rows = [judge(model, t) for t in b["text"]]
            out = pd.DataFrame(rows, index=b.index) if rows else pd.DataFrame(index=b.index)
            out["doc_id"] = b["doc_id"]
            yield out.reindex(columns=names)

    return documents.select("doc_id", "text").mapInPandas(run, RESULT)


def _quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "common_words"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p9_quality(spark, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


def p9_figures(spark, sf_dir: str) -> DataFrame:
    """The figures that plain SQL can count as well."""
    q = _quality(spark, sf_dir)
    return q.select("doc_id", "n_lines", *[F.round(c, 6).alias(c) for c in ("stop_share", "repeated_share")])


QUERIES = {"p9_found": p9_found, "p9_quality": p9_quality, "p9_figures": p9_figures}
SQL = {
    "p9_figures": r"""WITH l AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\r\n]+'), lambda x: regexp_matches(x, '\S')), lambda x: trim(x, ' ' || chr(9))) AS l FROM documents
)
SELECT doc_id, len(l)::INT AS n_lines, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?'))) / len(l) END, 6) AS stop_share,
  round(CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l) END, 6) AS repeated_share
FROM l""",
}
