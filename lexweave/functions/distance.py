"""Spelling distances.

The plain distance is the built-in ``levenshtein`` of lower-cased strings.  The
weighted distance, whose costs depend on where in a word a character stands, is
an Arrow UDF that advances the cells of a whole batch of pairs at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

BREAKS = " -/_&"


@dataclass(frozen=True)
class Penalties:
    """Costs of the weighted distance of a (shorter, the abbreviation) to b.

    ``word_initial_match`` has no effect and is accepted for compatibility.
    Costs of leaving out a character of b default from the general one down to
    the word's and the string's first.
    """

    match: float = 0
    initial_match: float = 0
    word_initial_match: float = 0
    substitute: float = 1
    delete_a: float = 1
    delete_b: float = 1
    delete_b_word_initial: float | None = None
    delete_b_initial: float | None = None
    case_sensitive: bool = False

    @property
    def b_costs(self) -> tuple[float, float, float]:
        word = self.delete_b if self.delete_b_word_initial is None else self.delete_b_word_initial
        return (word if self.delete_b_initial is None else self.delete_b_initial), word, self.delete_b


PLAIN = Penalties()
ABBREVIATION = Penalties(substitute=4, delete_a=2, delete_b=0, delete_b_word_initial=1, delete_b_initial=2)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings])
    m = np.full((len(strings), max(1, size.max(initial=0))), -1, np.int32)
    for i, s in enumerate(strings):
        if s:
            m[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return m, size


def weighted_distances(a: list[str], b: list[str], p: Penalties) -> np.ndarray:
    """Distances of pairs; rows of the table are characters of a, and all pairs of a batch advance together."""
    if not p.case_sensitive:
        a, b = [x.lower() for x in a], [x.lower() for x in b]
    out = np.zeros(len(a))
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    for s in range(0, len(order), 4_096):
        rows = order[s : s + 4_096]
        ca, na = _codes([a[i] for i in rows])
        cb, nb = _codes([b[i] for i in rows])
        first, word, other = p.b_costs
        is_break = np.isin(cb, [ord(c) for c in BREAKS])
        cost = np.full(cb.shape, float(other))
        cost[:, 1:][is_break[:, :-1] & ~is_break[:, 1:]] = word
        cost[:, 0] = first
        row = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(cost, axis=1)], axis=1)
        done = np.where(na == 0, row[np.arange(len(rows)), nb], 0.0)
        for i in range(ca.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = row[:, 0] + p.delete_a
            same = ca[:, i, None] == cb
            step = np.where(same, p.match, p.substitute).astype(float)
            if i == 0:
                step[:, 0] = np.where(same[:, 0], p.initial_match, p.substitute)
            best = np.minimum(row[:, :-1] + step, row[:, 1:] + p.delete_a)
            for j in range(cb.shape[1]):
                new[:, j + 1] = np.minimum(best[:, j], new[:, j] + cost[:, j])
            row = new
            at = na == i + 1
            done[at] = row[at, nb[at]]
        out[rows] = done
    return out


def weighted(a: Column, b: Column, penalties: Penalties) -> Column:
    """Weighted distance; null where a string is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        ok = x.notna() & y.notna()
        out = pd.Series(np.nan, index=x.index, dtype="float64")
        if ok.any():
            out[ok] = weighted_distances(x[ok].tolist(), y[ok].tolist(), penalties)
        return out.astype(object).where(ok, None).astype("Float64")

    return run(a, b)


def plain(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def abbreviation(short: Column, long: Column) -> Column:
    return weighted(short, long, ABBREVIATION)


def _advanced(row: list[int], piece: str, other: str) -> list[int]:
    """The last row of the edit table after the characters of ``piece`` follow those that gave ``row``."""
    for x in piece:
        new = [row[0] + 1]
        for j, y in enumerate(other, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def least_reordered(words: list[str], other: str) -> int | None:
    """Least plain distance of ``other`` to the words in any order but the given one; None if there is no other order.

    A table over sets of words: the rows of all orders of a set are joined by
    their minimum, as each further character treats them alike.  So n words take
    2**n * n steps instead of n!.  Orders that so far read like the given one are
    kept apart, as that one doesn't count.
    """
    n = len(words)
    start = list(range(len(other) + 1))
    same: dict[int, list[int]] = {0: start}
    turned: dict[int, list[int]] = {}
    for size in range(n):
        next_same: dict[int, list[int]] = {}
        next_turned: dict[int, list[int]] = {}
        for held, out_same in ((same, True), (turned, False)):
            for used, row in held.items():
                tried = set()
                for k, w in enumerate(words):
                    if used >> k & 1 or w in tried:
                        continue
                    tried.add(w)  # equal words give equal orders
                    new = _advanced(row, (" " if size else "") + w, other)
                    into = next_same if out_same and w == words[size] else next_turned
                    key = used | 1 << k
                    into[key] = new if key not in into else [min(p) for p in zip(into[key], new)]
        same, turned = next_same, next_turned
    row = turned.get((1 << n) - 1)
    return None if row is None else row[-1]


@F.pandas_udf(IntegerType())
def best_reordered(a: pd.Series, b: pd.Series) -> pd.Series:
    """Least plain distance when the words of the side with fewer of them (b on a tie) stand in another order; null if there is none."""

    def one(x, y):
        if x is None or y is None:
            return None
        wx, wy = x.lower().split(" "), y.lower().split(" ")
        return least_reordered(wx, y.lower()) if len(wx) < len(wy) else least_reordered(wy, x.lower())

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int32")


def reordered(a: Column, b: Column, penalty: float | None) -> Column:
    """Plain distance, or that after reordering words plus the penalty, if smaller.

    Orders are tried only where they can win: two words or more on the smaller
    side, and the difference in length plus the penalty below the plain
    distance.
    """
    d = plain(a, b).cast("double")
    if penalty is None:
        return d
    smaller = F.least(F.size(F.split(a, " ")), F.size(F.split(b, " ")))
    can_win = (smaller >= 2) & (F.lit(float(penalty)) + F.abs(F.length(a) - F.length(b)) < d)
    turned = best_reordered(F.when(can_win, a), F.when(can_win, b)) + F.lit(float(penalty))
    return F.least(d, turned)
