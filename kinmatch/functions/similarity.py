"""String similarities: plain functions over two strings, and one Arrow UDF that returns several of them at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _positions(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    bit = 1
    for ch in s:
        out[ch] = out.get(ch, 0) | bit
        bit <<= 1
    return out


def _lcs(at: dict[str, int], m: int, b: str) -> int:
    """Length of the longest common subsequence; ``at`` has the bit positions of a string of length m."""
    full = (1 << m) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by the bit-parallel recurrence; Python integers hold any length."""
    if len(a) < len(b):
        a, b = b, a
    return _lcs(_positions(a), len(a), b) if b else 0


def ratio(a: str, b: str) -> float:
    """Insertions and deletions only: 100 * 2 * LCS / (|a| + |b|); two empty strings are equal."""
    total = len(a) + len(b)
    if not total or a == b:
        return 100.0
    return 200.0 * lcs_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    """``ratio`` of the words in sorted order."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """``ratio`` of the word sets: what both share counts as a common beginning of all three comparisons.

    No words on a side: 0. Shared words and nothing left over on one side: 100.
    """
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = x & y
    only_a, only_b = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_a or not only_b):
        return 100.0
    base = len(" ".join(sorted(shared)))
    gap = 1 if base else 0
    long_a, long_b = base + gap + len(only_a), base + gap + len(only_b)
    # Leftovers behind the shared beginning: the beginning matches whole.
    both = 200.0 * (base + gap + lcs_length(only_a, only_b)) / (long_a + long_b)
    if not base:
        return both
    return max(both, 200.0 * base / (base + long_a), 200.0 * base / (base + long_b))


def _prefix_scores(at: dict[str, int], m: int, b: str, most: int) -> float:
    """Best ratio of the string in ``at`` against beginnings of ``b`` of up to ``most`` letters: one pass for all of them."""
    full = (1 << m) - 1
    v, best = full, 0.0
    for w, ch in enumerate(b[:most], 1):
        u = v & at.get(ch, 0)
        if u:
            v = ((v + u) | (v - u)) & full
            best = max(best, (m - v.bit_count()) / (m + w))
    return 200.0 * best


def _slide(a: str, b: str) -> float:
    """Best ratio of ``a`` against any stretch of ``b`` of its length, or shorter at the ends; |a| <= |b|."""
    m, n = len(a), len(b)
    at = _positions(a)
    best = max(_prefix_scores(at, m, b, m), _prefix_scores(_positions(a[::-1]), m, b[::-1], m))
    # Moving the window by one letter changes its common subsequence by one at most, so windows that cannot
    # beat the best yet are jumped over.
    need = int(best * m // 100) + 1
    k = 0
    while k <= n - m and need <= m:
        got = _lcs(at, m, b[k : k + m])
        if got >= need:
            best, need = 100.0 * got / m, got + 1
        k += max(1, need - got)
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ``ratio`` of the shorter string against any stretch of the longer one of its length, cut off at both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = _slide(a, b)
    # Either of two equally long strings may be the one that slides.
    return max(best, _slide(b, a)) if len(a) == len(b) else best


def jaro(a: str, b: str) -> float:
    """Jaro similarity between 0 and 1; two empty strings are equal."""
    if a == b:
        return 1.0
    m, n = len(a), len(b)
    if not m or not n:
        return 0.0
    reach = max(max(m, n) // 2 - 1, 0)
    used = [False] * n
    left: list[str] = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    k = len(left)
    if not k:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, (b[j] for j in range(n) if used[j]))) // 2
    return (k / m + k / n + (k - swapped) / k) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus of 0.1 for each of up to four equal first letters, from 0.7 on."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


SCORERS = {
    "ratio": ratio,
    "token_sort": token_sort_ratio,
    "token_set": token_set_ratio,
    "partial": partial_ratio,
    "jaro_winkler": jaro_winkler,
}


def similarities(pairs: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct with one double per entry of ``pairs``: name -> (scorer, left column, right column).

    All scores of a row are made in one trip to Python. NULL counts as the empty string.
    """
    from kinmatch.functions import batch

    names = list(pairs)
    columns: list[Column] = []
    where: dict[str, int] = {}
    plan: list[tuple[str, int, int]] = []
    for scorer, a, b in pairs.values():
        spot = []
        for c in (a, b):
            if str(c) not in where:
                where[str(c)] = len(columns)
                columns.append(F.coalesce(c, F.lit("")))
            spot.append(where[str(c)])
        plan.append((scorer, spot[0], spot[1]))

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(data: pd.DataFrame) -> pd.DataFrame:
        values = [data[c].tolist() for c in data.columns]
        return pd.DataFrame({n: batch.SCORERS[s](values[i], values[j]) for n, (s, i, j) in zip(names, plan)})

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))
