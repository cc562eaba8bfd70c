"""String similarities of many pairs at once: the scores of ``similarity``, with NumPy words in place of Python integers."""

from __future__ import annotations

import numpy as np

from kinmatch.functions import similarity

#: Strings above this length are scored one pair at a time, so that tables of letters stay small.
LONGEST = 512
#: Pairs, or windows of pairs, that are worked on together.
CHUNK = 1_024
#: Windows of a sliding comparison that are looked at before those between them.
STRIDE = 4
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_ONE = np.uint64(1)


class _Letters:
    """Two lists of strings as matrices of letter numbers from 1 on; 0 fills up."""

    def __init__(self, xs: list[str], ys: list[str]):
        (flat_x, self.m), (flat_y, self.n) = self._flat(xs), self._flat(ys)
        known, at = np.unique(np.concatenate([flat_x, flat_y]), return_inverse=True)
        self.size = len(known) + 1
        self.x = self._matrix(at[: len(flat_x)] + 1, self.m)
        self.y = self._matrix(at[len(flat_x) :] + 1, self.n)

    @staticmethod
    def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.array([len(t) for t in texts], dtype=np.int64)

    @staticmethod
    def _matrix(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), 1)), dtype=np.int64)
        out[np.arange(out.shape[1]) < lengths[:, None]] = letters
        return out

    def masks(self, rows: np.ndarray) -> np.ndarray:
        """[pair, letter, word]: bits of the places of every letter in ``rows``; no letter 0."""
        width = -(-rows.shape[1] // 64)
        out = np.zeros((len(rows), self.size, width), dtype=np.uint64)
        pair = np.arange(len(rows))
        for i in range(rows.shape[1]):
            out[pair, rows[:, i], i // 64] |= _ONE << np.uint64(i % 64)
        out[:, 0] = 0
        return out


def _step(v: np.ndarray, m: np.ndarray) -> None:
    """One letter of the bit-parallel recurrence of the longest common subsequence, in place; the carry runs through the words."""
    carry = np.zeros(len(v), dtype=np.uint64)
    for w in range(v.shape[1]):
        old = v[:, w]
        u = old & m[:, w]
        part = old + u
        whole = part + carry
        carry = ((part < old) | (whole < part)).astype(np.uint64)
        v[:, w] = whole | (old & ~u)


def _zeros(v: np.ndarray) -> np.ndarray:
    return (64 - np.bitwise_count(v).astype(np.int64)).sum(axis=1)


def _lcs_rows(table: np.ndarray, of: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Common subsequence of the string behind ``table[of]`` and each row of letters in ``text``."""
    v = np.full((len(text), table.shape[2]), _ALL)
    for j in range(text.shape[1]):
        _step(v, table[of, text[:, j]])
    return _zeros(v)


def _by_chunks(xs: list[str], ys: list[str], many, one) -> np.ndarray:
    """``many`` over pairs of like length together; ``one`` for pairs with a very long string."""
    out = np.zeros(len(xs))
    longest = np.array([max(len(x), len(y)) for x, y in zip(xs, ys)], dtype=np.int64)
    short = np.flatnonzero(longest <= LONGEST)
    for i in np.flatnonzero(longest > LONGEST):
        out[i] = one(xs[i], ys[i])
    short = short[np.argsort(longest[short], kind="stable")]
    for k in range(0, len(short), CHUNK):
        at = short[k : k + CHUNK]
        out[at] = many([xs[i] for i in at], [ys[i] for i in at])
    return out


def lcs_lengths(xs: list[str], ys: list[str]) -> np.ndarray:
    """``similarity.lcs_length`` of every pair."""

    def many(a: list[str], b: list[str]) -> np.ndarray:
        swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
        letters = _Letters([x for x, _ in swap], [y for _, y in swap])
        return _lcs_rows(letters.masks(letters.x), np.arange(len(swap)), letters.y)

    return _by_chunks(xs, ys, many, similarity.lcs_length)


def ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """``similarity.ratio`` of every pair."""
    total = np.array([len(x) + len(y) for x, y in zip(xs, ys)], dtype=float)
    return np.where(total == 0, 100.0, 200.0 * lcs_lengths(xs, ys) / np.maximum(total, 1))


def token_sort_ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """``similarity.token_sort_ratio`` of every pair."""
    put = {t: " ".join(sorted(t.split())) for t in {*xs, *ys}}
    return ratios([put[x] for x in xs], [put[y] for y in ys])


def token_set_ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """``similarity.token_set_ratio`` of every pair."""
    words = {t: set(t.split()) for t in {*xs, *ys}}
    rows = []
    for x, y in zip(xs, ys):
        a, b = words[x], words[y]
        rows.append((len(a) > 0 and len(b) > 0, " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))))
    some = np.array([r[0] for r in rows], dtype=bool)
    base, only_a, only_b = (np.array([len(r[k]) for r in rows], dtype=float) for k in (1, 2, 3))
    gap = (base > 0).astype(float)
    long_a, long_b = base + gap + only_a, base + gap + only_b
    common = lcs_lengths([r[2] for r in rows], [r[3] for r in rows])
    both = 200.0 * (base + gap + common) / np.maximum(long_a + long_b, 1)
    alone = np.maximum(200.0 * base / np.maximum(base + long_a, 1), 200.0 * base / np.maximum(base + long_b, 1))
    out = np.where(base > 0, np.maximum(both, alone), both)
    out = np.where((base > 0) & ((only_a == 0) | (only_b == 0)), 100.0, out)
    return np.where(some, out, 0.0)


def _ends(table: np.ndarray, m: np.ndarray, text: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best ratio of strings of ``m`` letters against beginnings of ``text`` of up to ``m`` letters."""
    v = np.full((len(text), table.shape[2]), _ALL)
    pair, best = np.arange(len(text)), np.zeros(len(text))
    for j in range(min(text.shape[1], int(m.max(initial=0)))):
        _step(v, table[pair, text[:, j]])
        best = np.maximum(best, np.where((j < m) & (j < n), _zeros(v) / (m + j + 1), 0.0))
    return 200.0 * best


def _sliding(letters: _Letters) -> np.ndarray:
    """Best ratio of each x against the stretches of y of its length and the shorter ones at both ends; x is the shorter."""
    m, n = letters.m, letters.n
    table = letters.masks(letters.x)

    def turned(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = length[:, None] - 1 - np.arange(rows.shape[1])
        return np.where(at >= 0, np.take_along_axis(rows, np.maximum(at, 0), axis=1), 0)

    best = _ends(table, m, letters.y, n)
    best = np.maximum(best, _ends(letters.masks(turned(letters.x, m)), m, turned(letters.y, n), n))
    count = n - m + 1
    of = np.repeat(np.arange(len(m)), count)
    start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    width = np.arange(int(m.max(initial=0)))
    got = np.zeros(len(of), dtype=np.int64)

    def look(at: np.ndarray) -> None:
        for k in range(0, len(at), 4 * CHUNK):
            w = at[k : k + 4 * CHUNK]
            p = of[w]
            text = np.where(width < m[p][:, None], letters.y[p[:, None], np.minimum(start[w][:, None] + width, letters.y.shape[1] - 1)], 0)
            got[w] = _lcs_rows(table, p, text)
            np.maximum.at(best, p, 100.0 * got[w] / m[p])

    # A window one letter on has a common subsequence longer by one at most, so most windows between two of STRIDE
    # apart cannot beat the best of those.
    flat = np.arange(len(of))
    beyond = start % STRIDE
    following = np.minimum(start - beyond + STRIDE, count[of] - 1)
    anchor = (beyond == 0) | (start == count[of] - 1)
    look(flat[anchor])
    bound = np.minimum(got[flat - beyond] + beyond, got[flat + following - start] + following - start)
    look(flat[~anchor & (100.0 * bound / m[of] > best[of])])
    return best


def partial_ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    """``similarity.partial_ratio`` of every pair."""

    def many(a: list[str], b: list[str]) -> np.ndarray:
        pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
        out = np.array([100.0 if (x in y if x else not y) else 0.0 for x, y in pairs])
        todo = [i for i, (x, _) in enumerate(pairs) if x and not out[i]]
        if todo:
            out[todo] = _sliding(_Letters([pairs[i][0] for i in todo], [pairs[i][1] for i in todo]))
            # Either of two equally long strings may be the one that slides.
            even = [i for i in todo if len(pairs[i][0]) == len(pairs[i][1])]
            if even:
                out[even] = np.maximum(out[even], _sliding(_Letters([pairs[i][1] for i in even], [pairs[i][0] for i in even])))
        return out

    return _by_chunks(xs, ys, many, similarity.partial_ratio)


def _jaro_many(a: list[str], b: list[str]) -> np.ndarray:
    letters = _Letters(a, b)
    m, n, pair = letters.m, letters.n, np.arange(len(a))
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    table = letters.masks(letters.y)[:, :, 0]
    used = np.zeros(len(a), dtype=np.uint64)
    left = np.zeros(letters.x.shape, dtype=bool)
    below = lambda k: np.where(k >= 64, _ALL, (_ONE << np.minimum(np.maximum(k, 0), 63).astype(np.uint64)) - _ONE)
    for i in range(letters.x.shape[1]):
        free = table[pair, letters.x[:, i]] & ~used & below(i + reach + 1) & ~below(i - reach)
        first = free & (~free + _ONE)
        used |= first
        left[:, i] = first != 0
    right = (used[:, None] >> np.arange(letters.y.shape[1], dtype=np.uint64) & _ONE).astype(bool)
    k = left.sum(axis=1)

    def taken(rows: np.ndarray, flags: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), max(int(k.max(initial=0)), 1)), dtype=np.int64)
        p, j = np.nonzero(flags)
        out[p, np.cumsum(flags, axis=1)[p, j] - 1] = rows[p, j]
        return out

    swapped = (taken(letters.x, left) != taken(letters.y, right)).sum(axis=1) // 2
    some = np.maximum(k, 1)
    out = np.where(k > 0, (k / np.maximum(m, 1) + k / np.maximum(n, 1) + (k - swapped) / some) / 3, 0.0)
    same = np.array([x == y for x, y in zip(a, b)])
    out = np.where(same, 1.0, out)
    width = min(4, letters.x.shape[1], letters.y.shape[1])
    equal = (letters.x[:, :width] == letters.y[:, :width]) & (letters.x[:, :width] > 0)
    prefix = np.cumprod(equal, axis=1).sum(axis=1)
    return np.where(out > 0.7, out + prefix * 0.1 * (1 - out), out)


def jaro_winklers(xs: list[str], ys: list[str]) -> np.ndarray:
    """``similarity.jaro_winkler`` of every pair; the places of a string fit one word up to 64 letters."""
    out = np.zeros(len(xs))
    wide = np.array([max(len(x), len(y)) > 64 for x, y in zip(xs, ys)], dtype=bool)
    for i in np.flatnonzero(wide):
        out[i] = similarity.jaro_winkler(xs[i], ys[i])
    at = np.flatnonzero(~wide)
    if len(at):
        out[at] = _by_chunks([xs[i] for i in at], [ys[i] for i in at], _jaro_many, similarity.jaro_winkler)
    return out


SCORERS = {"ratio": ratios, "token_sort": token_sort_ratios, "token_set": token_set_ratios, "partial": partial_ratios, "jaro_winkler": jaro_winklers}
