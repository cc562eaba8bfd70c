"""Language model of problem 9: whole words first, then shorter and shorter character n-grams.

Plain Python, no Spark: the driver fits a model on a bounded sample of labelled sentences, ships it to the
workers, and every worker scores the sentences of its own messages.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

#: Longest character n-gram that stands in for an unseen word.
MAX_GRAM = 4
#: How much an unseen word's n-gram evidence counts against a known word's.
GRAM_WEIGHT = 0.35
SMOOTHING = 0.5

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_MARKS = re.compile("[̀-ͯ]")


def fold(text: str) -> str:
    """Lower case without accents: people leave accents out, so the model never relies on them."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))


def words(text: str) -> list[str]:
    """Folded words of letters; an apostrophe separates ("l'ordre" has the words l and ordre)."""
    return [p for w in _WORD.findall(fold(text)) for p in re.split(r"['’]", w)]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word, from two letters on with one blank on each side."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class WordFirstModel:
    """Log frequencies per language of words and of n-grams of length 1 to ``MAX_GRAM``."""

    def __init__(self, languages: list[str], word_counts: dict[str, list[float]]):
        """``word_counts``: folded word -> count per language, in the order of ``languages``."""
        self.languages = languages
        k = len(languages)
        totals = [sum(c[i] for c in word_counts.values()) + 1.0 for i in range(k)]
        self.word_score = {w: self._centred(c, totals) for w, c in word_counts.items()}
        self.gram_score: list[dict[str, tuple[float, ...]]] = [{}]
        for n in range(1, MAX_GRAM + 1):
            table: dict[str, list[float]] = {}
            for w, c in word_counts.items():
                for g in grams(w, n):
                    row = table.setdefault(g, [0.0] * k)
                    for i in range(k):
                        row[i] += c[i]
            gram_totals = [sum(r[i] for r in table.values()) + 1.0 for i in range(k)]
            self.gram_score.append({g: self._centred(r, gram_totals) for g, r in table.items()})
        self._cache: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def _centred(counts: list[float], totals: list[float]) -> tuple[float, ...]:
        """Smoothed log frequency per language, less its mean: only differences decide."""
        scale = sum(totals) / len(totals)
        logs = [math.log((c * scale / t + SMOOTHING)) for c, t in zip(counts, totals)]
        mean = sum(logs) / len(logs)
        return tuple(x - mean for x in logs)

    def score(self, word: str) -> tuple[float, ...]:
        """Evidence per language of one folded word."""
        known = self.word_score.get(word)
        if known is not None:
            return known
        found = self._cache.get(word)
        if found is None:
            found = self._backoff(word)
            if len(self._cache) < 500_000:
                self._cache[word] = found
        return found

    def _backoff(self, word: str) -> tuple[float, ...]:
        k = len(self.languages)
        for n in range(MAX_GRAM, 0, -1):
            rows = [r for g in grams(word, n) if (r := self.gram_score[n].get(g)) is not None]
            # Half of the n-grams must be known, or a shorter length decides.
            if rows and 2 * len(rows) >= len(word) + 3 - n:
                return tuple(GRAM_WEIGHT * sum(r[i] for r in rows) / len(rows) for i in range(k))
        return (0.0,) * k

    def sentence(self, tokens: list[str]) -> tuple[str, float, float]:
        """Best language, its confidence (softmax over the languages) and its lead over the second per word."""
        k = len(self.languages)
        total = [0.0] * k
        for w in tokens:
            s = self.score(w)
            for i in range(k):
                total[i] += s[i]
        order = sorted(range(k), key=lambda i: (-total[i], self.languages[i]))
        best, second = order[0], order[1] if k > 1 else order[0]
        top = total[best]
        z = sum(math.exp(x - top) for x in total)
        return self.languages[best], 1.0 / z, (top - total[second]) / max(1, len(tokens))


def count_words(rows: list[tuple[str, str]], languages: list[str]) -> dict[str, list[float]]:
    """Word counts per language of (language, text) rows."""
    at = {x: i for i, x in enumerate(languages)}
    counts: dict[str, list[float]] = {}
    for lang, text in rows:
        for w, n in Counter(words(text)).items():
            counts.setdefault(w, [0.0] * len(languages))[at[lang]] += n
    return counts
