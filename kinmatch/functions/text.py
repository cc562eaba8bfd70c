"""Text normalization as column expressions that stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations in business names and what they stand for.
NAME_ABBREVIATIONS = {
    "ltd": "limited", "pvt": "private", "corp": "corporation", "inc": "incorporated", "co": "company",
    "cos": "companies", "intl": "international", "mfg": "manufacturing", "svcs": "services", "svc": "service",
    "assoc": "associates", "bros": "brothers", "mgmt": "management", "grp": "group", "hldgs": "holdings",
    "ent": "enterprises",
}
# Abbreviations in addresses and what they stand for.
ADDRESS_ABBREVIATIONS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard",
    "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "hwy": "highway", "pkwy": "parkway",
    "cir": "circle", "trl": "trail", "ter": "terrace", "sq": "square", "ste": "suite", "apt": "apartment",
    "fl": "floor", "bldg": "building", "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "mt": "mount",
    "nr": "near", "opp": "opposite", "hno": "house", "h": "house", "no": "number", "dist": "district",
    "tq": "taluk", "tal": "taluk", "vill": "village", "po": "post", "ps": "police",
    "kh": "khasra", "sec": "sector", "ph": "phase", "gf": "ground", "flr": "floor",
    "r": "rue", "che": "chemin", "chem": "chemin", "imp": "impasse", "rte": "route",
    "fbg": "faubourg", "qu": "quai", "pte": "porte", "crs": "cours",
}
# Devanagari letters and signs in Latin letters.
DEVANAGARI_VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o", "ऋ": "ri"}
DEVANAGARI_SIGNS = {"ा": "a", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॉ": "o", "ृ": "ri", "ं": "n", "ँ": "n", "ः": "h", "्": "", "़": ""}
DEVANAGARI_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}

#: The Indic blocks, Devanagari to Malayalam, as a character class.
INDIC = "[\\u0900-\\u0dff]"
_KEPT_LOW, _KEPT_HIGH = 0x0900, 0x0DFF


def _kept(ch: str) -> bool:
    return ch.isascii() and (ch.islower() or ch.isdigit()) or _KEPT_LOW <= ord(ch) <= _KEPT_HIGH


@cache
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition matters to ``clean``: to one character, and to several.

    Spark SQL has no Unicode normalization. Since ``clean`` blanks all but a-z, 0-9 and Indic characters, it is
    enough to map the characters that decompose into one of those, with Latin combining marks taken off.
    """
    one, many = {}, {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(ch):
            continue
        to = "".join(c for c in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if to == ch or not any(_kept(c) or c in "&</>" for c in to):
            continue
        # What is neither kept nor special becomes a blank in any case.
        to = "".join(c if _kept(c) or c in "&</>" else " " for c in to)
        (one if len(to) == 1 else many)[ch] = to
    return one, many


def decompose(text: Column) -> Column:
    """Lower-case text with accents, full-width forms, ligatures and composed Indic signs taken apart."""
    one, many = _decompositions()
    single = F.translate(text, "".join(one), "".join(one.values()))
    table = F.map_from_arrays(F.array(*map(F.lit, many)), F.array(*map(F.lit, many.values())))
    spread = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    # CASE is lazy: only values with such a character are taken apart letter by letter.
    rare = "[" + "".join(many) + "]"
    return F.regexp_replace(F.when(single.rlike(rare), spread).otherwise(single), "[\\u0300-\\u036f]", "")


def clean(text: Column) -> Column:
    """Lower case without accents; ``<null>``, ``null`` and ``n/a`` dropped, & spelled out, other signs one blank.

    NULL gives the empty string. Letters of the Indic blocks stay, all other scripts become blanks.
    """
    value = decompose(F.lower(F.coalesce(text, F.lit(""))))
    value = F.regexp_replace(value, r"<null>|\bnull\b|\bn/a\b", " ")
    value = F.replace(value, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(value, "[^a-z0-9\\u0900-\\u0dff]+", " "))


def tokens(cleaned: Column) -> Column:
    """Words of a cleaned text; the empty text has none."""
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def literal_map(table: dict[str, str]) -> Column:
    """A constant map column."""
    return F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))


def replace_tokens(toks: Column, table: Column) -> Column:
    """Every token that is a key of the map column replaced by its value; a NULL map replaces nothing."""
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), t))


def is_indic(text: Column) -> Column:
    """Whether a text has a character of the Indic blocks; NULL gives NULL."""
    return text.rlike(INDIC)


def numbers(toks: Column) -> Column:
    """The tokens that consist of digits."""
    return F.filter(toks, lambda t: t.rlike("^[0-9]+$"))


def romanize_word(word: str) -> str:
    """A Devanagari word in Latin letters: a consonant has an inherent a unless a sign follows; a final a of longer words is silent."""
    out: list[str] = []
    open_consonant = False  # the last letter is a consonant that still has its inherent vowel
    for ch in word:
        if open_consonant and ch not in DEVANAGARI_SIGNS:
            out.append("a")
        open_consonant = ch in DEVANAGARI_CONSONANTS
        out.append(DEVANAGARI_CONSONANTS.get(ch) or DEVANAGARI_SIGNS.get(ch, DEVANAGARI_VOWELS.get(ch, ch)))
    if open_consonant:
        out.append("a")
    latin = "".join(out)
    return latin[:-1] if len(latin) > 3 and latin.endswith("a") else latin


def romanize(word: Column) -> Column:
    """``romanize_word`` of a column; meant for distinct tokens, which are few, not for rows."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(romanize_word, na_action="ignore")

    return run(word)
