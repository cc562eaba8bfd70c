"""Problem 3: text that looks ordinary but is made of other characters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cyrillic and Greek letters and the Latin letters that look the same (Unicode confusables).
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "ԝ": "w", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G", "Ӏ": "I",
    "α": "a", "ϲ": "c", "ε": "e", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
# Signs that look like an ordinary one.
SIGNS = {"‐": "-", "‑": "-", "−": "-", "﹣": "-", "․": ".", "‚": ",", "﹐": ",", "∕": "/", "⁄": "/", "ꞌ": "'", "٬": ",", "︰": ":", "∶": ":", "׃": ":", ";": ";", "ǃ": "!"}
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]")
_BLANK = re.compile("[   -     　\u0085]")
_WIDE = re.compile("[！-～￠-￦ﬀ-ﬆ\U0001d400-\U0001d7ff]")
_SIGN = re.compile("[" + "".join(map(re.escape, SIGNS)) + "]")
#: A combining accent after a letter of an alphabet that has the accented letter as one character.
_ACCENT = re.compile("[A-Za-zÀ-ɏͰ-ԯ][̀-ͯ]+")
_JOINER = re.compile("(?<=[ऀ-෿؀-ۿ])[‌‍](?=[ऀ-෿؀-ۿ])")
_LETTERS = re.compile(r"[^\W\d_]+")
_TO_LATIN = str.maketrans(LOOK_ALIKE)
_FROM_LATIN = {s: str.maketrans({v: k for k, v in LOOK_ALIKE.items() if unicodedata.name(k).startswith(s) and len(v) == 1}) for s in ("CYRILLIC", "GREEK")}

#: Characters that make a value worth a look in Python: anything but ASCII, accented Latin letters and Indic.
SUSPECT = "[^\\x20-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f\\u0900-\\u0dff]"


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "LATIN"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "GREEK"
    if 0x400 <= o < 0x530:
        return "CYRILLIC"
    return "OTHER"


def plain(text: str) -> str:
    """Certain repairs: invisible characters out, blanks, signs, full-width forms, ligatures and accents in ordinary form.

    Joiners between two letters of an Indic or Arabic word are spelling, not invisible filling, and stay.
    """
    if text.isascii() and text.isprintable():
        return text
    held = _JOINER.sub(lambda m: "" if m.group() == "‌" else "", text)
    held = _INVISIBLE.sub("", held).replace("", "‌").replace("", "‍")
    held = _BLANK.sub(" ", held)
    held = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), held)
    held = _SIGN.sub(lambda m: SIGNS[m.group()], held)
    return _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m.group()), held)


def word_forms(word: str) -> list[str]:
    """Readings of a word that mixes scripts, or that is wholly made of look-alike letters; [] where there is nothing to repair.

    The first reading is the one of the word's dominant script: the script of most of its letters that no other
    script has; the Latin one where that leaves a choice.
    """
    scripts = {_script(c) for c in word}
    foreign = scripts & {"GREEK", "CYRILLIC"}
    if not foreign:
        return []
    latin = word.translate(_TO_LATIN)
    whole = all(_script(c) in ("LATIN", "OTHER") for c in latin)
    forms = [latin] if whole else []
    if "LATIN" in scripts or len(foreign) == 2:
        for s in sorted(foreign):
            back = word.translate(_FROM_LATIN[s])
            if {_script(c) for c in back} == {s}:
                forms.append(back)
    return forms


def dissect(text: str) -> tuple[str, bool, list[tuple[str, str, str]]]:
    """(plain text, whether a certain repair was made, (kind, word, reading) rows of its doubtful words).

    Kinds: "mixed" (letters of two scripts, certainly a case) and "whole" (every letter is a look-alike; a case
    only among Latin words and if the corpus knows the Latin reading).
    """
    base = plain(text)
    words = _LETTERS.findall(base)
    own = {"LATIN": 0, "GREEK": 0, "CYRILLIC": 0, "OTHER": 0}
    doubtful: list[tuple[str, str, str]] = []
    for w in words:
        scripts = {_script(c) for c in w}
        forms = word_forms(w)
        if len(scripts - {"OTHER"}) > 1 and forms:
            doubtful += [("mixed", w, f) for f in forms]
        elif forms and len(scripts) == 1:
            doubtful += [("whole", w, f) for f in forms]
        elif len(scripts) == 1:
            own[next(iter(scripts))] += 1
    # A look-alike word beside a word that only its own script can write is simply a word of that script.
    if own["GREEK"] or own["CYRILLIC"]:
        doubtful = [d for d in doubtful if d[0] == "mixed"]
    return base, base != text, doubtful


def repair(base: str, doubtful: list[tuple[str, str, str]], known: set[str]) -> tuple[str, bool]:
    """Put readings in for the doubtful words of a plain text; (text, whether any word was replaced).

    A reading that the corpus knows goes first. A mixed word none of whose readings is known takes that of its
    dominant script, so that equal-looking values are equal even for names that occur once.
    """
    chosen: dict[str, str] = {}
    for kind, word, form in doubtful:
        good = form.casefold() in known
        if word not in chosen and (good or kind == "mixed"):
            chosen[word] = form
        elif good and chosen[word].casefold() not in known:
            chosen[word] = form
    if not chosen:
        return base, False
    return _LETTERS.sub(lambda m: chosen.get(m.group(), m.group()), base), True


_READING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("word", T.StringType()), T.StructField("form", T.StringType())])
_DISSECTED = T.StructType([T.StructField("base", T.StringType()), T.StructField("certain", T.BooleanType()), T.StructField("words", T.ArrayType(_READING))])
_REPAIRED = T.StructType([T.StructField("clean", T.StringType()), T.StructField("changed", T.BooleanType())])


@F.pandas_udf(_DISSECTED)
def _dissect(values: pd.Series) -> pd.DataFrame:
    rows = [dissect(v or "") for v in values]
    return pd.DataFrame({"base": [r[0] for r in rows], "certain": [r[1] for r in rows], "words": [[dict(zip(("kind", "word", "form"), d)) for d in r[2]] for r in rows]})


@F.pandas_udf(_REPAIRED)
def _repair(base: pd.Series, words: pd.Series, known: pd.Series) -> pd.DataFrame:
    rows = [repair(b, [(w["kind"], w["word"], w["form"]) for w in (ws if ws is not None else [])], set(k if k is not None else [])) for b, ws, k in zip(base, words, known)]
    return pd.DataFrame({"clean": [r[0] for r in rows], "changed": [r[1] for r in rows]})


def repair_fields(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """Long form of ``fields``: columns ``row_id, field_name, value, clean, is_case``, one row per row and field.

    Rows whose text has only ASCII, accented Latin and Indic characters (nearly all) never leave the JVM. The
    corpus vocabulary is counted over every word of every field, but only for the words that a doubtful word
    could be read as, which is a semi-join against a list as long as there are doubtful words.

    NULL stays NULL and is no case; empty text is no case; repeated rows give repeated rows.
    """
    stacked = df.select(F.col(row_id), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("x")).select(row_id, "x.*")
    suspect = F.coalesce(F.col("value").rlike(SUSPECT), F.lit(False))
    odd = stacked.where(suspect).withColumn("d", _dissect("value")).select(row_id, "field_name", "value", "d.*")
    words = odd.where(F.size("words") > 0).select(F.explode("words").alias("w")).select(F.lower("w.form").alias("form")).distinct()
    # The corpus's own words: those of values without suspect characters.
    corpus = stacked.where(~suspect & F.col("value").isNotNull()).select(F.explode(F.split(F.lower("value"), r"[^\p{L}]+")).alias("form"))
    known = corpus.join(words, "form", "left_semi").distinct()
    per_value = (
        odd.where(F.size("words") > 0).select("value", "words").distinct()
        .withColumn("w", F.explode("words")).withColumn("form", F.lower("w.form"))
        .join(known.withColumn("hit", F.lit(True)), "form", "left")
        .groupBy("value").agg(F.collect_set(F.when(F.col("hit"), F.col("form"))).alias("known"))
    )
    fixed = odd.join(per_value, "value", "left").withColumn("r", _repair("base", "words", "known"))
    fixed = fixed.select(row_id, "field_name", "value", F.col("r.clean").alias("clean"), (F.col("certain") | F.col("r.changed")).alias("is_case"))
    ordinary = stacked.where(~suspect).select(row_id, "field_name", "value", F.col("value").alias("clean"), F.lit(False).alias("is_case"))
    return ordinary.unionByName(fixed)
