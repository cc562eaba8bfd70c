"""Problem 6: records that bear spellings of one business's name."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kinmatch.core.session import cut
from kinmatch.llm import names
from kinmatch.llm.components import connected_components

_WORD = T.StructType([T.StructField("w", T.StringType()), T.StructField("c", T.StringType()), T.StructField("f", T.ArrayType(T.StringType()))])
_NAME = T.StructType(
    [
        T.StructField("own", T.ArrayType(T.StringType())),
        T.StructField("cut", T.ArrayType(T.BooleanType())),
        T.StructField("trade", T.StringType()),
        T.StructField("foreign", T.BooleanType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("short", T.BooleanType()),
        T.StructField("words", T.ArrayType(_WORD)),
        T.StructField("codes", T.ArrayType(T.StringType())),
        T.StructField("joined", T.ArrayType(T.StringType())),
    ]
)


#: What tells names apart, without the parts that only ``form_links`` needs.
_BRIEF = T.StructType([f for f in _NAME.fields if f.name in ("own", "cut", "trade", "foreign", "short", "codes")])

_PARTS = {
    "own": lambda n: n.own,
    "cut": lambda n: n.cut,
    "trade": lambda n: n.trade,
    "foreign": lambda n: n.foreign,
    "keys": names.block_keys,
    "short": names.shortened,
    "words": lambda n: [{"w": w, "c": names.coarse(w), "f": names.formal_names(w)} for w in n.own],
    "codes": names.whole_codes,
    "joined": lambda n: [names.coarse("".join(n.own)), names.coarse("".join(n.own[::-1]))],
}


def _parser(schema: T.StructType):
    """An Arrow UDF that takes names apart into the fields of ``schema``; all NULL where a value is no name."""
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    @F.arrow_udf(schema)
    def parse(values: pa.Array) -> pa.Array:
        rows = [names.parse(v) for v in values.to_pylist()]
        columns = [pa.array([_PARTS[c](n) if n else None for n in rows], t) for c, t in fields]
        return pa.StructArray.from_arrays(columns, [c for c, _ in fields])

    return parse


#: ``names.parse`` with everything that ``form_links`` needs.
parse_names = _parser(_NAME)
#: ``names.parse`` with the parts that are compared, and the codes.
parse_names_briefly = _parser(_BRIEF)


def forms(records: DataFrame, row_id: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(``row_id, form`` of every record with a name, one row per distinct form with its parts).

    A form is what is left of a name after legal form, family suffix, particles, signs and letter case: all later
    work is done once per form, however many records bear it.
    """
    parsed = records.select(row_id, parse_names(F.col(name)).alias("n")).where("n.own is not null")
    form = F.concat_ws("|", F.array_join(F.array_sort(F.zip_with("n.own", "n.cut", lambda w, c: F.concat(w, F.when(c, ".").otherwise("")))), " "), "n.trade", F.when(F.col("n.foreign"), "*"))
    # Records keep the form only; the parts are kept once a form.
    rows = cut(parsed.select(row_id, form.alias("form"), "n").distinct())
    parts = rows.groupBy("form").agg(F.min("n").alias("n")).select("form", "n.*")
    return rows.select(row_id, "form").distinct(), parts


def _object(own, cut_, trade, foreign) -> names.Name:
    return names.Name(tuple(own), tuple(bool(x) for x in cut_), trade or "", bool(foreign))


_PART = T.StructType([f for f in _NAME.fields if f.name not in ("keys", "short", "words", "codes", "joined")])


@F.pandas_udf(T.DoubleType())
def name_confidence(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """``names.same_name`` of two columns of name parts; NULL parts give 0."""
    out = []
    for x, y in zip(a.itertuples(index=False), b.itertuples(index=False)):
        ok = x.own is not None and y.own is not None
        out.append(names.same_name(_object(x.own, x.cut, x.trade, x.foreign), _object(y.own, y.cut, y.trade, y.foreign)) if ok else 0.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("sure", T.DoubleType()), T.StructField("loose", T.DoubleType())]))
def name_agreement(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """``names.same_name`` and ``names.likeness`` of two columns of name parts; NULL parts give 0."""
    sure, loose = [], []
    for x, y in zip(a.itertuples(index=False), b.itertuples(index=False)):
        ok = x.own is not None and y.own is not None
        p, q = (_object(x.own, x.cut, x.trade, x.foreign), _object(y.own, y.cut, y.trade, y.foreign)) if ok else (None, None)
        sure.append(names.same_name(p, q) if ok else 0.0)
        loose.append(names.likeness(p, q) if ok else 0.0)
    return pd.DataFrame({"sure": sure, "loose": loose}, dtype="float64")


def letter_sets(parts: DataFrame) -> DataFrame:
    """``parts`` with ``ls``, numbers by which ``letters_agree`` drops most pairs of names: letters (as bits) and length of
    the first, the second and all own words, their count, and what makes other letters possible (cut, short, formal names)."""
    bits = lambda w: F.aggregate(F.split(w, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(c) - 97))))
    first, second, whole = F.col("own")[0], F.coalesce(F.get("own", F.lit(1)), F.lit("")), F.array_join("own", "")
    loose = F.exists("cut", lambda x: x) | F.exists("own", lambda w: F.length(w) <= 3)
    numbers = {"m1": bits(first), "n1": F.length(first), "m2": bits(second), "n2": F.length(second), "m": bits(whole), "n": F.length(whole)}
    return parts.withColumn("ls", F.struct(*[c.alias(k) for k, c in numbers.items()], F.size("own").alias("words"), loose.alias("loose"), F.exists("words", lambda x: F.size(x["f"]) > 0).alias("formal"), F.col("foreign").alias("foreign")))


def letters_agree(a: Column, b: Column) -> Column:
    """False only for two names (``ls`` of ``letter_sets``) that ``names.same_name`` gives 0, at the cost of a few machine operations.

    Words of four letters and more that agree as typed have at most a quarter of their letters without a match: Jaro-Winkler
    from ``JW_LEAST`` on leaves no more, and neither does one error in eight letters of both or two in eighteen. So the
    sets of their letters differ by no more. Letters run together differ by two errors, four letters, at most.
    """
    if names.JW_LEAST < 0.92:
        raise ValueError("the bound of a quarter holds from 0.92 on")
    apart = lambda x, y: F.bit_count(a[x].bitwiseXOR(b[y]))
    near = lambda i, j: 4 * apart(f"m{i}", f"m{j}") <= a[f"n{i}"] + b[f"n{j}"]
    whole = 4 * apart("m", "m") <= F.greatest(a["n"] + b["n"], F.lit(16))
    two = (near(1, 1) & near(2, 2)) | (near(1, 2) & near(2, 1))
    typed = F.when(a["words"] != b["words"], apart("m", "m") <= 4).when(a["words"] == 2, two).otherwise(whole)
    return a["loose"] | b["loose"] | (a["formal"] & b["formal"]) | (a["foreign"] != b["foreign"]) | typed


def form_links(parts: DataFrame) -> DataFrame:
    """``a, b, score, short_a, short_b``: distinct forms that are spellings of one name, a < b.

    Forms meet in blocks of a line of trade and a phonetic code. Forms without a line of trade meet every trade
    through a block of the code alone, from their side only. Two JVM comparisons, of sets of letters and of the letters, drop
    pairs that no rule of ``names.same_name`` could accept before any goes to Python.
    """
    part = F.struct("own", "cut", "trade", "foreign")
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    words = F.transform("words", lambda x: F.struct(x["w"], x["c"], x["f"], letters(x["w"]).alias("sw"), letters(x["c"]).alias("sc")))
    base = letter_sets(parts).select(
        "form", part.alias("p"), "trade", "short", "keys", "ls", words.alias("words"),
        F.array_join("own", "").alias("s"), F.array_join(F.reverse("own"), "").alias("r"), F.col("joined")[0].alias("cs"), F.col("joined")[1].alias("cr"),
    )
    keyed = base.withColumn("k", F.explode("keys")).drop("keys")
    cols = ("form", "p", "short", "ls", "words", "s", "r", "cs", "cr")
    left = keyed.select(*[F.col(c).alias(f"{c}_a") for c in cols], "trade", "k")
    right = keyed.select(*[F.col(c).alias(f"{c}_b") for c in cols], "trade", "k")
    same_trade = left.join(right, ["trade", "k"]).where("form_a < form_b")
    bare = left.where("trade = ''").drop("trade").join(right.where("trade <> ''").drop("trade"), "k")

    # Jaro-Winkler from JW_LEAST on needs this sum of the shares of matched letters in both words. Sorted letters are no
    # further apart than the letters without a match.
    shares = 3 * (names.JW_LEAST - 0.4) / 0.6 - 1

    def alike(x: Column, y: Column) -> Column:
        both = F.length(x) + F.length(y)
        return F.levenshtein(x, y) <= both - 2 * shares * F.length(x) * F.length(y) / both + 1e-9

    def partner(x: Column, y: Column) -> Column:
        # A swap of neighbours is one error of ``names.edits``, but two here, and leaves the sorted letters as they are.
        d = F.levenshtein(x["w"], y["w"])
        typed = (d <= 2) | ((d <= 4) & (F.levenshtein(x["sw"], y["sw"]) <= 2)) | alike(x["sw"], y["sw"])
        sounds = (F.levenshtein(x["c"], y["c"]) <= 1) | alike(x["sc"], y["sc"]) | (x["sc"] == y["sc"])
        return typed | x["w"].startswith(y["w"]) | y["w"].startswith(x["w"]) | F.when(F.col("p_a.foreign") != F.col("p_b.foreign"), sounds).otherwise(False) | F.arrays_overlap(x["f"], y["f"])

    by_word = (F.size("words_a") == F.size("words_b")) & F.forall("words_a", lambda x: F.exists("words_b", lambda y: partner(x, y)))
    whole = F.least(*[F.levenshtein(F.col(x), F.col(y)) for x, y in (("s_a", "s_b"), ("s_a", "r_b"), ("r_a", "s_b"))]) <= 4
    whole_coarse = F.least(*[F.levenshtein(F.col(x), F.col(y)) for x, y in (("cs_a", "cs_b"), ("cs_a", "cr_b"), ("cr_a", "cs_b"))]) <= 2
    run_together = ((F.size("words_a") != F.size("words_b")) | (F.size("words_a") == 1)) & (whole | whole_coarse)
    plausible = letters_agree(F.col("ls_a"), F.col("ls_b")) & (F.coalesce(by_word, F.lit(False)) | F.coalesce(run_together, F.lit(False)))
    keep = ["form_a", "form_b", "p_a", "p_b", "short_a", "short_b"]
    pairs = same_trade.where(plausible).select(*keep).unionByName(bare.where(plausible).select(*keep)).dropDuplicates(["form_a", "form_b"])
    scored = pairs.withColumn("score", name_confidence("p_a", "p_b")).where("score > 0")
    return scored.select(F.col("form_a").alias("a"), F.col("form_b").alias("b"), "score", F.col("short_a"), F.col("short_b"))


def name_groups(parts: DataFrame) -> DataFrame:
    """``form, group``: forms of one business's name share a group; forms without a link are their own.

    Sure links (equal, familiar, mistyped, run together) are joined to components first. A shortened name may
    fit several full names, so it joins a component only if all full names it fits are in that one.
    """
    links = cut(form_links(parts))
    comp = connected_components(links.where(F.col("score") >= names.STRONG), "a", "b").toDF("form", "group")
    base = cut(parts.select("form", "short").join(comp, "form", "left").select("form", "short", F.coalesce("group", "form").alias("group")))
    weak = links.where(F.col("score") < names.STRONG)
    # From the shortened side to full names only.
    arrows = weak.where("short_a and not short_b").select(F.col("a").alias("from"), F.col("b").alias("to")).unionByName(weak.where("short_b and not short_a").select(F.col("b").alias("from"), F.col("a").alias("to")))
    g = base.select("form", "group")
    by_group = arrows.join(g.toDF("from", "g_from"), "from").join(g.toDF("to", "g_to"), "to").where("g_from <> g_to")
    only = by_group.groupBy("g_from").agg(F.min("g_to").alias("g_to"), F.max("g_to").alias("g_max")).where("g_to = g_max").select("g_from", "g_to")
    merged = connected_components(only, "g_from", "g_to").toDF("group", "merged")
    return base.join(merged.hint("merge"), "group", "left").select("form", F.coalesce("merged", "group").alias("group"))


def member_pairs(groups: DataFrame, row_id: str, group: str) -> DataFrame:
    """``id_a, id_b`` of all members of a group, id_a < id_b. The pairs are the required result; the join is on the group."""
    a = groups.select(F.col(row_id).alias("id_a"), group)
    b = groups.select(F.col(row_id).alias("id_b"), group)
    return a.join(b.hint("merge"), group).where("id_a < id_b").select("id_a", "id_b").distinct()


def same_name_pairs(records: DataFrame, row_id: str, name: str) -> DataFrame:
    """``id_a, id_b``: records whose names are spellings of one business's name, whatever the script.

    NULL, empty and placeholder names match nothing. A record that is delivered twice counts once.
    """
    rows, parts = forms(records.select(row_id, name).distinct(), row_id, name)
    return member_pairs(rows.join(name_groups(parts).hint("merge"), "form"), row_id, "group")
