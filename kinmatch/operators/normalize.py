"""Normalized name, address and country columns of record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import text


def raw_tokens(df: DataFrame) -> DataFrame:
    """``df`` (``name, addr``) with ``name_tok`` and ``addr_tok``: cleaned words before any replacement."""
    return df.withColumns({"name_tok": text.tokens(text.clean(F.col("name"))), "addr_tok": text.tokens(text.clean(F.col("addr")))})


def indic_words(df: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """``src_tok, dst_tok`` of the distinct Indic tokens of ``df``: learned spelling, else romanized Devanagari, else unchanged."""
    toks = df.select(F.explode(F.concat("name_tok", "addr_tok")).alias("src_tok")).where(F.col("src_tok").rlike(text.INDIC)).distinct()
    rule = F.when(F.col("src_tok").rlike("[\\u0900-\\u097f]"), text.romanize(F.col("src_tok"))).otherwise(F.col("src_tok"))
    if dictionary is None:
        return toks.withColumn("dst_tok", rule)
    known = dictionary.select("src_tok", F.col("dst_tok").alias("_learned"))
    return toks.join(known, "src_tok", "left").select("src_tok", F.coalesce("_learned", rule).alias("dst_tok"))


def _map_indic(df: DataFrame, words: DataFrame) -> DataFrame:
    """Indic tokens replaced by way of a join; only records that have such tokens take part."""
    has = F.exists(F.concat("name_tok", "addr_tok"), lambda t: t.rlike(text.INDIC))
    odd = df.where(has).withColumn("_row", F.struct(*df.columns))
    spread = odd.select("_row", F.posexplode(F.concat("name_tok", "addr_tok")).alias("_pos", "src_tok")).join(words, "src_tok", "left")
    back = spread.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("dst_tok", "src_tok").alias("t")))).alias("_all"))
    all_tok = F.transform("_all", lambda x: x["t"])
    n = F.size("_row.name_tok")
    back = back.select("_row", F.slice(all_tok, F.lit(1), n).alias("_n"), F.slice(all_tok, n + 1, F.size("_row.addr_tok")).alias("_a"))
    mapped = back.select("_row.*", "_n", "_a").select(*[F.col({"name_tok": "_n", "addr_tok": "_a"}.get(c, c)).alias(c) for c in df.columns])
    return df.where(~has).unionByName(mapped)


def add_normalized(df: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``df`` from ``raw_tokens`` with ``country_norm, name_deva, name_norm, addr_norm`` and abbreviations spelled out.

    ``words`` (``src_tok, dst_tok``) replaces Indic tokens first; without it they stay. NULL text gives empty lists.
    """
    if words is not None:
        df = _map_indic(df, words)
    out = df.withColumns(
        {
            "name_tok": text.replace_tokens(F.col("name_tok"), text.literal_map(text.NAME_ABBREVIATIONS)),
            "addr_tok": text.replace_tokens(F.col("addr_tok"), text.literal_map(text.ADDRESS_ABBREVIATIONS)),
            "country_norm": text.clean(F.col("country")),
            "name_deva": F.coalesce(text.is_indic(F.col("name")), F.lit(False)),
        }
    )
    return out.withColumns({"name_norm": F.array_join("name_tok", " "), "addr_norm": F.array_join("addr_tok", " ")})


def learn_dictionary(s1: DataFrame, pool: DataFrame, min_count: int = 3, min_share: float = 0.5, min_cond: float = 0.8) -> DataFrame:
    """``src_tok, dst_tok``: Latin spellings of Indic tokens, learned from labelled pairs (``pool.gid = s1.idx``).

    Names with equally many words are aligned word by word; the most frequent partner wins if it has
    ``min_share`` of at least ``min_count`` pairs. Address words come in other numbers, so an Indic word takes the
    Latin word of the greatest lift among those in at least ``min_cond`` of its pairs. Names go first where both
    know a word. Ties go to the alphabetically first spelling.
    """
    pairs = (
        pool.where("gid >= 0").select("gid", F.col("idx").alias("pair"), F.col("name_tok").alias("pn"), F.col("addr_tok").alias("pa"))
        .join(s1.select(F.col("idx").alias("gid"), F.col("name_tok").alias("sn"), F.col("addr_tok").alias("sa")), "gid")
    )
    indic = lambda c: F.col(c).rlike(text.INDIC)

    aligned = pairs.where(F.size("pn") == F.size("sn")).select(F.inline(F.arrays_zip(F.col("pn").alias("d"), F.col("sn").alias("l")))).toDF("d", "l").where(indic("d"))
    name_counts = aligned.groupBy("d", "l").agg(F.count(F.lit(1)).alias("n"))
    by_name = (
        name_counts.groupBy("d").agg(F.min_by("l", F.struct(-F.col("n"), F.col("l"))).alias("l"), F.max("n").alias("top"), F.sum("n").alias("total"))
        .where((F.col("total") >= min_count) & (F.col("top") >= min_share * F.col("total")))
        .select("d", "l")
    )

    ad = pairs.where(F.exists("pa", lambda t: t.rlike(text.INDIC))).select("pair", F.array_distinct("pa").alias("pa"), F.array_distinct("sa").alias("sa"))
    rows = ad.agg(F.count(F.lit(1)).alias("n_rows"))
    latin = ad.select(F.explode("sa").alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("nl"))
    cells = ad.select("sa", F.explode("pa").alias("d")).where(indic("d"))
    nd = cells.groupBy("d").agg(F.count(F.lit(1)).alias("nd")).where(F.col("nd") >= min_count)
    both = cells.select("d", F.explode("sa").alias("l")).groupBy("d", "l").agg(F.count(F.lit(1)).alias("n"))
    lift = (
        both.join(nd, "d").join(latin, "l").join(F.broadcast(rows))
        .withColumn("cond", F.col("n") / F.col("nd")).where(F.col("cond") >= min_cond)
        .withColumn("lift", F.col("cond") * F.col("n_rows") / F.col("nl"))
    )
    by_addr = lift.groupBy("d").agg(F.min_by("l", F.struct(-F.col("lift"), F.col("l"))).alias("l"))
    return by_name.unionByName(by_addr.join(by_name, "d", "left_anti")).toDF("src_tok", "dst_tok")
