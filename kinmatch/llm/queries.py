"""Queries of this subpackage, by name: callables of (spark, data directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.core.session import table
from kinmatch.llm import gazetteer, langid, leaks, linkage, packing, same_names, topn, visual

#: Folder of the public tokenizers' files, by the library's own account of it.
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best pool records of every Source 1 record."""
    return topn.top_n_per_group(table(spark, sf_dir, "candidates"), "s1_idx", "pool_idx", "bscore", 10).select("s1_idx", "pool_idx")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, f"train_source{k}").select("entity_id", "business_name", "business_address") for k in (1, 2, 3)]
    return visual.repair_fields(parts[0].unionByName(parts[1]).unionByName(parts[2]), "entity_id", ["business_name", "business_address"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with a character that is invisible or stands for an equal-looking one."""
    return _fields(spark, sf_dir).where("is_case").select("entity_id", "field_name").distinct()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name and address of the three sources in one consistent form."""
    return _fields(spark, sf_dir).select("entity_id", "field_name", "clean").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every document, 2,048 tokens a container."""
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _tokenizer()), 2048)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(table(spark, sf_dir, "lang_samples"), docs, "text", "lang")
    return langid.stretches(docs, "doc_id", "text", "lang", model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the messages whose label is missing or wrong, or that mix languages."""
    return langid.wrong_labels(langid.document_languages(_judged(spark, sf_dir))).select("doc_id", "lang_code").distinct()


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's languages with confidence and share of the words."""
    return langid.document_languages(_judged(spark, sf_dir)).withColumns({"confidence": F.round("confidence", 4), "share": F.round("share", 4)})


def p9_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language of every message."""
    return _judged(spark, sf_dir).select("doc_id", F.posexplode("stretches").alias("place", "s")).select("doc_id", "place", "s.*").withColumn("confidence", F.round("confidence", 4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p3_found, p3_clean, p7_containers, p8_found, p9_found, p9_languages, p9_stretches)
}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of Source 2 records with spellings of one business's name."""
    return same_names.same_name_pairs(table(spark, sf_dir, "train_source2"), "entity_id", "business_name")


QUERIES[p6_found.__name__] = p6_found


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of Source 3 records at the same location."""
    return gazetteer.same_location_pairs(table(spark, sf_dir, "train_source3"), "entity_id", "business_address", "country")


QUERIES[p1_found.__name__] = p1_found


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = {k: table(spark, sf_dir, f"train_source{k}").withColumnRenamed("entity_id", "id") for k in (1, 2, 3)}
    truth = table(spark, sf_dir, "train_matches")
    return linkage.link(t[1], t[2].unionByName(t[3]), truth), truth


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source 1 records without a known list, with the Source 2 and 3 records that are the same business at the same place."""
    pairs, truth = _linked(spark, sf_dir)
    known = truth.select(F.col("source1_entity_id").alias("id_a")).distinct()
    return pairs.where("accepted").join(known.hint("merge"), "id_a", "left_anti").select("id_a", "id_b")


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mutual nearest pairs with their confidence."""
    return _linked(spark, sf_dir)[0].select("id_a", "id_b", F.round("confidence", 4).alias("confidence"), "accepted")


QUERIES |= {f.__name__: f for f in (p4_found, p4_confidence)}
