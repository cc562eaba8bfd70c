"""Readers and writers: tab-separated records, ground truth, result lists, dictionaries and settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAB = {"sep": "\t", "header": True, "quote": "", "escape": ""}


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with a header and without quoting; every column a string, missing values ""."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(**_TAB).csv(path).na.fill("")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header, blanks kept, no quotes; a folder of part files."""
    df.write.mode("overwrite").options(**_TAB, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def source_records(raw: DataFrame, src: int) -> DataFrame:
    """Records under short names, marked with their source: ``eid, name, addr, country, src``; NULL text becomes ""."""
    short = {"entity_id": "eid", "business_name": "name", "business_address": "addr", "country": "country"}
    return raw.select(*[F.coalesce(F.col(a), F.lit("")).alias(b) for a, b in short.items()], F.lit(src).cast("tinyint").alias("src"))


def pooled(*sources: DataFrame) -> DataFrame:
    """Several sources as one pool."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def number_rows(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with a dense row number from 0 in the order of ``order``.

    A range partitioning sorts the rows; the rows of each partition are counted (one number a partition reaches
    the driver), and every partition numbers its own from there. No single task sees all rows.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # Written once: a second evaluation could draw the range borders anew.
    from kinmatch.core.session import cut

    parts = cut(parts)
    counts = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())
    start, offsets = 0, {}
    for p, n in counts:
        offsets[p] = start
        start += n
    if not offsets:
        return parts.drop("_p").withColumn(name, F.lit(None).cast("bigint"))
    base = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    w = Window.partitionBy("_p").orderBy(*order)
    return parts.withColumn(name, (F.row_number().over(w) - 1 + base[F.col("_p")]).cast("bigint")).drop("_p")


def truth_links(truth: DataFrame) -> DataFrame:
    """``source1_entity_id, eid`` rows of comma-separated lists; repeated and empty entries dropped."""
    return truth.select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("eid")).withColumn("eid", F.trim("eid")).where("eid <> ''").distinct()


def label_pool(pool: DataFrame, s1: DataFrame, truth: DataFrame) -> DataFrame:
    """``pool`` with ``gid``: the ``idx`` of the Source 1 record that the truth links it to, -1 without one."""
    links = truth_links(truth).join(s1.select(F.col("eid").alias("source1_entity_id"), F.col("idx").alias("_gid")), "source1_entity_id")
    one = links.groupBy("eid").agg(F.min("_gid").alias("_gid"))
    return pool.join(one, "eid", "left").withColumn("gid", F.coalesce("_gid", F.lit(-1))).drop("_gid")


def id_lists(pairs: DataFrame, s1: DataFrame, pool: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per Source 1 record: ``source1_entity_id`` and its pool ids, sorted, comma-separated, "" without any.

    Repeated pairs count once; a pair whose pool record is unknown is dropped.
    """
    named = pairs.select("s1_idx", "pool_idx").distinct().join(pool.select(F.col("idx").alias("pool_idx"), F.col("eid").alias("_oid")), "pool_idx")
    lists = named.groupBy("s1_idx").agg(F.array_join(F.sort_array(F.collect_list("_oid")), ",").alias(column))
    return s1.select(F.col("idx").alias("s1_idx"), F.col("eid").alias("source1_entity_id")).join(lists, "s1_idx", "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def check_id_lists(lists: DataFrame, s1: DataFrame) -> None:
    """Raise unless ``lists`` has every Source 1 record exactly once."""
    got = lists.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source1_entity_id").alias("d")).first()
    want = s1.count()
    if (got["n"], got["d"]) != (want, want):
        raise ValueError(f"{got['n']} rows with {got['d']} ids for {want} records")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, made and written first unless it is there.

    A table counts as there once it was written whole (its mark of success exists); a reading error is raised and
    destroys nothing.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def save_json(value: object, path: str) -> None:
    """A driver-side value as JSON, sorted, non-ASCII characters kept."""
    Path(path).write_text(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1), encoding="utf-8")


def load_json(path: str) -> object:
    """The value that ``save_json`` wrote."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


@dataclass
class Settings:
    """Parameters of a linkage run; relative paths resolve against the settings file."""

    paths: dict[str, str] = field(default_factory=dict)
    seed: int = 42
    max_df: dict[str, int] = field(default_factory=lambda: {"n1": 500, "a1": 500, "nn": 500, "ab": 500})
    top_k: int = 300
    rerank_k: int = 50
    n_folds: int = 2

    @classmethod
    def load(cls, path: str) -> Settings:
        """Settings from a JSON or YAML file (YAML needs its parser installed); the work folder is made.

        Besides this class's own fields, ``blocking`` and ``validation`` sections are understood: one ``max_df`` for all kinds
        of keys, ``top_k``, ``rerank_k``, ``n_folds``.
        """
        text = Path(path).read_text(encoding="utf-8")
        if Path(path).suffix in (".yaml", ".yml"):
            import yaml

            raw = yaml.safe_load(text)
        else:
            raw = json.loads(text)
        raw |= {k: v for section in ("blocking", "validation") for k, v in (raw.pop(section, None) or {}).items() if k in ("max_df", "top_k", "rerank_k", "n_folds")}
        if isinstance(raw.get("max_df"), int):
            raw["max_df"] = dict.fromkeys(("n1", "a1", "nn", "ab"), raw["max_df"])
        raw["paths"] = {k.removesuffix("_dir"): v for k, v in raw.get("paths", {}).items()}
        base = Path(path).resolve().parent
        raw["paths"] = {k: str((base / v).resolve()) for k, v in raw.get("paths", {}).items()}
        if "work" in raw["paths"]:
            Path(raw["paths"]["work"]).mkdir(parents=True, exist_ok=True)
        return cls(**raw)
