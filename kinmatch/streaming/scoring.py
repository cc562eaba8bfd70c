"""New pool records as a stream: candidates against a fixed table of Source 1 keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmatch.operators import blocking


def s1_index(s1: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``country_norm, t, key, s1_idx, idf`` of the Source 1 side, for stream-static joins."""
    return blocking.postings(s1, caps).withColumnRenamed("pool_idx", "s1_idx")


def stream_candidates(spark: SparkSession, source: str, schema, index: DataFrame, caps: dict[str, int], sink: str, checkpoint: str, top_k: int = 20) -> StreamingQuery:
    """Read Parquet files of normalized pool records from ``source`` as they arrive; write each batch's candidates to ``sink``.

    Every batch joins the static index, so state does not grow with the stream. Batches are idempotent: a batch
    that is replayed after a failure overwrites its own folder.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        keys = blocking.record_keys(df, tuple(caps)).withColumnRenamed("idx", "pool_idx")
        scored = keys.join(index, ["country_norm", "t", "key"]).groupBy("pool_idx", "s1_idx").agg(F.sum("idf").alias("bscore"), F.count(F.lit(1)).alias("n_keys"))
        from pyspark.sql import Window

        w = Window.partitionBy("pool_idx").orderBy(F.desc(F.round("bscore", 9)), "s1_idx")
        scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
