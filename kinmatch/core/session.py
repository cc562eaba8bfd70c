"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What ``cut`` sets while it writes. The planner takes a table for small by its compressed bytes and does not see that a
#: row becomes many, so what it broadcasts can fill the driver: only tables that the code names are broadcast.
_WRITING = {_CLEANUP: "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    The cluster's own ``spark.checkpoint.dir`` always wins. A temporary folder is set only on a local master
    (tests), because executors on other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    set_by_code = sc._jsc.sc().getCheckpointDir()
    if set_by_code.isDefined():
        return set_by_code.get()
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinmatch-"))
        return sc._jsc.sc().getCheckpointDir().get()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read from there.

    It is computed once, its lineage ends, and a lost executor loses nothing. Unlike RDD checkpoints the table is
    compressed, later reads take only the columns they use, and its size is known to the planner. Tables are
    removed when the program ends, or by ``release``. Joins behind it broadcast only what ``F.broadcast`` names.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinmatch-{uuid.uuid4().hex}"
    # Shuffle files behind the table are dead once it is written: the execution removes them at its end, rather
    # than whenever the driver happens to collect its garbage.
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the table behind a result of ``cut`` that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        folder = path.rsplit("/", 1)[0]
        if "/kinmatch-" in folder:
            _remove(df.sparkSession, folder)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone
            return
