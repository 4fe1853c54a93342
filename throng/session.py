"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master without the setting gets a temporary folder of this
    machine; a cluster without it is refused, as its executors share no disk.
    """
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "THRONG_SHARED" not in os.environ:
        os.environ["THRONG_SHARED"] = tempfile.mkdtemp(prefix="spark-throng-", dir="/tmp")
    return "file://" + os.environ["THRONG_SHARED"]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def drop_stages(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once no result that was
    read from them is needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a place that outlives any executor.
    """
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(table: DataFrame) -> None:
    """Delete the files of a table that ``stage_table`` gave and nothing reads any more."""
    spark = table.sparkSession
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
