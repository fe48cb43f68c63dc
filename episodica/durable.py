"""Intermediate tables that outlive executors: Parquet in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of this machine only where that is unset and Spark is one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_episodica_scratch", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="episodica-")
        spark.sparkContext._episodica_scratch = found
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, remembered for drop_tables()."""
    path = f"{scratch_dir(spark)}/episodica/{tag}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_episodica_tables", []).append(path)
    return path


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, and any executor can read it again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._episodica_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that durable() gave, as soon as nothing that is still to be computed reads them."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_episodica_path", None)
        known = spark.sparkContext.__dict__.get("_episodica_tables", [])
        if path in known:
            known.remove(path)
            _delete(spark, path)


def drop_tables(spark: SparkSession) -> int:
    """Deletes what durable() has written in this session; results that read it are lost. Gives the number of tables."""
    paths = spark.sparkContext.__dict__.pop("_episodica_tables", [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
