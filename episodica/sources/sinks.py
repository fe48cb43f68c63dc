"""Writers."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.operators.windows import running_offsets
from episodica.sources.scans import exists


def write_episodes(df: DataFrame, path: str, key: str, order: str, partitions: int | None = None) -> None:
    """Parquet with zstd, episodes together and in order, few large files; an existing path is an error."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key, order).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def verify(df: DataFrame, path: str) -> int:
    """Rows in which what was written differs from df."""
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return df.exceptAll(back).count() + back.exceptAll(df).count()


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; booleans as True and False."""
    flags = {c: F.when(F.col(c), "True").when(~F.col(c), "False") for c, t in df.dtypes if t == "boolean"}
    df.withColumns(flags).write.mode("errorifexists").option("header", "true").csv(path)


def write_document(spark: SparkSession, value: Any, path: str) -> None:
    """One indented JSON document, by Spark's file system; its folders are made. An existing path is an error."""
    if exists(spark, path):
        raise FileExistsError(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def refuse_existing(spark: SparkSession, path: str) -> None:
    if exists(spark, path):
        raise FileExistsError(path)


def stats_document(stats: DataFrame, feature: str = "feature", dim: str = "dim") -> dict[str, dict[str, list[float]]]:
    """Statistics in long form, a row for each feature and dimension, as {feature: {statistic: [by dimension]}}: a small table."""
    names = [c for c in stats.columns if c not in (feature, dim)]
    rows = stats.groupBy(feature).agg(F.array_sort(F.collect_list(F.struct(dim, *names))).alias("v")).collect()
    return {r[feature]: {n: [x[n] for x in r["v"]] for n in names} for r in rows}


def stats_table(spark: SparkSession, document: dict[str, dict[str, Sequence[float]]]) -> DataFrame:
    """The inverse of stats_document."""
    names = sorted({n for v in document.values() for n in v})
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("dim", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    rows = [(f, i, *(None if v.get(n) is None or v[n][i] is None else float(v[n][i]) for n in names)) for f, v in document.items() for i in range(max(map(len, v.values())))]
    return spark.createDataFrame(rows, schema)


def view_of(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """A named view of the rows with allowed keys: nothing is copied."""
    out = df.join(ids.select(key), key, "left_semi")
    out.createOrReplaceTempView(name)
    return out


def thinned(series: DataFrame, order: str, most: int = 500) -> DataFrame:
    """Every max(1, n // most)-th row of a series, and the last, for a chart."""
    ranked = running_offsets(series.withColumn("__one", F.lit(1)), order, "__one").drop("__one", "offset")
    n = ranked.count()
    stride = max(1, n // most)
    return ranked.filter((F.pmod("new_index", F.lit(stride)) == 0) | (F.col("new_index") == n - 1)).drop("new_index")
