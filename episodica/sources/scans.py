"""Readers. Paths may be in any store that Spark reads; nothing is opened on the driver but small JSON documents, by Spark too."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"parquet": "parquet", "jsonl": "json", "json": "json", "csv": "csv", "arrow": "arrow"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def extension(spark: SparkSession, path: str) -> str:
    """A file's extension; of a folder, that of its first data file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        path = next((n for n in names if not n.startswith(("_", "."))), "")
    return path.rsplit(".", 1)[-1] if "." in path else ""


def read_files(spark: SparkSession, paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Files or folders, several separated by commas, by extension of the first. Missing: FileNotFoundError; unknown extension: ValueError."""
    found = [p.strip() for p in paths.split(",") if p.strip()]
    for p in found:
        if not exists(spark, p):
            raise FileNotFoundError(p)
    ext = extension(spark, found[0])
    if ext not in FORMATS:
        raise ValueError(f"unknown extension {ext!r}")
    if ext == "arrow":
        return read_arrow(spark, found, schema)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", "true").csv(found) if ext == "csv" else reader.format(FORMATS[ext]).load(found)


def read_arrow(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str | None) -> DataFrame:
    """Arrow IPC files or streams, one task for each file; the schema has to be given."""
    if schema is None:
        raise ValueError("Arrow files need a schema")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                buf = content.as_buffer()
                source = pa.ipc.open_file(buf) if buf[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(buf)
                yield from source.read_all().to_batches()

    return spark.read.format("binaryFile").load(list(paths)).select("content").mapInArrow(run, schema)


def read_stream(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str) -> DataFrame:
    """New files of a folder as a stream; offsets are in the query's checkpoint, which is what a resumable dataset keeps."""
    return spark.readStream.schema(schema).format(FORMATS[fmt]).load(path)


def strict_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON object on each line; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON object on each line; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def lenient_stats(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array, or objects separated by commas, or objects on lines with bad ones dropped: the first that parses."""
    text = spark.read.option("wholetext", "true").text(path)
    kind = T.ArrayType(schema)
    array = F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    good = F.filter(F.from_json(array, kind, {"mode": "PERMISSIVE"}), lambda x: x.isNotNull())
    whole = text.select(F.explode(good).alias("x")).select("x.*")
    return whole if not whole.isEmpty() else lenient_json(spark, path, schema)


#: Bytes of a document that the driver takes at most.
MOST_DOCUMENT = 64 << 20


def _body(spark: SparkSession, path: str) -> str:
    """The text of a small file; raises for a large one before it is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    n = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if n > MOST_DOCUMENT:
        raise ValueError(f"{path} has {n} bytes, more than a document may have")
    return "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())


def read_document(spark: SparkSession, path: str) -> Any:
    """One JSON document (settings, dataset info) as Python values."""
    return json.loads(_body(spark, path))


def read_settings(spark: SparkSession, path: str) -> Any:
    """YAML where a parser is installed, else JSON."""
    body = _body(spark, path)
    try:
        import yaml
    except ImportError:
        return json.loads(body)
    return yaml.safe_load(body)


def episode_frames(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """Frames of all episodes; only these columns are read."""
    return spark.read.parquet(f"{root}/data").select(*(F.col(f"`{c}`") for c in columns))


def episode_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all episodes, slashes in names made underscores, by episode."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    return df.toDF(*(c.replace("/", "_") for c in df.columns)).orderBy("episode_index")


def image_times(files: DataFrame, path: str = "path") -> DataFrame:
    """ts from the names of <ts>.jpg files; other names are skipped."""
    ts = F.regexp_extract(path, r"([^/]+)\.jpg$", 1)
    return files.select(F.when(ts.rlike("^-?[0-9]+$"), ts).try_cast("long").alias("ts")).filter("ts is not null").orderBy("ts")


def last_of_step(log: DataFrame, step: str, line: str) -> DataFrame:
    """The last row, by line, of each step of a log."""
    others = [c for c in log.columns if c != step]
    return log.groupBy(step).agg(F.max_by(F.struct(*others), line).alias("__r")).select(step, "__r.*")


def mined(lines: DataFrame, text: str, pattern: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows from log lines by a pattern: a field and its type for each group; lines that don't match go."""
    hit = lines.filter(F.col(text).rlike(pattern))
    return hit.select(*(F.regexp_extract(text, pattern, i).try_cast(t).alias(n) for i, (n, t) in enumerate(fields, 1)))


def conflicts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with several values."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("values")).filter("values > 1")


def dummy_tokens(spark: SparkSession, n: int, size: int, vocabulary: int = 32_768, seed: int = 42) -> DataFrame:
    """n samples of random ids, masks of 1 and labels equal to the ids."""
    one = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(vocabulary)).cast("int")
    ids = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)
    return spark.range(n).select(F.col("id").alias("sample_id"), ids.alias("input_ids"), F.array_repeat(F.lit(1), size).alias("attention_mask")).withColumn("labels", F.col("input_ids"))


def rows_at(df: DataFrame, index: str, jobs: DataFrame, job_index: str) -> DataFrame:
    """Random access: the rows whose index is in a job list, as often as it is there."""
    return jobs.select(F.col(job_index).alias(index)).join(df, index)


def rollouts(parquet: DataFrame, lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """Two formats of rollouts as one: the second's columns renamed to the first's."""
    return parquet.unionByName(lines.withColumnsRenamed(names).select(*parquet.columns))


def map_rows(df: DataFrame, *steps: Any) -> DataFrame:
    """DataFrame functions one after the other."""
    for f in steps:
        df = df.transform(f)
    return df


def content_digest(files: DataFrame) -> DataFrame:
    """path, bytes and SHA-256 of files read as binaryFile."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def nested(name: str, default: Column | None = None) -> Column:
    """A nested field by its dotted name, with a default where it is null."""
    return F.col(name) if default is None else F.coalesce(F.col(name), default)


def read_npz(spark: SparkSession, path: str | Sequence[str], batch: int = 65_536) -> DataFrame:
    """Cells of the numeric arrays in .npz files: path, name, index (one number for each axis), value. One task for each file, one array at a time."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("index", T.ArrayType(T.LongType())), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        for b in batches:
            for where, content in zip(b.column(0), b.column(1), strict=True):
                with np.load(io.BytesIO(content.as_buffer()), allow_pickle=False) as found:
                    for name in found.files:
                        a = found[name]
                        flat = a.ravel()
                        for at in range(0, a.size, batch):
                            some = np.arange(at, min(a.size, at + batch))
                            index = np.stack(np.unravel_index(some, a.shape), axis=1) if a.ndim else np.zeros((1, 0), np.int64)
                            ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * a.ndim)
                            lists = pa.ListArray.from_arrays(ends, pa.array(index.ravel().astype(np.int64)))
                            text = lambda s, n=len(some): pa.array([s] * n, pa.string())
                            yield pa.RecordBatch.from_arrays([text(where.as_py()), text(name), lists, pa.array(flat[some].astype(np.float64))], names=schema.names)

    return spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content").mapInArrow(run, schema)


def layered(*documents: dict) -> dict:
    """Nested settings, later documents over earlier ones, field by field."""
    out: dict = {}
    for doc in documents:
        for k, v in doc.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def dotted(document: dict, prefix: str = "") -> dict[str, Any]:
    """Settings by dotted names, sorted."""
    out: dict[str, Any] = {}
    for k, v in sorted(document.items()):
        out |= dotted(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def from_dotted(values: dict[str, Any]) -> dict:
    """The inverse of dotted(): what a command line's overrides say."""
    out: dict = {}
    for name, v in values.items():
        at = out
        *parents, last = name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = v
    return out
