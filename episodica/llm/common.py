"""What the operators share: durable intermediate tables, shipping of the package, ranks without a single hot task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica import shipping
from episodica.durable import drop, drop_tables, durable, new_path, scratch_dir  # noqa: F401

ARROW_BYTES, _ARROW = "6m", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """As the library's; and Arrow batches of at most ARROW_BYTES where the session has Spark's default, for both sides hold one whole."""
    shipping.ship_package(spark)
    if spark.conf.get(_ARROW, "64m") in ("64m", "67108864b"):
        spark.conf.set(_ARROW, ARROW_BYTES)


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the machine: idle workers stay alive next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def md5_long(c: Column) -> Column:
    """The first 60 bits of md5, as a non-negative long; any SQL engine with md5 gives the same."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def md5_unit(c: Column) -> Column:
    """A uniform double in [0, 1) with 52 bits, from md5."""
    return F.conv(F.substring(F.md5(c), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(xs: Sequence[int]) -> Column:
    """A literal array: one expression however long (an array of literals is one for each)."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")


def range_of(n: int, at_most: Callable[[Column], Column]) -> Column:
    """How many of n sorted splitters are at most a key, at_most(i) being whether the i-th is: a search in two levels of about sqrt(n) steps."""
    if not n:
        return F.lit(0)
    step = max(1, round(n**0.5))
    block = F.size(F.filter(longs(range(0, n, step)), at_most))
    start = F.greatest(block - 1, F.lit(0)) * step
    fine = F.size(F.filter(F.sequence(start, F.least(start + step, F.lit(n)) - 1), at_most))
    return F.when(block == 0, 0).otherwise(start + fine)
