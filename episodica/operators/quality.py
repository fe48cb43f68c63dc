"""Integrity as queries that return violations: no rows means sound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.vectors import all_finite
from episodica.operators.ranks import numbered


def integrity(frames: DataFrame, episodes: DataFrame, key: str, frame: str, size: str, vectors: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """For each episode, in one aggregation: bad_length (rows are not as many as declared), bad_index (frames are not 0 to n - 1), nonfinite."""
    bad = F.lit(False)
    for v in vectors:
        bad = bad | ~F.coalesce(all_finite(F.col(v)), F.lit(False))
        if width is not None:
            bad = bad | (F.size(v) != width)
    agg = frames.groupBy(key).agg(F.count("*").alias("rows"), F.min(frame).alias("low"), F.max(frame).alias("high"), F.countDistinct(frame).alias("frames"), F.count_if(bad).alias("nonfinite"))
    both = agg.join(episodes.select(key, F.col(size).alias("declared")), key, "full")
    rows = F.coalesce("rows", F.lit(0))
    index = F.coalesce((F.col("low") != 0) | (F.col("high") != F.col("rows") - 1) | (F.col("frames") != F.col("rows")), F.lit(False))
    return both.select(key, rows.alias("rows"), "declared", (~F.col("declared").eqNullSafe(rows)).alias("bad_length"), index.alias("bad_index"), F.coalesce("nonfinite", F.lit(0)).alias("nonfinite"))


def offset_violations(episodes: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Episodes that do not begin where the one before ends; the first must begin at 0."""
    placed = numbered(episodes, [key], "__place")
    ends = placed.select((F.col("__place") + 1).alias("__place"), F.col(high).alias("expected"))
    both = placed.join(ends, "__place", "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return both.filter(F.col(low) != F.col("expected")).drop("__place")


def clock_violations(frames: DataFrame, frame: str, ts: str, fps: float, tolerance: float = 1e-4) -> DataFrame:
    return frames.filter(F.abs(F.col(ts) - F.col(frame) / F.lit(float(fps))) > tolerance)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def stat_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], atol: float = 3e-4, rtol: float = 1e-4) -> DataFrame:
    """Keys whose mean or std differ by more than atol + rtol |b|, whose min or max differ at all, or whose q99 is below q01."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, list(keys))
    far = lambda c: F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) > atol + rtol * F.abs(F.col(f"y.{c}"))
    other = lambda c: F.col(f"x.{c}") != F.col(f"y.{c}")
    return both.filter(far("mean") | far("std") | other("min") | other("max") | (F.col("x.q99") < F.col("x.q01"))).select(*keys)


def crossing(frames: DataFrame, key: str, index: str, span: DataFrame, low: str, high: str) -> DataFrame:
    """Frames whose index is outside their episode's span."""
    return frames.join(span.select(key, low, high), key).filter((F.col(index) < F.col(low)) | (F.col(index) >= F.col(high)))


def peak_counts(rows: DataFrame, value: Column, bounds: Sequence[float]) -> DataFrame:
    """How many absolute values pass each bound, in one row."""
    return rows.agg(*(F.count_if(F.abs(value) > b).alias(f"above_{b:g}") for b in bounds))


def checksums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SHA-256 of each row as JSON: what was written can be compared with what is read."""
    return df.select(*keys, F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("sha256"))
