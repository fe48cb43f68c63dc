"""Histograms of fixed size as mergeable states, for quantiles of streams and of tables too large to sort.

A state has for each group the range of what it has seen, count, mean and mean of squares, and counts of `bins` equal bins over that range.
Two states meet on the union of their ranges: each bin's count moves to the bin in which its left edge then lies. So a quantile, the left edge
of the first bin up to which enough values lie, is off by at most a bin's width for each time the range has grown.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.durable import durable
from episodica.operators.ranks import with_group_table

BINS = 5000


class Histogram(NamedTuple):
    """ranges: by, low, high, n, mean, square, a row for each group; counts: by, bin (from 0), count, of the bins that hold anything."""

    ranges: DataFrame
    counts: DataFrame
    by: Sequence[str]
    bins: int = BINS


def _same(a: DataFrame, b: DataFrame, by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & a[c].eqNullSafe(b[f"__{c}"])
    return out


def _with(df: DataFrame, ranges: DataFrame, by: Sequence[str], **names: str) -> DataFrame:
    """df with columns of its group's range, under other names."""
    other = ranges.select(*(F.col(c).alias(f"__{c}") for c in by), *(F.col(c).alias(n) for c, n in names.items()))
    return df.join(other, _same(df, other, by)).drop(*(f"__{c}" for c in by))


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of x; the last one holds the upper end, and a range of one value has bin 0 alone."""
    return F.when(high <= low, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * bins)))).cast("int")


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = BINS) -> Histogram:
    """The state of a table: one pass for the ranges, one for the counts, both summed before the shuffle. Both are written, so that a plan
    that meets many states reads them and holds none of their joins on the driver. Nulls and values that are not finite take no part."""
    by, x = list(by), F.col(value).cast("double")
    rows = df.select(*by, x.alias("__x")).filter(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") != float("inf")))
    ranges = rows.groupBy(*by).agg(F.min("__x").alias("low"), F.max("__x").alias("high"), F.count("*").alias("n"), F.avg("__x").alias("mean"), F.avg(F.col("__x") * F.col("__x")).alias("square"))
    ranges = durable(ranges, "ranges")
    at = with_group_table(rows, ranges.select(*by, F.col("low").alias("__low"), F.col("high").alias("__high")), by)
    counts = at.groupBy(*by, _bin(F.col("__x"), F.col("__low"), F.col("__high"), bins).alias("bin")).agg(F.count("*").alias("count"))
    return Histogram(ranges, durable(counts, "counts"), by, bins)


def _tagged(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of the tables, with the table's place in __state."""
    first, *others = (t.withColumn("__state", F.lit(i)) for i, t in enumerate(tables))
    for t in others:
        first = first.unionByName(t)
    return first


def rebinned(counts: DataFrame, moves: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """The counts over other ranges, by group. moves has a row for each group: its range (__low0, __high0) and the new one (__low1, __high1).
    Where the range is the same, so are the bins."""
    both = with_group_table(counts, moves, by)
    edge = F.col("__low0") + (F.col("__high0") - F.col("__low0")) * F.col("bin") / bins
    kept = (F.col("__low0") == F.col("__low1")) & (F.col("__high0") == F.col("__high1"))
    new = F.when(kept, F.col("bin")).otherwise(_bin(edge, F.col("__low1"), F.col("__high1"), bins))
    return both.groupBy(*by, new.alias("bin")).agg(F.sum("count").alias("count"))


def merged(states: Sequence[Histogram]) -> Histogram:
    """One state of several: all are moved to the union of their ranges at once, by one join however many they are."""
    first, by = states[0], list(states[0].by)
    if any(list(s.by) != by or s.bins != first.bins for s in states):
        raise ValueError("states of other groups or bins")
    every = _tagged([s.ranges for s in states])
    n = F.sum("n")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / n
    ranges = every.groupBy(*by).agg(F.min("low").alias("low"), F.max("high").alias("high"), n.alias("n"), mean("mean").alias("mean"), mean("square").alias("square"))
    group = Window.partitionBy(*by)  # a row for each state
    moves = every.select("__state", *by, F.col("low").alias("__low0"), F.col("high").alias("__high0"), F.min("low").over(group).alias("__low1"), F.max("high").over(group).alias("__high1"))
    moved = rebinned(_tagged([s.counts for s in states]), durable(moves, "moves"), ["__state", *by], first.bins)
    counts = moved.groupBy(*by, "bin").agg(F.sum("count").alias("count"))
    return Histogram(durable(ranges, "ranges"), durable(counts, "counts"), by, first.bins)


def statistics(h: Histogram, quantiles: dict[str, float]) -> DataFrame:
    """by, n, mean, std (of a population), low, high, and the quantiles by name: left edges of the first bins up to which a share q of the values lies.

    Groups of fewer than two values have null in std and quantiles.
    """
    upto = h.counts.withColumn("__upto", F.sum("count").over(Window.partitionBy(*h.by).orderBy("bin")))  # at most `bins` rows to a group
    placed = _with(upto, h.ranges, h.by, n="__n")
    firsts = placed.groupBy(*h.by).agg(*(F.min(F.when(F.col("__upto") >= q * F.col("__n"), F.col("bin"))).alias(f"__q{i}") for i, q in enumerate(quantiles.values())))
    names = {f"__q{i}": f"__f{i}" for i in range(len(quantiles))}
    out = _with(h.ranges, firsts, h.by, **names)
    spread, enough = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))), F.col("n") >= 2
    edge = lambda c: F.col("low") + (F.col("high") - F.col("low")) * F.col(c) / h.bins
    return out.select(*h.by, "n", "mean", F.when(enough, spread).alias("std"), "low", "high", *(F.when(enough, edge(f"__f{i}")).alias(name) for i, name in enumerate(quantiles)))
