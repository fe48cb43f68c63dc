"""Alignment of streams with clocks of their own, and resampling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.operators.ranks import parted


#: Rows of one key up to which a key is one window. Beyond it all rows are dealt by ranges of (key, time), a key over as many tasks as it fills.
KEY_ROWS = 1_000_000


class Stream(NamedTuple):
    """Samples with values to be put on another clock: linear between samples, hold (the last one), or nearest (the earlier on ties)."""

    samples: DataFrame
    values: Sequence[str]
    how: str = "linear"


def _around(rows: DataFrame, part: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """For each stream the sample before ({name}p) and after ({name}n) each row: a look back along the order and one along its reverse, both linear."""
    whole = lambda cols: Window.partitionBy(*part).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    up, down = whole(order), whole([F.desc(c) for c in order])
    return rows.select("*", *(F.last(s, ignorenulls=True).over(up).alias(f"{s}p") for s in names)).select("*", *(F.last(s, ignorenulls=True).over(down).alias(f"{s}n") for s in names))


def _around_by_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """As _around by keys, a key of any length: ranges of (key, time) look around by themselves, and a range that begins or ends within a key gets
    the nearest samples of the key's other ranges. There are at most two such keys to a range, so these are broadcast."""
    kept, _ = parted(rows, [*keys, *order])
    at = lambda s: F.when(F.col(s).isNotNull(), F.struct(*order))
    edges = kept.groupBy(*keys, "__part").agg(*(F.max_by(s, at(s)).alias(f"{s}l") for s in names), *(F.min_by(s, at(s)).alias(f"{s}f") for s in names))
    key = Window.partitionBy(*keys)
    before = key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    after = key.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"{s}{x}", ignorenulls=True).over(w).alias(f"{s}{y}") for s in names for x, y, w in (("l", "b", before), ("f", "a", after))]
    spanning = edges.withColumn("__c", F.count("*").over(key)).filter("__c > 1")
    spanning = spanning.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), *carried)
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = _around(kept, ["__part", *keys], order, names).join(F.broadcast(spanning), same, "left")
    for s in names:
        out = out.withColumn(f"{s}p", F.coalesce(f"{s}p", f"{s}b")).withColumn(f"{s}n", F.coalesce(f"{s}n", f"{s}a"))
    return out


def _value(p: Column, n: Column, ts: str, v: str, how: str, kind: T.DataType) -> Column:
    if how == "hold":
        return F.when(p.isNotNull(), p[v]).otherwise(n[v])
    if how == "nearest":
        return F.when(n.isNull() | (p.isNotNull() & (F.col(ts) - p["t"] <= n["t"] - F.col(ts))), p[v]).otherwise(n[v])
    share = (F.col(ts) - p["t"]).cast("double") / (n["t"] - p["t"]).cast("double")
    blend = lambda x0, x1: x0 + (x1 - x0) * share
    if isinstance(kind, T.ArrayType):
        x0, x1 = p[v].cast("array<double>"), n[v].cast("array<double>")
        between = F.zip_with(x0, x1, blend)
    else:
        x0, x1 = p[v].cast("double"), n[v].cast("double")
        between = blend(x0, x1)
    return F.when(n.isNull(), x0).when(p.isNull(), x1).when(n["t"] == p["t"], x0).otherwise(between)


def fused(clock: DataFrame, streams: Sequence[Stream], keys: Sequence[str], ts: str) -> DataFrame:
    """keys, ts and all streams' values, which have names of their own, on the clock, in one shuffle and without a join of the streams.

    Beyond the first and the last sample the nearest one is held. Linear values are numbers or arrays of them. A key without samples in a
    stream has nulls there, a sample without a time says nothing, and a row of the clock without one has nulls. Of samples of one time the one
    with the largest hash counts; stream_faults() finds them. Rows of the clock are kept as they are, repeated ones too.
    """
    keys, names = list(keys), [f"__s{i}" for i in range(len(streams))]
    merged = clock.select(*keys, ts, F.lit(1).alias("__clock"))
    for s, stream in zip(names, streams, strict=True):
        one = F.struct(F.col(ts).alias("t"), *(F.col(v) for v in stream.values))
        merged = merged.unionByName(stream.samples.filter(F.col(ts).isNotNull()).select(*keys, ts, F.lit(0).alias("__clock"), one.alias(s)), allowMissingColumns=True)
    merged = merged.withColumn("__tie", F.xxhash64(*names))
    order = [ts, "__clock", "__tie"]  # samples before the clock's rows of their time
    longest = merged.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    looked = _around(merged, keys, order, names) if longest <= KEY_ROWS else _around_by_ranges(merged, keys, order, names)
    timed = F.col(ts).isNotNull()
    values = [
        F.when(timed, _value(F.col(f"{s}p"), F.col(f"{s}n"), ts, v, stream.how, stream.samples.schema[v].dataType)).alias(v) for s, stream in zip(names, streams, strict=True) for v in stream.values
    ]
    return looked.filter("__clock = 1").select(*keys, ts, *values)


def zero_order_hold(clock: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """The last sample at or before each time of the clock; before the first sample, that one. Keys without samples have nulls."""
    return fused(clock, [Stream(samples, values, "hold")], keys, ts)


def interpolate(clock: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """Linear between the samples around each time of the clock, held beyond both ends."""
    return fused(clock, [Stream(samples, values, "linear")], keys, ts)


def stream_faults(clock: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """keys and fault of the keys whose samples can't be put on the clock: empty (a key of the clock has none) or repeated (two of one time)."""
    held = samples.filter(F.col(ts).isNotNull())
    empty = clock.select(*keys).distinct().join(held.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit("empty").alias("fault"))
    repeated = held.groupBy(*keys, ts).count().filter("count > 1").select(*keys).distinct().select(*keys, F.lit("repeated").alias("fault"))
    return empty.unionByName(repeated)


def checked(clock: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The samples, or an error that names some of the keys that stream_faults() finds."""
    bad = stream_faults(clock, samples, keys, ts).limit(5).collect()
    if bad:
        raise ValueError("invalid streams: " + ", ".join(f"{tuple(r[:-1])} {r[-1]}" for r in bad))
    return samples


def order_faults(samples: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str]) -> DataFrame:
    """Keys whose times do not strictly increase in the order of arrival, and how often."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return samples.withColumn("__bad", F.col(ts) <= F.lag(ts).over(w)).groupBy(*keys).agg(F.count_if("__bad").alias("faults")).filter("faults > 0")


def nearest(clock: DataFrame, samples: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """The sample nearest in time, the earlier on ties."""
    return fused(clock, [Stream(samples, values, "nearest")], keys, ts)


def resample(df: DataFrame, value: str, points: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`points` values at equal steps of an episode's progress: k and value, linear between frames."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), F.lead(F.col(value).cast("double")).over(w).alias("__next"), (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    # frame i answers for the points whose floor is i: k * (n - 1) in [i (points - 1), (i + 1) (points - 1))
    n1, p1, i = F.col("__n") - 1, points - 1, F.col("__i")
    low = F.when(n1 == 0, F.lit(0)).otherwise(F.ceil(i * p1 / F.greatest(n1, F.lit(1)).cast("double")))
    high = F.when(n1 == 0, F.lit(p1)).when(i == n1, F.lit(p1)).otherwise(F.ceil((i + 1) * p1 / F.greatest(n1, F.lit(1)).cast("double")) - 1)
    rows = rows.withColumn("__low", low.cast("int")).withColumn("__high", high.cast("int")).filter("__low <= __high")
    rows = rows.withColumn("k", F.explode(F.sequence("__low", "__high")))
    share = F.col("k") * (F.col("__n") - 1) / F.lit(float(p1)) - F.col("__i")
    return rows.select(*keys, "k", (F.col("__v") + F.coalesce((F.col("__next") - F.col("__v")) * share, F.lit(0.0))).alias(value))


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str]) -> DataFrame:
    """Pairs of spans [low, high) of one key that overlap, and by how much.

    Time is cut into buckets as wide as the spans are long in the mean, twice as wide for the larger side, so a span is listed in few of them;
    a pair meets in each bucket that both touch and is reported in the first one. Spans that are much longer than the mean are listed in
    buckets of their own power of two: a pair meets at the level of its longer span, which the shorter one is listed at too. So spans are moved as
    often as there are levels, and pairs that do not overlap are a fixed multiple of those that do where spans are spread evenly.
    """
    keys = list(keys)
    spans = {"a": (a, a_span), "b": (b, b_span)}
    long_of = lambda side: (F.col(spans[side][1][1]) - F.col(spans[side][1][0])).cast("double")
    total = [spans[s][0].agg(F.coalesce(F.avg(F.when(long_of(s) > 0, long_of(s))), F.lit(0.0)), F.coalesce(F.max(long_of(s)), F.lit(0.0))).first() for s in "ab"]
    width = max(total[0][0], total[1][0]) * 2 or 1.0
    top = max(0, math.ceil(math.log2(max(total[0][1], total[1][1], width) / width)))  # levels: width, 2 width, ... up to the longest span
    level_of = lambda side: F.least(F.greatest(F.lit(0), F.ceil(F.log2(long_of(side) / width))), F.lit(top)).cast("int")

    def listed(side: str) -> DataFrame:
        df, (low, high) = spans[side]
        own = df.filter(F.col(low) < F.col(high)).withColumn(f"__{side}", level_of(side)).withColumn("__level", F.explode(F.sequence(F.col(f"__{side}"), F.lit(top))))
        size = F.pow(F.lit(2.0), F.col("__level")) * width
        return own.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))

    x, y = listed("a"), listed("b")
    low, high = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    size = F.pow(F.lit(2.0), F.col("__level")) * width
    on, own = [*keys, "__level", "__bucket"], lambda side: F.col(f"__{side}") == F.col("__level")
    both = x.filter(own("a")).join(y, on).unionByName(x.filter(~own("a")).join(y.filter(own("b")), on))
    pairs = both.filter((low < high) & (F.floor(low / size) == F.col("__bucket")))
    return pairs.withColumn("overlap", high - low).drop("__level", "__bucket", "__a", "__b")


def range_lookup(points: DataFrame, point: str, spans: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points with the span [low, high) that holds them, by an equi-join on buckets of `width`: spans are listed in each bucket they touch."""
    spans = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    points = points.withColumn("__bucket", F.floor(F.col(point) / width))
    return points.join(spans, "__bucket").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bucket")
