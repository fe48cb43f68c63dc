"""Sequence operators on episodes: rows of one key in an order that is total.

Every operator takes the key columns and the order columns; the work is one shuffle by key and a sort, shared by all windows over the same
keys. Episodes are bounded (thousands of rows); what may not be bounded, such as a running offset over all episodes, works on ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from episodica.operators.ranks import array_of, before, numbered, parted


def episode(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def frame_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "frame") -> DataFrame:
    """Rows numbered from 0 within the episode."""
    return df.withColumn(out, F.row_number().over(episode(keys, order)).cast("long") - 1)


def future_chunk(df: DataFrame, value: str, horizon: int, keys: Sequence[str], order: Sequence[str], out: str = "chunk") -> DataFrame:
    """The next `horizon` values at every row, the last one held at the episode's end, and {out}_is_pad, true for held places."""
    raw = F.collect_list(value).over(episode(keys, order).rowsBetween(0, horizon - 1))
    df = df.withColumn("__raw", raw)
    held = F.concat("__raw", F.array_repeat(F.element_at("__raw", -1), F.lit(horizon) - F.size("__raw")))
    pad = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: h >= F.size("__raw"))
    return df.withColumn(out, held).withColumn(f"{out}_is_pad", pad).drop("__raw")


def rising_edges(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """closed, opens and closes: where the value passes the threshold up (closes) and down (opens); the first row is no edge."""
    w = episode(keys, order)
    df = df.withColumn("closed", value > threshold)
    before = F.lag("closed").over(w)
    return df.withColumn("closes", F.coalesce(F.col("closed") & ~before, F.lit(False))).withColumn("opens", F.coalesce(~F.col("closed") & before, F.lit(False)))


def first_closure(edges: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """For each episode the frame of the first closing edge; null if it begins closed or never closes."""
    agg = edges.groupBy(*keys).agg(F.min(F.when(F.col("closes"), F.col(frame))).alias("first"), F.min_by("closed", frame).alias("starts_closed"), F.count("*").alias("length"))
    return agg.select(*keys, F.when(~F.col("starts_closed"), F.col("first")).alias("closure"), "length")


def single_phase(edges: DataFrame, keys: Sequence[str], least: int, frame: str = "frame") -> DataFrame:
    """Episodes closed at neither end, with one closing and one opening edge at least `least` frames apart: close, open, duration."""
    agg = edges.groupBy(*keys).agg(
        F.min_by("closed", frame).alias("first"), F.max_by("closed", frame).alias("last"), F.count_if("closes").alias("ups"), F.count_if("opens").alias("downs"),
        F.min(F.when(F.col("closes"), F.col(frame))).alias("close"), F.min(F.when(F.col("opens"), F.col(frame))).alias("open"),
    )
    good = ~F.col("first") & ~F.col("last") & (F.col("ups") == 1) & (F.col("downs") == 1) & (F.col("open") - F.col("close") >= least)
    return agg.filter(good).select(*keys, "close", "open", (F.col("open") - F.col("close")).alias("duration"))


def after_event(df: DataFrame, events: DataFrame, keys: Sequence[str], at: str, length: int | None, frame: str = "frame", size: str = "length") -> DataFrame:
    """Rows from the event's frame on, numbered by step: all of them, or exactly `length`, only of episodes that have so many."""
    out = df.join(events.filter(F.col(at).isNotNull()).select(*keys, at, size), list(keys)).filter(F.col(frame) >= F.col(at))
    if length is not None:
        out = out.filter((F.col(frame) < F.col(at) + length) & (F.col(at) + length <= F.col(size)))
    return out.withColumn("step", F.col(frame) - F.col(at))


def relative_to_first(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "relative") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.first(value).over(episode(keys, order)))


def difference(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], n: int = 1, out: str = "difference") -> DataFrame:
    """The n-th difference; null for the first n rows."""
    w, cur = episode(keys, order), value
    for i in range(n):
        df = df.withColumn(f"__d{i}", F.col(cur) - F.lag(cur).over(w))
        cur = f"__d{i}"
    return df.withColumn(out, F.col(cur)).drop(*(f"__d{i}" for i in range(n)))


def trailing_mean(df: DataFrame, value: str, size: int, keys: Sequence[str], order: Sequence[str], full_only: bool = False, out: str = "smooth") -> DataFrame:
    """Mean of this row and the size - 1 before it, of fewer at the start. full_only: full windows alone, or the raw values if there is none.

    Without keys the table is one sequence of any length: see over_ranges.
    """
    if not keys:
        rows, n = over_ranges(df, order, size - 1)
        rows = rows.withColumn(out, F.avg(value).over(Window.partitionBy("__to").orderBy("__place").rowsBetween(1 - size, 0))).filter("__to = __part")
        if full_only:
            rows = rows.withColumn(out, F.col(value).cast("double")) if n < size else rows.filter(F.col("__place") >= size - 1)
        return rows.drop("__to", "__part", "__place")
    w = episode(keys, order)
    df = df.withColumn(out, F.avg(value).over(w.rowsBetween(1 - size, 0)))
    if full_only:
        df = df.withColumn("__n", F.count("*").over(whole(keys))).withColumn("__i", F.row_number().over(w))
        df = df.withColumn(out, F.when(F.col("__n") < size, F.col(value)).otherwise(F.col(out))).filter((F.col("__n") < size) | (F.col("__i") >= size)).drop("__n", "__i")
    return df


def over_ranges(df: DataFrame, order: Sequence[str], back: int) -> tuple[DataFrame, int]:
    """df dealt by ranges of a total order, each range (__to) with the `back` rows before it as well, and the number of rows. __place counts from 0;
    where __part is not __to the row is there for others' windows alone."""
    kept, sizes = parted(df, order)
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    place = before(sizes) + F.col("__nth")
    rows = kept.withColumn("__place", place).drop("__nth")
    following = F.element_at(array_of([*starts[1:], sum(sizes) + back + 1]), F.col("__part") + 1)
    last = F.size(F.filter(array_of(starts), lambda x: x <= F.col("__place") + back)) - 1
    to = F.when(F.col("__place") + back >= following, last).otherwise(F.col("__part"))  # only the last rows of a range are looked up
    return rows.withColumn("__to", F.explode(F.sequence(F.col("__part"), F.greatest(to, F.col("__part"))))), sum(sizes)


def tumbling(df: DataFrame, frame: str, size: int, out: str = "window") -> DataFrame:
    """Number of the fixed window of `size` frames."""
    return df.withColumn(out, F.floor(F.col(frame) / size).cast("long"))


def fractional_anchors(sizes: DataFrame, size: str, fractions: Sequence[float], out: str = "anchor") -> DataFrame:
    """A row for each fraction f: the frame int((size - 1) * f)."""
    df = sizes.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions))))
    return df.withColumn(out, ((F.col(size) - 1) * F.col("fraction")).cast("long"))


def constant_velocity(df: DataFrame, value: str, horizon: int, keys: Sequence[str], order: Sequence[str], frame: str = "frame", back: int = 3) -> DataFrame:
    """value + k (value - value b rows ago) / max(1, b), b = min(back, frame), for k = 1 to horizon: k and prediction."""
    w, b = episode(keys, order), F.least(F.lit(back), F.col(frame))
    past = F.col(value)
    for i in range(1, back + 1):
        past = F.when(b == i, F.lag(value, i).over(w)).otherwise(past)
    df = df.withColumn("__slope", (F.col(value) - past) / F.greatest(F.lit(1), b)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return df.withColumn("prediction", F.col(value) + F.col("k") * F.col("__slope")).drop("__slope")


def hold(df: DataFrame, value: str, size: int, keys: Sequence[str], order: Sequence[str], frame: str = "frame", out: str = "held") -> DataFrame:
    """The value at the start of each fixed window, for all its rows."""
    df = tumbling(df, frame, size, "__window")
    return df.withColumn(out, F.first(value).over(Window.partitionBy(*keys, "__window").orderBy(*order))).drop("__window")


def running_offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """new_index (rank by key) and offset (sum of the sizes before), without one task that sees all rows: sums run within ranges of keys, as many as
    there are shuffle partitions, and are shifted by what the ranges before hold."""
    kept, rows = parted(sizes, [key])
    held = {r[0]: r[1] for r in kept.groupBy("__part").agg(F.coalesce(F.sum(size), F.lit(0))).collect()}  # a row for each range
    upto = F.sum(size).over(Window.partitionBy("__part").orderBy("__nth").rowsBetween(Window.unboundedPreceding, 0))
    offset = before([held.get(k, 0) for k in range(len(rows))]) + upto - F.col(size)
    return kept.withColumn("new_index", (before(rows) + F.col("__nth")).cast("long")).withColumn("offset", offset.cast("long")).drop("__part", "__nth")


def strata(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = (), out: str = "stratum") -> DataFrame:
    """Strata of equal counts by order, the first ones larger, from 1. Without keys, of a table of any size, by its ranks."""
    if keys:
        return df.withColumn(out, F.ntile(n).over(Window.partitionBy(*keys).orderBy(*order)))
    ranked, rows = numbered(df, order, "__r"), df.count()
    size, more = rows // n, rows % n  # the first `more` strata hold one row more
    first = F.floor((F.col("__r") - 1) / (size + 1)) + 1
    rest = F.lit(more) + F.floor((F.col("__r") - 1 - more * (size + 1)) / max(1, size)) + 1
    return ranked.withColumn(out, F.when(F.col("__r") <= more * (size + 1), first).otherwise(rest).cast("int")).drop("__r")


def top_k(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)


def slots(df: DataFrame, group: str, order: Sequence[str], out: str = "slot") -> DataFrame:
    """Where a row stands, from 0, if groups are laid one after the other in their order: ranks by ranges, so a group may be of any size."""
    return numbered(df, [group, *order], out).withColumn(out, F.col(out) - 1)


def block_mask(df: DataFrame, keys: Sequence[str], position: str, starts_block: Column, valid: Column) -> DataFrame:
    """For each valid position (query): until, the last position it may attend to, and allowed, how many valid ones that are.

    A key is allowed if its block's number is at most the query's, and both are valid. Blocks are numbered along the sequence, so what a query
    may see is what is valid up to its block's end: the mask is a row for each query, not for each pair. mask_row() writes one out.
    """
    df = df.withColumn("__b", F.sum(starts_block.cast("int")).over(episode(keys, [position]))).filter(valid)
    block = Window.partitionBy(*keys, "__b")
    ranked = df.withColumn("__r", F.row_number().over(episode(keys, [position])))
    return ranked.select(*keys, F.col(position).alias("query"), F.max(position).over(block).alias("until"), F.max("__r").over(block).cast("long").alias("allowed"))


def mask_row(positions: Column, until: Column) -> Column:
    """Whether each of an array of valid positions may be attended to."""
    return F.transform(positions, lambda k: k <= until)


def previous(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], out: str = "previous") -> DataFrame:
    return df.withColumn(out, F.lag(value).over(episode(keys, order)))


def recent_delay(df: DataFrame, latency: str, rate: float, keys: Sequence[str], order: Sequence[str], recent: int = 10, out: str = "delay") -> DataFrame:
    """The most of the last `recent` latencies, in steps of 1 / rate, rounded up."""
    return df.withColumn(out, F.max(F.ceil(F.col(latency) * rate)).over(episode(keys, order).rowsBetween(1 - recent, 0)).cast("long"))
