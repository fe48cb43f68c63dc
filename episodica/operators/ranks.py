"""Ranks over whole tables and the first rows of large groups, without a task that sees a table or a group whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.durable import durable

#: Places within a part; more rows than this in one part mean too few parts.
_PLACE_BITS = 33
#: Groups up to which a table with a row for each is broadcast (some 100 bytes each).
BROADCAST_GROUPS = 50_000
#: Hex digits of a hash that tell its slice: a group falls into 16 ** SLICE_DIGITS slices of about equal size.
SLICE_DIGITS = 3


def array_of(xs: Sequence[int]) -> Column:
    """A literal array of longs as one expression, however long."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def parted(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, list[int]]:
    """df dealt by ranges of a total order and sorted within them, with __part and __nth (from 0), and the rows of each part.

    The table is written, so that parts stay what they are if a task is run again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"__k{i}": (c if isinstance(c, Column) else F.col(c)) for i, c in enumerate(order)}
    named = df.select("*", *(c.alias(k) for k, c in keys.items()))
    ranged = named.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop(*keys)
    nth = F.monotonically_increasing_id().bitwiseAND((1 << _PLACE_BITS) - 1)
    kept = durable(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__nth", nth), "parted")
    rows = {r[0]: r[1] for r in kept.groupBy("__part").count().collect()}  # a row for each part
    return kept, [rows.get(k, 0) for k in range(max(rows, default=0) + 1)]


def before(sizes: Sequence[int]) -> Column:
    """What the parts before a row's part hold."""
    sums, seen = [], 0
    for n in sizes:
        sums.append(seen)
        seen += n
    return F.element_at(array_of(sums), F.col("__part") + 1)


def numbered(df: DataFrame, order: Sequence[str | Column], out: str = "place") -> DataFrame:
    """df with its rank from 1 by a total order (ascending)."""
    kept, sizes = parted(df, order)
    return kept.withColumn(out, before(sizes) + F.col("__nth") + 1).drop("__part", "__nth")


def with_group_table(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """df joined with a table that has a row for each group, which is broadcast if it is small and else joined by a shuffle.

    groups should be durable: it is counted here.
    """
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    other = groups.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), *(c for c in groups.columns if c not in by))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & df[c].eqNullSafe(F.col(f"__g{i}"))
    return df.join(F.broadcast(other) if small else other, on).drop(*(f"__g{i}" for i in range(len(by))))


def borders(df: DataFrame, hashed: Column, by: Sequence[str], wanted: Column | DataFrame) -> DataFrame:
    """A row for each group: n, wanted (rows asked for: an expression of n, or a table of the groups with that column), border (the slice in
    which the wanted-th row by hash stands), and before (the rows of the group in slices before it). Hashes are hex; slices are their first
    digits, counted before the shuffle."""
    slice_ = F.conv(F.substring(hashed, 1, SLICE_DIGITS), 16, 10).cast("int")
    per = df.select(*by, slice_.alias("__slice")).groupBy(*by, "__slice").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__slice")  # at most 16 ** SLICE_DIGITS rows
    upto = F.sum("__n").over(w)
    per = per.withColumn("__to", upto).withColumn("n", F.sum("__n").over(Window.partitionBy(*by)))
    if isinstance(wanted, Column):
        per = per.withColumn("wanted", wanted)
    else:
        asked = wanted.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), "wanted")
        on = F.lit(True)
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
        per = per.join(asked, on).drop(*(f"__g{i}" for i in range(len(by))))
    at = F.min(F.when(F.col("__to") >= F.col("wanted"), F.struct(F.col("__slice").alias("s"), (F.col("__to") - F.col("__n")).alias("b"))))
    found = per.groupBy(*by).agg(F.first("n").alias("n"), F.first("wanted").alias("wanted"), at.alias("__at"))
    last = F.lit(16**SLICE_DIGITS)
    return durable(found.select(*by, "n", "wanted", F.coalesce("__at.s", last).alias("border"), F.coalesce("__at.b", "n").alias("before")), "borders")


def first_by_hash(df: DataFrame, hashed: Column, id_col: str, by: Sequence[str], groups: DataFrame, out: str) -> DataFrame:
    """The rows of each group that are the `wanted` first by (hash, id), with their rank. groups is of borders(): only rows up to the border
    slice are moved, a few more than are wanted."""
    slice_ = F.conv(F.substring(hashed, 1, SLICE_DIGITS), 16, 10).cast("int")
    near = with_group_table(df, groups.select(*by, "wanted", "border"), by).filter(slice_ <= F.col("border"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hashed, id_col))
    return near.withColumn(out, rank).filter(F.col(out) <= F.col("wanted")).drop("wanted", "border")


def mark_by_hash(df: DataFrame, hashed: Column, id_col: str, by: Sequence[str], groups: DataFrame, out: str) -> DataFrame:
    """All rows, `out` true for the `wanted` first of each group by (hash, id). Rows outside the border slice stay where they are."""
    joined = with_group_table(df, groups.select(*by, "wanted", "border", "before"), by)
    joined = joined.withColumn("__slice", F.conv(F.substring(hashed, 1, SLICE_DIGITS), 16, 10).cast("int"))
    sure = joined.filter(F.col("__slice") != F.col("border")).withColumn(out, F.col("__slice") < F.col("border"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hashed, id_col))
    edge = joined.filter(F.col("__slice") == F.col("border")).withColumn(out, rank + F.col("before") <= F.col("wanted"))
    return sure.unionByName(edge).drop("wanted", "border", "before", "__slice")


def suffix_least(df: DataFrame, value: Column, order: Sequence[str | Column], out: str, rank: str = "__rank", rows: str = "__rows") -> DataFrame:
    """For each row the least of value, which may use `rank` (from 1) and `rows` (of the table), over the rows from it on in a total order."""
    kept, sizes = parted(df, order)
    x = kept.withColumn(rank, before(sizes) + F.col("__nth") + 1).withColumn(rows, F.lit(sum(sizes))).withColumn("__x", value)
    least = {r[0]: r[1] for r in x.groupBy("__part").agg(F.min("__x")).collect()}  # a row for each part
    later, seen = [None] * len(sizes), None
    for k in range(len(sizes) - 1, -1, -1):
        later[k] = seen
        seen = least.get(k) if seen is None else seen if least.get(k) is None else min(seen, least[k])
    after = F.element_at(F.split(F.lit(",".join("" if v is None else repr(float(v)) for v in later)), ","), F.col("__part") + 1)
    own = F.min("__x").over(Window.partitionBy("__part").orderBy(F.desc("__nth")).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(out, F.least(own, F.when(after != "", after).cast("double"))).drop("__part", "__nth", "__x", rank, rows)
