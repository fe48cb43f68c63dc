"""Splits and samples by hash order: the same rows on any engine and any number of machines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.ranks import borders, first_by_hash, mark_by_hash, numbered


def hash_order(id_: Column, seed: int) -> Column:
    """md5 of id|seed: sorts rows at random, alike in every engine."""
    return F.md5(F.concat(id_.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def split(df: DataFrame, id_col: str, group: Sequence[str], share: float, seed: int, out: str = "is_test") -> DataFrame:
    """A share of each group, rounded half to even, is test. A group of any size is split where it is read, but for a slice of its hashes."""
    h = hash_order(F.col(id_col), seed)
    groups = borders(df, h, group, F.bround(F.col("n") * F.lit(share)).cast("long"))
    return mark_by_hash(df, h, id_col, group, groups, out)


def quotas(df: DataFrame, group: Sequence[str], total: Column) -> DataFrame:
    """Rows of `total` that each group gets by largest remainders; ties go to the group that sorts first. A row for each group."""
    n = df.groupBy(*group).agg(F.count("*").alias("n"))
    everything = n.agg(F.sum("n").alias("__all"))
    exact = n.crossJoin(F.broadcast(everything)).withColumn("__total", total).withColumn("__x", F.col("__total") * F.col("n") / F.col("__all"))
    base = exact.withColumn("__base", F.floor("__x")).withColumn("__rem", F.round(F.col("__x") - F.col("__base"), 9))
    left = F.col("__total") - F.sum("__base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("__rem"), *group))
    return base.withColumn("quota", (F.col("__base") + F.when(rank <= left, 1).otherwise(0)).cast("long")).select(*group, "n", "quota")


def _asked(df: DataFrame, group: Sequence[str], total: Column) -> DataFrame:
    return quotas(df, group, total).select(*group, F.col("quota").alias("wanted"))


def stratified_split(df: DataFrame, id_col: str, group: Sequence[str], share: float, seed: int, out: str = "is_test") -> DataFrame:
    """round(all * share) rows are test, dealt to the groups by largest remainders."""
    h = hash_order(F.col(id_col), seed)
    groups = borders(df, h, group, _asked(df, group, F.bround(F.col("__all") * F.lit(share))))
    return mark_by_hash(df, h, id_col, group, groups, out)


def stratified_sample(df: DataFrame, id_col: str, group: Sequence[str], size: int, seed: int) -> DataFrame:
    """size rows, dealt to the groups by largest remainders."""
    h = hash_order(F.col(id_col), seed)
    return first_by_hash(df, h, id_col, group, borders(df, h, group, _asked(df, group, F.lit(size))), "__r").drop("__r")


def balanced_sample(df: DataFrame, id_col: str, group: Sequence[str], k: int, seed: int, out: str = "rank") -> DataFrame:
    """k rows of each group, numbered."""
    h = hash_order(F.col(id_col), seed)
    return first_by_hash(df, h, id_col, group, borders(df, h, group, F.lit(k).cast("long")), out)


def interleaved(ranked: DataFrame, rank: str, group: str) -> DataFrame:
    """Rows of groups by turns: the first of each, then the second of each."""
    return ranked.orderBy(rank, group)


def batches(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """Rows in hash order, numbered from 0, in batches of `size`."""
    out = numbered(df, [hash_order(F.col(id_col), seed), id_col], "position").withColumn("position", F.col("position") - 1)
    return out.withColumn("batch", F.floor(F.col("position") / size).cast("long"))


def without_batches_of(batched: DataFrame, bad: Column) -> DataFrame:
    """Rows of batches that hold no bad row."""
    flagged = batched.groupBy("batch").agg(F.bool_or(bad).alias("__bad")).filter("not __bad").select("batch")
    return batched.join(flagged, "batch", "left_semi")


def shard(df: DataFrame, id_col: str, rank: int, n_ranks: int) -> DataFrame:
    """The rank's rows, by a hash of the id that both engines have."""
    return df.filter(F.pmod(F.col(id_col) * F.lit(2654435761) + 42, F.lit(4294967296)) % n_ranks == rank)


def hash_shuffle(df: DataFrame, id_col: str, seed: int, out: str = "place") -> DataFrame:
    """All rows with their place, from 1, in hash order."""
    return numbered(df, [hash_order(F.col(id_col), seed), id_col], out)
