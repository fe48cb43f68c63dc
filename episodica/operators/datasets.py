"""Building datasets: merge with schema and task checks, re-indexing, filters with reasons, cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.operators.ranks import numbered
from episodica.operators.windows import running_offsets


def schema_differences(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that are missing from b, extra in b, or of another type there."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"missing": sorted(x.keys() - y.keys()), "extra": sorted(y.keys() - x.keys()), "changed": sorted(k for k in x.keys() & y.keys() if x[k] != y[k])}


def same_schema(*dfs: DataFrame) -> None:
    """Raises where schemas differ: types are never coerced."""
    for other in dfs[1:]:
        if any((found := schema_differences(dfs[0], other)).values()):
            raise ValueError(f"schemas differ: {found}")


def rates_differ(info: DataFrame, fps: str = "fps") -> DataFrame:
    """One row: whether the sources' frame rates differ, and how many there are."""
    return info.agg(F.countDistinct(fps).alias("rates")).withColumn("differ", F.col("rates") > 1)


def merged_tasks(tasks: DataFrame, source: str, index: str, text: str) -> DataFrame:
    """source, index and new_index: tasks of one text share an index, in the order of first (source, index)."""
    first = tasks.groupBy(text).agg(F.min(F.struct(source, index)).alias("__first"))
    ranked = numbered(first, ["__first"], "new_index").select(text, (F.col("new_index") - 1).alias("new_index"))
    return tasks.join(ranked, text)


def reindexed(episodes: DataFrame, key: str, size: str, order_cols: Sequence[str] = ()) -> DataFrame:
    """new_index, from_index and to_index: contiguous ids and offsets in the order of key."""
    out = running_offsets(episodes, key, size)
    return out.withColumnRenamed("offset", "from_index").withColumn("to_index", F.col("from_index") + F.col(size))


def remap_frames(frames: DataFrame, episodes: DataFrame, key: str, frame: str) -> DataFrame:
    """episode_index and index of the frames, rewritten by the new numbers of their episodes."""
    m = episodes.select(F.col(key).alias("__k"), "new_index", "from_index")
    out = frames.join(m, F.col(key) == F.col("__k")).drop("__k")
    return out.withColumn("episode_index", F.col("new_index")).withColumn("index", F.col("from_index") + F.col(frame)).drop("new_index", "from_index")


def without_regrasp(df: DataFrame, flag: Column, default: int = 0) -> DataFrame:
    """Rows whose flag is 0; a missing flag counts as `default`, which callers choose."""
    return df.filter(F.coalesce(flag, F.lit(default)) == 0)


def reasons(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """The first rule, in order, that a row breaks; null for an eligible row. A rule is true where it is broken; null is not."""
    expr = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        expr = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(expr)
    return df.withColumn(out, expr)


def split_eligible(df: DataFrame, rules: Sequence[tuple[str, Column]], train: DataFrame, key: str, out: str = "reason") -> DataFrame:
    """As reasons, with `train_episode` first for rows whose key is among the training ones: these may not be evaluated."""
    flags = train.select(F.col(key).alias("__k"), F.lit(True).alias("__train")).distinct()
    marked = df.join(flags, F.col(key) == F.col("__k"), "left")
    return reasons(marked, [("train_episode", F.col("__train")), *rules], out).drop("__k", "__train")


def blockers(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "blockers") -> DataFrame:
    """All rules that a row breaks, and eligible: whether there are none."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(b, F.lit(False)), F.lit(n)) for n, b in rules)))
    return df.withColumn(out, hits).withColumn("eligible", F.size(out) == 0)


def allowed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def denied(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def with_unmatched(df: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """df with the other's value, null and `unmatched` true where the other has no such key."""
    right = other.select(key, value, F.lit(True).alias("__has"))
    return df.join(right, key, "left").withColumn("unmatched", F.col("__has").isNull()).drop("__has")


def key_mismatches(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that are not in all tables, and in which they are."""
    rows = None
    for name, df in tables.items():
        one = df.select(key).distinct().withColumn("__in", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    found = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("__in")), ",").alias("present"), F.count("*").alias("__n"))
    return found.filter(F.col("__n") < len(tables)).drop("__n")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def partition_check(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row: keys in several parts, keys in no part, keys that are not in the whole. All 0 for a proper split."""
    rows = None
    for name, df in parts.items():
        one = df.select(F.col(key).alias("k"), F.lit(name).alias("p"))
        rows = one if rows is None else rows.unionByName(one)
    per = rows.distinct().groupBy("k").agg(F.count("*").alias("n"))
    both = per.join(whole.select(F.col(key).alias("k"), F.lit(True).alias("w")).distinct(), "k", "full")
    return both.agg(F.count_if(F.col("n") > 1).alias("in_several"), F.count_if(F.col("n").isNull()).alias("in_none"), F.count_if(F.col("w").isNull()).alias("unknown"))


def task_prompt(label: Column, up: str, down: str, otherwise: Column) -> Column:
    return F.when(label, F.lit(up)).when(~label, F.lit(down)).otherwise(otherwise)


def quarantined(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and the others: nothing is replaced at random, and nothing is lost. null is not good."""
    flag = F.coalesce(good, F.lit(False))
    return df.filter(flag), df.filter(~flag)


def merged(sources: dict[str, tuple[DataFrame, DataFrame]], key: str, frame: str, size: str) -> tuple[DataFrame, DataFrame]:
    """(episodes, frames) of several sources as one dataset: schemas are checked, episodes get contiguous numbers and offsets in the order of the
    sources' names and their own keys, frames follow. Stats and tasks are merged by weighted_stats and merged_tasks.
    """
    names = sorted(sources)
    same_schema(*(sources[n][0] for n in names))
    same_schema(*(sources[n][1] for n in names))
    episodes = frames = None
    for n in names:
        e, f = (x.withColumn("source", F.lit(n)) for x in sources[n])
        episodes, frames = (e, f) if episodes is None else (episodes.unionByName(e), frames.unionByName(f))
    placed = reindexed(numbered(episodes, ["source", key], "__key"), "__key", size).drop("__key")
    m = placed.select("source", F.col(key).alias("__k"), "new_index", "from_index")
    out = frames.join(m, (frames["source"] == m["source"]) & (frames[key] == m["__k"])).drop(m["source"]).drop("__k")
    return placed, out.withColumn("episode_index", F.col("new_index")).withColumn("index", F.col("from_index") + F.col(frame)).drop("new_index", "from_index")
