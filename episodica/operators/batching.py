"""Batches of token samples: by budget, by count, padded, packed, sharded."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.durable import durable
from episodica.functions import vectors as V
from episodica.functions.text import IGNORED
from episodica.operators.ranks import parted
from episodica.shipping import ship_package


class BudgetBuffer:
    """Samples in order of arrival; take() scans them and takes each that still fits the budget, the first in any case if forced."""

    def __init__(self, items: list[tuple[int, int]] | None = None):
        self.items = items or []
        self.total = sum(n for _, n in self.items)

    def add(self, id_: int, length: int) -> None:
        self.items.append((id_, length))
        self.total += length

    def tokens(self) -> int:
        return self.total

    def take(self, budget: int, force: bool = True) -> list[tuple[int, int]]:
        """An empty buffer, or one with nothing that fits, gives an empty batch."""
        used, taken, left = 0, [], []
        for i, (id_, n) in enumerate(self.items):
            if used >= budget:
                left += self.items[i:]
                break
            if used + n <= budget or (force and not taken):
                taken.append((id_, n))
                used += n
            else:
                left.append((id_, n))
        self.items = left
        self.total -= used
        return taken

    def ready(self, buffer_size: int, budget: int) -> bool:
        return len(self.items) >= buffer_size and self.tokens() >= budget


def usable(samples: DataFrame, ids: str) -> DataFrame:
    """Without samples of one token or of zeros alone."""
    return samples.filter((F.size(ids) != 1) & F.exists(ids, lambda x: x != 0))


def _in_order(samples: DataFrame, keys: Sequence[str], id_col: str, size: str) -> DataFrame:
    """Keys, ids and sizes, each key in one partition and in the order of ids."""
    light = samples.select(*keys, F.col(id_col).cast("long").alias(id_col), F.col(size).cast("long").alias(size))
    return light.repartition(*keys).sortWithinPartitions(*keys, id_col)


class BatchingStrategy(Protocol):
    """What decides which samples make a batch. BudgetBuffer is one; packed_by_budget takes any."""

    items: list[tuple[int, int]]

    def add(self, id_: int, length: int) -> None: ...

    def take(self, budget: int) -> list[tuple[int, int]]: ...

    def ready(self, buffer_size: int, budget: int) -> bool: ...


def packed_by_budget(
    samples: DataFrame, id_col: str, length: str, shard: str, budget: int, buffer_size: int, strategy: Callable[[], BatchingStrategy] = BudgetBuffer
) -> DataFrame:
    """shard, batch, place, id, length: greedy batches of at most `budget` tokens from a buffer of buffer_size samples, in id order by shard.

    Which sample is next depends on all before it, so a shard is one sequential task; shards are the caller's and as many as wanted. The
    rest of a shard is flushed at its end. A task streams over its sorted ids and lengths and holds the buffer alone.
    """
    schema = T.StructType([samples.schema[shard], T.StructField("batch", T.LongType()), T.StructField("place", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField(length, T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer, batch, key, begun, out = strategy(), 0, None, False, []

        def emit() -> None:
            nonlocal batch
            out.extend((key, batch, k, i, n) for k, (i, n) in enumerate(buffer.take(budget)))
            batch += 1

        for pdf in frames:
            for own, i, n in zip(pdf[shard].tolist(), pdf[id_col].tolist(), pdf[length].tolist(), strict=True):
                if begun and not _same(own, key):
                    while buffer.items:
                        emit()
                    batch = 0
                key, begun = own, True
                buffer.add(i, n)
                while buffer.ready(buffer_size, budget):
                    emit()
            yield pd.DataFrame(out, columns=schema.names)
            out.clear()
        while buffer.items:
            emit()
        yield pd.DataFrame(out, columns=schema.names)

    return _in_order(samples, [shard], id_col, length).mapInPandas(run, schema)


def dynamic_batches(
    samples: DataFrame, id_col: str, length: str, shard: str, budget: int, buffer_size: int, micro_batches: int, steps: int, drop_last: bool = False
) -> DataFrame:
    """shard, step, micro_batch, place, id, length, padding_flag: `steps` steps of `micro_batches` greedy batches each, by shard.

    A shard that ends before has its samples again, the buffer going on. With no steps asked for (0), what is in the buffer at the end is flushed
    unless drop_last, and a last step is filled up with copies of the last batch, which carry the padding flag. A task holds the ids and
    lengths of one shard, which are the caller's and as many as wanted.
    """
    schema = T.StructType([
        samples.schema[shard], T.StructField("step", T.LongType()), T.StructField("micro_batch", T.LongType()), T.StructField("place", T.LongType()),
        T.StructField(id_col, T.LongType()), T.StructField(length, T.LongType()), T.StructField("padding_flag", T.BooleanType()),
    ])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from episodica.operators.batching import planned_steps

        pdf = pdf.sort_values([id_col, length])
        items = list(zip(pdf[id_col].tolist(), pdf[length].tolist(), strict=True))
        rows = [(pdf[shard].iloc[0], *r) for r in planned_steps(items, budget, buffer_size, micro_batches, steps, drop_last)]
        return pd.DataFrame(rows, columns=schema.names)

    light = samples.select(shard, F.col(id_col).cast("long").alias(id_col), F.col(length).cast("long").alias(length))
    return light.groupBy(shard).applyInPandas(run, schema)


def planned_steps(items: list[tuple[int, int]], budget: int, buffer_size: int, micro_batches: int, steps: int, drop_last: bool) -> Iterator[tuple]:
    """(step, micro_batch, place, id, length, padding_flag) of one shard's samples in order."""
    buffer, made, step, latest = BudgetBuffer(), [], 0, []

    def take() -> Iterator[tuple]:
        nonlocal latest
        latest = buffer.take(budget)
        made.append(latest)
        if len(made) == micro_batches:
            yield from finished()

    def finished() -> Iterator[tuple]:
        nonlocal made, step
        for m in range(micro_batches):
            batch = made[m] if m < len(made) else latest
            yield from ((step, m, k, i, n, m >= len(made)) for k, (i, n) in enumerate(batch))
        made, step = [], step + 1

    while items:
        for item in [*items, None]:  # a batch is looked for before each sample, and before the end is seen
            if buffer.ready(buffer_size, budget):
                yield from take()
                if steps and step >= steps:
                    return
            if item:
                buffer.add(*item)
        if step >= steps:
            break
    if buffer.items and not drop_last:
        while buffer.items:
            yield from take()
        yield from finished()


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def next_starts(upto: np.ndarray, limit: int) -> np.ndarray:
    """upto: running sums of sizes, from 0. For each item, if a bin starts with it, the item that starts the next one; the number of items if none."""
    m = len(upto) - 1
    k = np.searchsorted(upto, upto[:m] + limit, side="right") - 1  # items up to k - 1 fit
    return np.minimum(np.where(upto[k] > upto[:m], k, k + 1), m)  # a bin of nothing but zeros takes whatever comes


def _entries(upto: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int]]:
    """What a run of items makes of the bin in use before it, by where the first bin of its own starts: runs of starts with one outcome, as their
    first starts, the number of bins, and what the last one holds. Only starts that a bin in use can lead to are listed."""
    m = len(upto) - 1
    hop = next_starts(upto, limit)
    at = np.where(hop < m, hop, np.arange(m))  # the last start stays
    more = (hop < m).astype(np.int64)
    while not np.array_equal(at[at], at):
        more, at = more + more[at], at[at]
    most = min(m, int(np.searchsorted(upto, limit, side="right")) + 1)
    bins, rest = more[:most] + 1, upto[m] - upto[at[:most]]
    new = np.flatnonzero(np.append(True, (np.diff(bins) != 0) | (np.diff(rest) != 0))[:most])
    return new.tolist(), bins[new].tolist(), rest[new].tolist()


def next_fit(samples: DataFrame, id_col: str, size: str, keys: Sequence[str], limit: int) -> DataFrame:
    """keys, id and bin: sequential bins by id without skipping, a new one where the sum would pass the limit and is not 0. Null sizes count as 0.

    Rows are dealt by ranges of (keys, id), so a key may be of any length. Where a bin ends is known from where it starts, by the running sums; so
    a range that begins within a key is summed up as what it makes of each bin that may be in use before it, by doubling these pointers.
    The driver follows the bin in use over those ranges, one summary at a time, and each range then deals out its bins by itself: a task
    streams over its rows. No keys: the table is one sequence.
    """
    ship_package(samples.sparkSession)
    keys = list(keys)
    light = samples.select(*keys, id_col, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"))
    kept, _ = parted(light, [*keys, id_col, "__size"])
    counts = kept.groupBy(*keys, "__part").agg(F.sum("__size").alias("__total"))
    several = F.count("*").over(Window.partitionBy(*keys)) if keys else F.count("*").over(Window.partitionBy(F.lit(1)))
    spanning = durable(counts.withColumn("__c", several).filter("__c > 1").drop("__c", "__total"), "next-fit")  # at most two rows to a part
    named = spanning.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    same = lambda other: functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)], F.col("__part") == other["__p"])
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("upto", "bins", "rest")]
    schema = T.StructType([*(T.StructField(f"__k{i}", kept.schema[k].dataType) for i, k in enumerate(keys)), T.StructField("__p", T.IntegerType()), *lists, T.StructField("total", T.LongType())])
    columns = [*keys, "__part", id_col, "__size"]

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        from episodica.operators.batching import _entries

        pdf = pdf.sort_values([id_col, "__size"])
        upto = np.concatenate([[0], np.cumsum(pdf["__size"].to_numpy(np.int64))])
        starts, bins, rest = _entries(upto, limit)
        own = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([[*own, int(pdf["__part"].iloc[0]), upto[starts].tolist(), bins, rest, int(upto[-1])]], columns=schema.names)

    within = kept.join(F.broadcast(named), same(named), "left_semi").select(*columns)
    summaries = durable(within.groupBy(*keys, "__part").applyInPandas(summary, schema), "next-fit")
    entries, at, used, bins = [], None, None, 0
    for r in summaries.orderBy(*(f"__k{i}" for i in range(len(keys))), "__p").toLocalIterator():
        own = [r[f"__k{i}"] for i in range(len(keys))]
        if at is None or not all(map(_same, own, at)):
            at, used, bins = own, None, 0
        entries.append((*own, r["__p"], used, bins))
        found = _follow(r["upto"], r["bins"], r["rest"], r["total"], used, limit)
        used, bins = found[0], bins + found[1]
    fields = [*schema.fields[: len(keys) + 1], T.StructField("__used", T.LongType()), T.StructField("__bins", T.LongType())]
    begun = samples.sparkSession.createDataFrame(entries, T.StructType(fields))
    rows = kept.join(F.broadcast(begun), same(begun), "left").select(*columns, "__used", F.coalesce("__bins", F.lit(0)).alias("__bins"))
    out = T.StructType([*(samples.schema[k] for k in keys), T.StructField(id_col, samples.schema[id_col].dataType), T.StructField("bin", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from episodica.operators.batching import _same

        key, used, place = None, 0, 0
        for pdf in frames:
            places = []
            for *own, n, before, bins in zip(*(pdf[k].tolist() for k in [*keys, "__part"]), pdf["__size"].tolist(), pdf["__used"].tolist(), pdf["__bins"].tolist(), strict=True):
                if key is None or not all(map(_same, own, key)):
                    key, used, place = own, 0 if pd.isna(before) else before, bins - (0 if pd.isna(before) else 1)
                if used and used + n > limit:
                    used, place = 0, place + 1
                used += n
                places.append(int(place))
            yield pdf[[*keys, id_col]].assign(bin=places)

    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "__part", *keys).sortWithinPartitions("__part", *keys, id_col, "__size")
    return dealt.mapInPandas(run, out)


def _follow(upto: list[int], bins: list[int], rest: list[int], total: int, used: int | None, limit: int) -> tuple[int, int]:
    """What the bin in use holds after a run of items, and how many bins the run starts, from its summary. One in use that holds 0 goes on as a
    new one would; none in use (None) begins with the run."""
    if not used:
        return rest[0], bins[0] - (used is not None)
    if used + total <= limit:
        return used + total, 0
    k = max(0, int(np.searchsorted(upto, limit - used, side="right")) - 1)
    return rest[k], bins[k]


def micro_batches(samples: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, out: str = "micro_batch") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return samples.withColumn(out, F.floor(rank / size).cast("long"))


def pad_collated(samples: DataFrame, batch: str, ids: str, labels: str) -> DataFrame:
    """Vectors padded to the batch's longest: ids and mask with 0, labels with the ignored label."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    df = samples.withColumn("__n", longest)
    mask = F.transform(F.sequence(F.lit(1), F.greatest("__n", F.lit(1))), lambda i: (i <= F.size(ids)).cast("int"))
    df = df.withColumn("attention_mask", mask).withColumn(labels, V.pad_right(F.col(labels), F.col("__n"), F.lit(IGNORED)))
    return df.withColumn(ids, V.pad_right(F.col(ids), F.col("__n"), F.lit(0))).drop("__n")


def packed(samples: DataFrame, batch: str, order: str, ids: str, labels: str) -> DataFrame:
    """A row for each batch: ids and labels one after the other, position ids, cumulative lengths. Labels of later samples begin ignored."""
    first = lambda x, is_first: F.transform(x, lambda v, i: F.when((i == 0) & ~is_first, F.lit(IGNORED)).otherwise(v))
    rows = samples.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), F.col(labels).alias("l")))).alias("__s"))
    lengths = F.transform("__s", lambda s: F.size(s["i"]))
    return rows.select(
        batch, F.flatten(F.transform("__s", lambda s: s["i"])).alias(ids), F.flatten(F.transform("__s", lambda s, k: first(s["l"], k == 0))).alias(labels),
        V.position_ids(lengths).alias("position_ids"), V.cumulative_lengths(lengths).alias("cu_seqlens"),
    )


def sequence_shards(rows: DataFrame, ids: str, labels: str, n_ranks: int, cu_seqlens: str | None = None, positions: str | None = None) -> DataFrame:
    """A row for each rank: its slices of ids, of labels moved left by one, and of positions, padded to a multiple of the ranks.

    With cumulative lengths, the label at the end of each sequence is ignored: it would be the next sequence's first.
    """
    from episodica.functions.text import shifted

    ends = None if cu_seqlens is None else F.transform(F.col(cu_seqlens), lambda c: (c - 1).cast("int"))
    df = rows.withColumn("__i", V.multiple_padded(F.col(ids), n_ranks, F.lit(0))).withColumn("__l", V.multiple_padded(shifted(F.col(labels), ends), n_ranks, F.lit(IGNORED)))
    if positions:
        df = df.withColumn("__p", V.multiple_padded(F.col(positions), n_ranks, F.lit(0)))
    df = df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(n_ranks - 1))))
    for name, full in ((ids, "__i"), (labels, "__l"), *([(positions, "__p")] if positions else [])):
        df = df.withColumn(name, V.shard_of(F.col(full), F.col("rank"), n_ranks)).drop(full)
    return df


def stacked(samples: DataFrame, batch: str, order: str, columns: Sequence[str]) -> DataFrame:
    """A row for each batch with the samples' columns as arrays, in order; a sample's null is null in its place."""
    rows = samples.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), *columns))).alias("__s"), F.count("*").alias("samples"))
    of = lambda c: F.transform("__s", lambda s: s[c]).alias(c)
    return rows.select(batch, "samples", *map(of, columns))
