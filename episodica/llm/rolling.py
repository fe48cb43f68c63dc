"""Counts and order statistics of trailing time windows, by an order-statistic treap for each window length.

Time is cut into cells. A row at time t counts for times in (t, t + W], so it enters the cells that this reaches: where it lies in the
past of a cell, as part of what the cell begins with; and it leaves the last of them. Both are signed counts by (stamp, length, language),
summed before they are sorted, so what a cell begins with has at most one entry for each length and language, however dense the past is. A
task streams over the cells dealt to it in order of stamps and holds one treap: lengths with their counts, subtree sizes, ranks selected
in logarithmic time. A cell depends on no other one, and what it needs of the past is bounded by its window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.llm.common import ship_package

WINDOWS = (1800, 86400)
#: Rows of one source in the longest window beyond which cells are made shorter than it, and cells in that window at most.
CELL_ROWS, MOST_CELLS = 1000, 48
OUT = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("window_s", T.LongType()), T.StructField("event_s", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_events", "sum_chars", "n_langs", "median_chars", "high_chars")]
)


class Treap:
    """A multiset of numbers: a binary search tree by number, a heap by a hash of it (so its shape depends on its contents alone), with the
    count below each node. Node 0 is none."""

    def __init__(self) -> None:
        self.key, self.heap, self.left, self.right, self.n, self.size = [0], [0], [0], [0], [0], [0]
        self.root, self.free = 0, []

    def __len__(self) -> int:
        return self.size[self.root]

    def _node(self, key: int, heap: int, n: int) -> int:
        if self.free:
            i = self.free.pop()
            self.key[i], self.heap[i], self.left[i], self.right[i], self.n[i], self.size[i] = key, heap, 0, 0, n, n
            return i
        for column, x in ((self.key, key), (self.heap, heap), (self.left, 0), (self.right, 0), (self.n, n), (self.size, n)):
            column.append(x)
        return len(self.key) - 1

    def _split(self, i: int, key: int) -> tuple[int, int]:
        """The tree below i as one of smaller and one of larger numbers; key itself is not in it."""
        if not i:
            return 0, 0
        if self.key[i] < key:
            a, b = self._split(self.right[i], key)
            self.right[i] = a
        else:
            a, b = self._split(self.left[i], key)
            self.left[i] = b
        self.size[i] = self.n[i] + self.size[self.left[i]] + self.size[self.right[i]]
        return (i, b) if self.key[i] < key else (a, i)

    def _merge(self, a: int, b: int) -> int:
        """One tree of two, the numbers of a being smaller."""
        if not a or not b:
            return a or b
        both = self.size[a] + self.size[b]
        if self.heap[a] >= self.heap[b]:
            self.right[a] = self._merge(self.right[a], b)
            top = a
        else:
            self.left[b] = self._merge(a, self.left[b])
            top = b
        self.size[top] = both
        return top

    def _hang(self, above: int, key: int, new: int) -> None:
        """Makes a tree the child of a node, or the root, on the side where key belongs."""
        if not above:
            self.root = new
        elif key < self.key[above]:
            self.left[above] = new
        else:
            self.right[above] = new

    def add(self, key: int, n: int) -> None:
        """n more of a number, or fewer if n is negative: never fewer than none."""
        keys, left, right, size = self.key, self.left, self.right, self.size
        i = self.root
        while i and keys[i] != key:
            i = left[i] if key < keys[i] else right[i]
        if not i and n <= 0:
            if n < 0:
                raise ValueError(f"{key} is not there")
            return
        found, i, above = i, self.root, 0
        heap = 0 if found else (key * 0x9E3779B97F4A7C15 ^ key >> 7) * 0xBF58476D1CE4E5B9 >> 20 & 0xFFFFFFFFFFFF
        while i != found and i and (found or self.heap[i] >= heap):
            size[i] += n
            above, i = i, left[i] if key < keys[i] else right[i]
        if found:
            self.n[found] += n
            size[found] += n
            if self.n[found] < 0:
                raise ValueError(f"fewer than none of {key}")
            if self.n[found] == 0:
                self._hang(above, key, self._merge(left[found], right[found]))
                self.free.append(found)
            return
        a, b = self._split(i, key)
        new = self._node(key, heap, n)
        self.left[new], self.right[new] = a, b
        self.size[new] = n + self.size[a] + self.size[b]
        self._hang(above, key, new)

    def select(self, rank: int) -> int:
        """The rank-th smallest number, counted from 1, repeats included."""
        left, size, i = self.left, self.size, self.root
        while True:
            below = size[left[i]]
            if rank <= below:
                i = left[i]
            elif rank <= below + self.n[i]:
                return self.key[i]
            else:
                rank -= below + self.n[i]
                i = self.right[i]


def event_time(doc_id: Column) -> Column:
    """60 * floor((doc_id + crc32(doc_id) mod 1000) / 6), exact for every long in reach."""
    x = doc_id + F.crc32(doc_id.cast("string").cast("binary")) % 1000
    return (x - F.pmod(x, F.lit(6))) * 10


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (source, window_s, cell, stamp, kind) to a row for each time asked for (kind 0); kind 1 changes the counts."""
    at, treap, langs, n, total = None, Treap(), {}, 0, 0
    for batch in batches:
        out = []
        for source, w, cell, stamp, kind, length, lang, change in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (source, w, cell):
                at, treap, langs, n, total = (source, w, cell), Treap(), {}, 0, 0
            if kind:
                n += change
                if length is not None:
                    total += length * change
                    treap.add(length, change)
                if lang is not None:
                    left = langs[lang] = langs.get(lang, 0) + change
                    if not left:
                        del langs[lang]
            else:
                m = len(treap)
                out.append((source, w, stamp, n, total, len(langs), treap.select(-(-m // 2)) if m else None, treap.select(-(-99 * m // 100)) if m else None))
        columns = zip(*out) if out else [[] for _ in OUT]
        kinds = [pa.string()] + [pa.int64()] * (len(OUT) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=OUT.names)


def cell_seconds(rows: DataFrame, longest: int) -> int:
    """Seconds of a cell: the longest window, or a part of it where the most that a source has in one is over CELL_ROWS. One number to the driver."""
    per = rows.groupBy("source", F.floor(F.col("t") / longest).alias("__w")).count()
    most = per.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return max(1, longest // min(MOST_CELLS, max(1, -(-most // CELL_ROWS))))


def window_features(rows: DataFrame, windows: Sequence[int]) -> DataFrame:
    """source, window_s, event_s and features of every (source, t) of rows (source, t, length, lang), t not null."""
    ship_package(rows.sparkSession)
    cell = cell_seconds(rows, max(windows))
    w, t = F.col("window_s"), F.col("t")
    each = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in windows))).alias("window_s")
    div = lambda c: F.floor(c / cell)
    atoms = rows.groupBy("source", "t", "length", "lang").agg(F.count("*").alias("n")).select("*", each)
    reached = atoms.withColumn("cell", F.explode(F.sequence(div(t + 1), div(t + w))))
    enters = F.struct(F.greatest(t, F.col("cell") * cell - 1).alias("stamp"), F.col("n").alias("change"))
    leaves = F.struct((t + w).alias("stamp"), (-F.col("n")).alias("change"))
    changes = F.explode(F.when(t + w < (F.col("cell") + 1) * cell - 1, F.array(enters, leaves)).otherwise(F.array(enters))).alias("__c")
    signed = reached.select("source", "window_s", "cell", changes, "length", "lang")
    signed = signed.select("source", "window_s", "cell", F.col("__c.stamp").alias("stamp"), F.lit(1).alias("kind"), "length", "lang", F.col("__c.change").alias("change"))
    keys = ["source", "window_s", "cell", "stamp", "kind", "length", "lang"]
    summed = signed.groupBy(*keys).agg(F.sum("change").alias("change")).filter("change <> 0")
    none = lambda kind: F.lit(None).cast(kind)
    asked = rows.select("source", "t").distinct().select("source", each, div(t).alias("cell"), t.alias("stamp"), F.lit(0).alias("kind"), none("long").alias("length"), none("string").alias("lang"), F.lit(0).cast("long").alias("change"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = summed.unionByName(asked).repartition(parts, "source", "window_s", "cell").sortWithinPartitions("source", "window_s", "cell", "stamp", "kind", "length", "lang")
    return dealt.mapInArrow(_sweep, OUT)


def rolling_features(docs: DataFrame, windows: Sequence[int] = WINDOWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A row for each row of docs and each window W: doc_id, window_s, event_s and features of the rows of its source in [event_s - W, event_s).

    n_events counts rows, sum_chars adds their lengths in code points, n_langs counts their different languages; median_chars and high_chars
    are the lengths at ranks ceil(m / 2) and ceil(99 m / 100) of the m that are not null, ascending with repeats; null if there are none.
    A row's time is event_time() of its id; its own time's rows are not in its window. A null text has no length, an empty one 0; null is
    one source. Rows that repeat an id or all columns count each and are returned each. A row with a null id has no time: it is in no window
    and its own are empty. Other columns are ignored, whatever their names; an empty table gives no rows.

    A time's rows are counted together and features are computed for each (source, time), then joined with the rows by a sort-merge join:
    no hot time group is gathered, nothing is broadcast, and only the length of a cell goes to the driver.
    """
    id_, source = F.col(id_col).cast("long"), F.col(source_col).cast("string")
    timed = docs.select(source.alias("source"), event_time(id_).alias("t"), F.length(F.col(text_col).cast("string")).cast("long").alias("length"), F.col(lang_col).cast("string").alias("lang"))
    found = window_features(timed.filter("t is not null"), windows)
    found = found.select(F.col("source").alias("__s"), F.col("window_s").alias("__w"), F.col("event_s").alias("__t"), *OUT.names[3:]).hint("merge")
    each = F.explode(F.array(*(F.lit(int(x)).cast("long") for x in windows))).alias("window_s")
    rows = docs.select(F.col(id_col).alias("__id"), source.alias("source"), event_time(id_).alias("event_s"), each)
    same = rows["source"].eqNullSafe(found["__s"]) & (F.col("window_s") == F.col("__w")) & (F.col("event_s") == F.col("__t"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_events", "sum_chars", "n_langs")]
    return rows.join(found, same, "left").select(F.col("__id").alias("doc_id"), "window_s", "event_s", *counts, "median_chars", "high_chars")
