"""Best-fit packing planned over the histogram of lengths.

Best-fit decreasing needs only how many pieces have each length: pieces of one length are alike, and bins that are equally full are alike. The
plan is made over at most `capacity` counts on the driver; each piece then takes the planned slot of its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.llm.common import durable, ship_package, tidy
from episodica.llm.tokens import VOCABULARY, coder, text_slices

CAPACITY, END_ID = 2048, 0
_RANK_BITS = 48


def plan_slots(histogram: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts: rows (length, first rank, bins' first id, offset in the bin, pieces a bin takes), by length and rank.

    The piece of rank k of a length belongs to the last row with first rank <= k; with j = k - first rank it goes into bin first id + j // q
    at offset + (j % q) * length. Pieces of one length go one after another into the fullest bin that still has room, as best-fit does: a
    bin that took one is the fullest still, until it has no room. Each length cuts at most two runs of bins, so the number of runs is at most
    twice that of lengths, and the plan has at most the square of that many rows, whatever the number of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: runs of bins (first id, how many)
    plan, bins = [], 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        left, rank = histogram[length], 0
        for room in sorted(r for r in free if r >= length):
            runs, keep, q = free.pop(room), [], room // length
            for k, (first, n) in enumerate(runs):
                full = min(n, left // q)
                if full:
                    plan.append((length, rank, first, capacity - room, q))
                    rank, left = rank + full * q, left - full * q
                    free.setdefault(room - q * length, []).append((first, full))
                if full < n and left:  # fewer than q are left
                    plan.append((length, rank, first + full, capacity - room, left))
                    free.setdefault(room - left * length, []).append((first + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    keep.append((first + full, n - full))
                if not left:
                    keep += runs[k + 1 :]
                    break
            if keep:
                free.setdefault(room, []).extend(keep)
            if not left:
                break
        if left:
            q = capacity // length
            full, rest = divmod(left, q)
            plan.append((length, rank, bins, 0, q))
            if full:
                free.setdefault(capacity - q * length, []).append((bins, full))
            if rest:
                free.setdefault(capacity - rest * length, []).append((bins + full, 1))
            bins += full + bool(rest)
        free.pop(0, None)
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def take_slots(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces of these lengths and ranks."""
    row = np.searchsorted((plan[:, 0] << _RANK_BITS) + plan[:, 1], (length << _RANK_BITS) + rank, side="right") - 1
    _, start, first, offset, q = plan[row].T
    j = rank - start
    return first + j // q, offset + (j % q) * length


def cuts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of these sizes cut into pieces of capacity: each piece's row, number in the row, start and length."""
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    return row, piece, start, np.minimum(sizes[row] - start, capacity)


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of rows that end at these places, end_id after each row's, as little-endian 32-bit numbers."""
    out = np.empty(len(ids) + len(ends) - 1, "<u4")
    after = ends[1:] + np.arange(len(ends) - 1)
    own = np.ones(len(out), bool)
    own[after] = False
    out[own], out[after] = ids, end_id
    return out


def ranks(values: np.ndarray) -> np.ndarray:
    """How many of the same value stand before each value."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.searchsorted(ordered, ordered, side="left")
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - first
    return out


def token_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every row's ids, numbered within (part, length): part is the task that made them."""
    ship_package(docs.sparkSession)
    fields = [(id_col, docs.schema[id_col].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("nth", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = coder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                x = c.code(texts)
                ends = np.concatenate([[0], np.cumsum(x.lens[x.index])])[np.concatenate([[0], np.cumsum(x.n)])]
                ids = x.all_ids()
                row, piece, start, length = cuts(np.diff(ends) + 1, capacity)
                flat = with_ends(ids, ends, end_id)
                at = (ends[:-1] + np.arange(len(texts)))[row] + start  # each row before adds its end_id
                crc = [zlib.crc32(flat[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                nth = seen[length] + ranks(length)
                seen += np.bincount(length, minlength=capacity + 1)
                cols = [batch.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), *(pa.array(v, pa.int64()) for v in (start, length, crc)), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            tidy()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs the ids of every row, end_id after each, into few sequences of at most capacity ids; only longer rows are cut.

    Returns a row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset, part. A null or empty text is the end_id alone.
    Repeated and null ids are rows of their own; other columns are ignored; an empty table gives no rows. Ranks within a length are the
    order within a task plus what earlier tasks have of that length, so neither a length nor an id that holds much of the table is gathered
    in one task, and no texts or ids are shuffled.
    """
    spark = docs.sparkSession
    pieces = durable(token_pieces(docs, capacity, end_id, vocabulary, id_col, text_col), "pack-pieces")
    counts = durable(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    plan = plan_slots({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    shifts = counts.select("length", "part", before.alias("before"))
    ranked = pieces.join(shifts.hint("merge"), ["length", "part"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"), "part")
    shared = spark.sparkContext.broadcast(plan)
    schema = T.StructType([*(ranked.schema[n] for n in (id_col, "piece", "start", "length", "ids_crc32")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), ranked.schema["part"]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                bins, offsets = take_slots(shared.value, *(at[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank")))
                yield pa.RecordBatch.from_arrays([*(at[n] for n in schema.names[:5]), pa.array(bins), pa.array(offsets), at["part"]], names=schema.names)

    return ranked.mapInArrow(place, schema)
