"""Sharding by sampled splitters.

Keys are drawn with chances proportional to size, quantile boundaries are chosen among them, records are partitioned into ranges between
boundaries, and overfull ranges are subdivided by a denser sample of their own. Exact sums by range then place the shard cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import durable, longs, md5_long, range_of

#: Ranges for each shard, keys drawn for each range, and the multiple of the mean from which a range counts as overfull.
RANGES_PER_SHARD, KEYS_PER_RANGE, OVERFULL, ROUNDS = 8, 32, 1.5, 3
#: A shard's bytes need not fit in a task, a range's light rows must: the number of ranges grows with the rows up to MOST_RANGES.
ROWS_PER_RANGE, MOST_RANGES = 2_000_000, 16_384

Key = tuple[int, int, int]


def _range_of(splitters: list[Key]) -> Column:
    """How many splitters are at most the key (a, b, c)."""
    parts = [longs([k[i] for k in splitters]) for i in range(3)]

    def at_most(i: Column) -> Column:
        x, y, z = (F.get(p, i.cast("int")) for p in parts)
        return (x < F.col("a")) | ((x == F.col("a")) & ((y < F.col("b")) | ((y == F.col("b")) & (z <= F.col("c")))))

    return range_of(len(splitters), at_most)


def boundaries(drawn: list[tuple[Key, int]], n: int) -> list[Key]:
    """n - 1 keys that cut the drawn weight into n parts, fewer if keys repeat."""
    drawn = sorted(drawn)
    total, seen, out = sum(w for _, w in drawn), 0, []
    for key, w in drawn:
        if seen and seen + w < total and seen * n // total != (seen + w) * n // total and (not out or out[-1] != key):
            out.append(key)
        seen += w
    return out


def draw(rows: DataFrame, rate: float, salt: int) -> list[tuple[Key, int]]:
    """A key comes floor(size * rate + u) times, u uniform by hash: sum(size) * rate times in all, so the driver gets a bounded list."""
    u = F.pmod(F.xxhash64("a", "b", "c", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    hits = F.floor(F.col("size") * F.lit(rate) + u).cast("long")
    return [((r.a, r.b, r.c), r.hits) for r in rows.select("a", "b", "c", hits.alias("hits")).filter("hits > 0").collect()]


def shard_by_size(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into one of n_shards shards of nearly equal bytes (UTF-8 bytes of the text plus 8).

    Rows are ordered by (60 bits of the text's md5, id), so equal texts are neighbours and share a shard unless a cut falls among them; a
    group that holds much of the table is spread over several shards. A cut falls where a row's middle passes a multiple of total / n, so
    a shard differs from total / n by less than the largest row's size.

    Returns id, size, text_crc32, law, shard, slot (position in the shard from 0), grown_shard (null: the law is `bytes`). A null text has
    size 8 and a null checksum, an empty one size 8 and checksum 0; null ids sort first; equal rows get slots of their own; an empty table
    gives an empty result. Other columns are ignored. Only ids, sizes, checksums and hashes are shuffled, never texts.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    light = durable(
        docs.select(
            id_.alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.coalesce(md5_long(text), F.lit(-1)).alias("a"),
            F.coalesce(id_, F.lit(-(1 << 63)).cast("long")).alias("b"),
            F.xxhash64(F.monotonically_increasing_id()).alias("c"),  # tells equal rows apart; fixed by the write
        ),
        "shard-light",
    )
    total, rows = light.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    splitters: list[Key] = []
    n_ranges = min(MOST_RANGES, max(n_shards * RANGES_PER_SHARD, -(-rows // ROWS_PER_RANGE)))
    if rows:
        splitters = boundaries(draw(light, n_ranges * KEYS_PER_RANGE / total, 0), n_ranges)
    for attempt in range(ROUNDS):
        ranged = light.withColumn("range", _range_of(splitters).cast("int"))
        sums = {r.range: (r.bytes, r.rows) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        over = [k for k, (b, n) in sums.items() if n > 1 and b > OVERFULL * total / n_ranges]
        if not over or attempt == ROUNDS - 1:
            break
        drawn = draw(ranged.filter(F.col("range").isin(over)), n_ranges * KEYS_PER_RANGE * 4 / total, attempt + 1)
        more = set(splitters)
        for k in over:
            lo, hi = splitters[k - 1] if k else None, splitters[k] if k < len(splitters) else None
            own = [(x, w) for x, w in drawn if (lo is None or x >= lo) and (hi is None or x < hi)]
            if own:
                more.update(boundaries(own, -(-int(sums[k][0] * n_ranges) // total) + 1))
        if len(more) == len(splitters):
            break
        splitters = sorted(more)

    before_b, before_n, b, n = [], [], 0, 0
    for k in range(len(splitters) + 1):
        before_b.append(b)
        before_n.append(n)
        b, n = b + sums.get(k, (0, 0))[0], n + sums.get(k, (0, 0))[1]
    at = lambda xs: F.element_at(longs(xs), F.col("range") + 1)
    w = Window.partitionBy("range").orderBy("a", "b", "c")
    start = at(before_b) + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = ranged.select("id", "size", "crc", (at(before_n) + F.row_number().over(w) - 1).alias("rank"), start.alias("start"))
    shard = F.call_function("div", (F.col("start") * 2 + F.col("size")) * n_shards, F.lit(2 * max(total, 1)).cast("long"))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1).cast("long"), shard).cast("int"))
    placed = durable(placed, "shard-placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # n_shards rows at most
    return placed.join(first, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

