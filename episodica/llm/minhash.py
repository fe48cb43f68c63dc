"""Near duplicates by b-bit MinHash.

Of each text's word shingles, BANDS * ROWS minima are taken; bands of ROWS minima give candidates, the low BITS bits of all minima, packed
into longs, give by bit counts an estimate of the similarity corrected for chance agreement, and what the estimate cannot rule out is
confirmed on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.durable import drop, durable
from episodica.llm.common import ship_package, tidy
from episodica.llm.components import components
from episodica.llm.tokens import slices

#: At a similarity of 0.8 all bands miss a pair with probability (1 - 0.8 ** 5) ** 36, 6e-7.
BANDS, ROWS, BITS = 36, 5, 2
MINIMA, WORDS = BANDS * ROWS, -(-BANDS * ROWS * BITS // 64)
#: Standard deviations by which an estimate may fall short of the threshold: a pair at it is lost with probability 1e-9.
SIGMAS = 6.0
#: Bits for each id, and bits at most, of the broadcast filter that leaves out texts without a candidate: 32 MB. More ids than that allows are joined.
FILTER_BITS, MOST_BITS, BITMAP = 8, 1 << 28, 1 << 15
#: Bits for each id as far as the filter keeps to 8 MB, for whole sets are made of what passes: then one in 64 of the others at most.
FINE_BITS, MOST_FINE = 64, 1 << 26
#: Parts that the comparisons with one node are dealt into.
SALTS = 16
#: Nodes on a side of a cell in which nodes of different components are compared.
BLOCK = 256
#: Shingles on a side of a cell in which full sets are compared, 16 MB: blocks are as many as keep to it, but for single sets beyond it.
BLOCK_SHINGLES = 2_000_000
#: Words whose hashes a worker remembers.
MOST_WORDS = 150_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()
_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 32, (MINIMA, 1), np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, (MINIMA, 1), np.uint64).astype(np.uint32)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words of the text in ASCII lower case; of all its words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = (acc ^ h[j : j + n]) * _C1
        acc ^= acc >> np.uint64(29)
    acc *= _C2
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048] * _A + _B).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """Rows of minima to rows of BANDS longs; the band's number is part of the key."""
    m = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _C2, m.shape[:2])
    for j in range(ROWS):
        acc = (acc ^ m[:, :, j]) * _C1
        acc ^= acc >> np.uint64(31)
    return acc.view(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """Rows of minima to rows of WORDS longs that hold BITS bits of each, after a mix (the low bits of a multiple depend on few bits)."""
    low = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.uint64)
    per = 64 // BITS
    full = np.zeros((len(low), WORDS * per), np.uint64)
    full[:, :MINIMA] = low
    return np.bitwise_or.reduce(full.reshape(len(low), WORDS, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), digest (128 bits of the set; null if empty), bands, s0, s1, ... of every row."""
    import xxhash

    ship_package(docs.sparkSession)
    long = T.LongType()
    names = [f"s{i}" for i in range(WORDS)]
    schema = T.StructType([T.StructField("id", long), T.StructField("n", long), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(long)), *(T.StructField(s, long) for s in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                n, digest, least = [], [], np.empty((len(texts), MINIMA), np.uint32)
                for i, t in enumerate(texts):
                    s = shingle_set(t, size)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    least[i] = minima(s)
                keys, bits = band_keys(least), packed_bits(least)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                cols = [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands, *(pa.array(bits[:, i]) for i in range(WORDS))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            tidy()
        _HASHES.clear()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                sets = [shingle_set(t, size).view(np.int64) for t in texts]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                cols = [batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
            tidy()
        _HASHES.clear()

    return docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def least_matches(percent: int) -> int:
    """Equal b-bit values that a pair at the threshold has at least, but for chance beyond SIGMAS."""
    p = percent / 100 + (1 - percent / 100) / 2**BITS
    return math.floor(MINIMA * p - SIGMAS * math.sqrt(MINIMA * p * (1 - p)))


def mismatches(a: str, b: str) -> Column:
    """b-bit values that differ, from the bit counts of the packed longs."""
    out = F.lit(0)
    for i in range(WORDS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        out = out + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def estimate(differ):
    """Similarity from the number of differing values (a column or an array), corrected for values that agree by chance."""
    chance = 2.0**-BITS
    return ((1.0 - differ / float(MINIMA)) - chance) / (1.0 - chance)


def least_estimate(percent: int) -> float:
    """The estimate that a pair at the threshold reaches, but for chance beyond SIGMAS."""
    return estimate(MINIMA - least_matches(percent)) - 1e-9


def _possible(a: str, b: str, percent: int) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (estimate(mismatches(a, b)) >= least_estimate(percent))


def _filtered(df: DataFrame, id_col: str, ids: DataFrame, most_bits: int) -> DataFrame | None:
    """df with __maybe: whether a row's id, a long, may be among the ids (one column, durable); false for seven eighths of the others at least.

    The filter's hashed bits, FILTER_BITS for each id or up to FINE_BITS in a small one, are broadcast; None if they would be more than most_bits.
    """
    name, n = ids.columns[0], ids.count()
    if n * FILTER_BITS > most_bits:
        return None
    wanted = max(n * FILTER_BITS, min(n * FINE_BITS, most_bits, MOST_FINE))
    bits = max(BITMAP, 1 << (wanted - 1).bit_length() if n else 0)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    part, place = lambda s: F.shiftright(s, 15).cast("int"), lambda s: s.bitwiseAND(F.lit(BITMAP - 1))
    one = ids.select(slot(F.col(name)).alias("s")).distinct()
    maps = one.groupBy(part(F.col("s")).alias("__part")).agg(F.bitmap_construct_agg(place(F.col("s"))).alias("__map"))  # bits / 8 bytes in all
    own = df.withColumn("__slot", slot(F.col(id_col))).withColumn("__at", place(F.col("__slot")).cast("int"))
    near = own.join(F.broadcast(maps), part(F.col("__slot")) == F.col("__part"), "left")
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.shiftright("__at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return near.select(*df.columns, F.coalesce(F.call_function("getbit", byte, F.col("__at").bitwiseAND(F.lit(7))) == 1, F.lit(False)).alias("__maybe"))


def maybe_in(df: DataFrame, id_col: str, ids: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of df whose id is among the ids, and a few others: they stay where they are read, but if the ids are too many for a filter."""
    marked = _filtered(df, id_col, ids, most_bits)
    if marked is None:
        return df.join(ids.select(F.col(ids.columns[0]).alias("__in")).distinct(), F.col(id_col) == F.col("__in"), "left_semi")
    return marked.filter("__maybe").drop("__maybe")


def split_by(df: DataFrame, id_col: str, ids: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose id may be among the ids, and those whose id is surely not."""
    marked = _filtered(df, id_col, ids, most_bits)
    if marked is None:
        return df, df.limit(0)
    return marked.filter("__maybe").drop("__maybe"), marked.filter("not __maybe").drop("__maybe")


def _sets_of(nodes: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """node and set of these nodes (durable), and of a few others."""
    some = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter("__id is not null")
    return durable(shingle_sets(maybe_in(some, "__id", nodes), size, "__id", "__text"), "near-sets")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets' similarity is at least percent / 100."""
    nodes = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-asked")
    sets = _sets_of(nodes, docs, size, id_col, text_col)
    drop(nodes)
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    # a node that many are compared with has its set in as many parts as there are, SALTS at most
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    parts = salted.select("b", "salt").distinct().join(two, "b")
    both = salted.join(one, "a").join(parts, ["b", "salt"])
    common = F.size(F.array_intersect("sa", "sb"))
    found = both.filter(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b").distinct()
    found = durable(found, "near-links")
    drop(sets)
    return found


def _in_cells(rows: DataFrame, details: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """function over the cells of rows (low, node, component, home), with details by node.

    The rows of a low are dealt into blocks: those away (of another component than low) and those at home, which need not meet each other. A
    cell is a block of away rows and one of any. Rows with the size n of their sets, which go into the cells with them, are in more blocks if those
    are large. Columns added: block, row and column of the cell.
    """
    held = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0)) if "n" in rows.columns else F.lit(0)
    blocks = lambda flag: F.greatest(F.ceil(F.count_if(flag) / F.lit(float(BLOCK))), F.ceil(held(flag) / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    sizes = durable(rows.groupBy("low").agg(blocks(~F.col("home")).alias("away_n"), blocks(F.col("home")).alias("home_n")), "near-cells")
    dealt = rows.join(sizes, "low").filter("away_n > 0")
    h = F.xxhash64("node")
    block = F.when(F.col("home"), F.col("away_n") + F.pmod(h, F.greatest("home_n", F.lit(1)))).otherwise(F.pmod(h, "away_n")).cast("int")
    k, cell = F.col("block"), lambda i, j: F.struct(i.cast("int").alias("row"), j.cast("int").alias("column"))
    above = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.least(k, F.col("away_n")) - 1), lambda i: cell(i, k))).otherwise(F.array().cast("array<struct<row:int,column:int>>"))
    right = F.when(F.col("home"), F.array().cast("array<struct<row:int,column:int>>")).otherwise(F.transform(F.sequence(k, F.col("away_n") + F.col("home_n") - 1), lambda j: cell(k, j)))
    dealt = dealt.withColumn("block", block).withColumn("cell", F.explode(F.concat(above, right)))
    dealt = dealt.select("low", "node", "component", "home", "block", "cell.row", "cell.column", *(c for c in ("reach",) if c in rows.columns))
    parts, cell = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["low", "row", "column"]
    ordered = dealt.join(details, "node").repartition(parts, *cell).sortWithinPartitions(*cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells one after the other as they come, many small ones in a batch: one whole cell is held at most besides it."""
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                out = function(pa.concat_tables(held).combine_chunks())
                held.clear()
                if len(out):
                    yield from out.combine_chunks().to_batches()

        last = None
        for batch in batches:
            t, at = pa.Table.from_batches([batch]), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cell], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for start, stop in zip(cuts, cuts[1:]):  # noqa: B905
                own = tuple(at[start].tolist()) if stop > start else last
                if own != last:
                    yield from done()
                held.append(t.slice(start, stop - start))
                last = own
            tidy()
        yield from done()

    columns = [*cell, *(c for c in ordered.columns if c not in cell)]
    return ordered.select(*columns).mapInArrow(run, schema)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the cell's rows on its two sides, and of all rows: component and set size."""
    block = t.column("block").to_numpy()
    return np.flatnonzero(block == t.column("row")[0].as_py()), np.flatnonzero(block == t.column("column")[0].as_py()), t.column("component").to_numpy(), t.column("n").to_numpy()


def _likely(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two sides, and which pairs of them may be links between components."""
    x, y, component, n = _sides(t)
    bits = np.column_stack([t.column(f"s{i}").to_numpy() for i in range(WORDS)]).view(np.uint64)
    differ = np.zeros((len(x), len(y)), np.int64)
    for i in range(WORDS):
        d = bits[x, i][:, None] ^ bits[y, i]
        differ += np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555))
    nx, ny = n[x][:, None], n[y]
    may = (component[x][:, None] != component[y]) & (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent)
    return x, y, may & (estimate(differ) >= least_estimate(percent))


def _likely_nodes(percent: int, likely: Callable = _likely) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        x, y, may = likely(t, percent)
        return t.select([c for c in (*"low node component home n".split(), "reach") if c in t.column_names]).take(pa.array(np.union1d(x[may.any(axis=1)], y[may.any(axis=0)])))

    return run


def _cell_links(percent: int, likely: Callable = _likely) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        x, y, may = likely(t, percent)
        component, node = t.column("component").to_numpy(), t.column("node").to_numpy()
        lists = t.column("set").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        distinct, ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        at_y = np.concatenate([np.arange(starts[j], starts[j] + sizes[j]) for j in y]) if len(y) else np.zeros(0, np.int64)
        ids_y, cuts = ids[at_y], np.cumsum(sizes[y]) - sizes[y]
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        a, b = [], []
        held = np.zeros(len(distinct), np.int64)
        for i in np.flatnonzero(may.any(axis=1)):
            own = ids[starts[x[i]] : starts[x[i]] + sizes[x[i]]]
            held[own] = 1
            common = np.add.reduceat(held[ids_y], cuts)
            held[own] = 0
            for j in np.flatnonzero(may[i] & (common * 100 >= (sizes[x[i]] + sizes[y] - common) * percent)):
                p, q = root(int(component[x[i]])), root(int(component[y[j]]))
                if p != q:  # else a link here has joined them
                    parent[max(p, q)] = min(p, q)
                    a.append(node[x[i]])
                    b.append(node[y[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def settle(members: DataFrame, light: DataFrame, possible: Callable, likely: Callable, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, more: DataFrame | None = None) -> DataFrame:
    """node and component of the nodes that links within buckets join. members: band, node, low (a member that the others are first compared
    with) and perhaps star_only, where a link to low is all that a bucket can say, and reach, which likely may use. light: node, n and what possible (columns) and likely (a cell's
    table) need to rule pairs out. more: further links.

    After the stars the members of buckets that still hold several components are compared across components, in cells of at most about
    BLOCK by BLOCK nodes: first by what light has, which leaves the nodes that may have a link, then on full sets. A cell gives nodes, or
    links that join components, never pairs.
    """
    stars = members.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    stars = stars.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    lows = light.join(members.select(F.col("low").alias("node")).distinct(), "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x, y = light.alias("x"), lows.alias("y")
    pairs = stars.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & (stars["salt"] == F.col("y.salt")))
    near = durable(pairs.filter(possible("x", "y", percent)).select("a", "b").distinct(), "near-stars")
    starred = confirm(near, docs, size, percent, id_col, text_col)
    drop(near)
    links = starred if more is None else starred.unionByName(more)
    nodes = components(links)

    whole = members.filter("not star_only") if "star_only" in members.columns else members
    placed = whole.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = durable(placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("band"), "near-mixed")
    reach = [F.max(c).alias(c) for c in ("reach",) if c in members.columns]
    rest = placed.join(mixed, "band").groupBy("low", "node", "component").agg(F.lit(1).alias("__one"), *reach).drop("__one")
    low_of = nodes.select(F.col("node").alias("low"), F.col("component").alias("of_low"))
    rest = durable(rest.join(low_of, "low", "left").withColumn("home", F.col("component") == F.coalesce("of_low", "low")).drop("of_low"), "near-rest")
    drop(mixed)
    near = _in_cells(rest, light, _likely_nodes(percent, likely), "low long, node long, component long, home boolean, n long" + ", reach long" * bool(reach))
    near = durable(near.groupBy("low", "node", "component", "home").agg(F.max("n").alias("n"), *reach), "near-likely")
    drop(rest)
    if not near.isEmpty():
        asked = durable(near.select("node").distinct(), "near-asked")
        sets = _sets_of(asked, docs, size, id_col, text_col)
        found = durable(_in_cells(near, light.join(sets, "node"), _cell_links(percent, likely), "a long, b long").distinct(), "near-links")
        drop(asked, sets)
        if not found.isEmpty():
            old, nodes = nodes, components(links.unionByName(found))
            drop(old)
        drop(found)
    drop(near, starred)
    return nodes


def placed_rows(rows: DataFrame, classes: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """id_col, n_shingles and component_id of rows (id, n, digest) by way of classes (digest, node, rows) and nodes (node, component). Only the
    classes of several rows or of another component are looked up, and rows without a set aren't."""
    of = classes.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node")).filter("rows > 1 or component <> node")
    full = (F.col("n") > 0) & F.col("id").isNotNull()
    named = rows.filter(full).join(of.select("digest", "component"), "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    whole = named.unionByName(rows.filter(~full).select("id", "n", F.col("id").alias("component")))
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept (id is component_id) of every row.

    Rows are linked if 100 * shared shingles >= percent * all shingles of both; component_id is the smallest id that can be reached. Texts
    with equal sets form a class that goes on as its smallest id. In each bucket of a band, members are first compared with the smallest
    one (a star, so a bucket of n gives n - 1 pairs), then across components (settle). Every candidate is thus confirmed, ruled out, or
    already connected.

    A text without words, or null, is linked with nothing. Rows of one id are one node, linked by any of their texts; a row with a null id
    is linked with nothing and kept. Other columns are ignored; an empty table gives no rows.
    """
    sigs = durable(signatures(docs, size, id_col, text_col), "near-signatures")
    full = sigs.filter("n > 0 and id is not null")
    classes = durable(full.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("rows")), "near-classes")
    reps = durable(full.join(classes.drop("rows"), (full["digest"] == classes["digest"]) & (full["id"] == classes["node"])).drop("digest", "id"), "near-reps")
    light = reps.drop("bands")
    buckets = reps.select("node", F.explode("bands").alias("band"))
    shared = durable(buckets.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("band", "low"), "near-buckets")
    members = durable(buckets.join(shared, "band"), "near-members")
    drop(shared)
    nodes = settle(members, light, _possible, _likely, docs, size, percent, id_col, text_col)
    drop(members, reps)
    out = placed_rows(sigs.select("id", "n", "digest"), classes, nodes, id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each group; of several rows of a kept id the one with the least hash of its columns.

    Rows whose id is surely none that goes, or that is repeated, stay where they are read: a broadcast filter tells. Only the others are
    joined with those ids; where there are too many for a filter, all rows are. A row with a null id is kept.
    """
    found = near_duplicates(docs, size, percent, id_col, text_col).select(F.col(id_col).alias("__id"), "kept").filter("__id is not null")
    odd = durable(found.groupBy("__id").agg(F.bool_or("kept").alias("__kept"), F.count("*").alias("__n")).filter("not __kept or __n > 1"), "near-odd")
    key = F.col(id_col).cast("long")
    marked = docs.withColumn("__key", key).filter("__key is not null")
    near, sure = split_by(marked, "__key", odd.select("__id"))
    joined = near.join(odd, F.col("__key") == F.col("__id"), "left").filter("__kept is null or __kept")
    rows = sure.select(*docs.columns).unionByName(docs.filter(key.isNull())).unionByName(joined.filter("__n is null or __n = 1").select(*docs.columns))
    if not odd.filter("__n > 1").isEmpty():
        one = joined.filter("__n > 1").withColumn("__h", F.xxhash64(*docs.columns))
        first = one.groupBy("__id").agg(F.min("__h").alias("__h"))
        rows = rows.unionByName(one.join(first, ["__id", "__h"]).dropDuplicates(["__id"]).select(*docs.columns))
    return rows
