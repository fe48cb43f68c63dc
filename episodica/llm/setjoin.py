"""Join of documents by the Jaccard similarity of their word n-grams: a size-aware join, exact.

Sets of equal contents are one. Sets up to a boundary size are small: two small sets that are similar share a subset of the size that their
sizes ask for, so each small set lists its subsets of those sizes, and sets that list the same one are linked with the smallest of them:
whoever links with another member of the bucket links with that. Larger sets, and the small ones that may link with a larger one, enter
the inverted lists of their rarest n-grams, as many as leave fewer than the least overlap; two similar sets meet in at least one list. The
boundary is where listing subsets and scanning lists cost the least together, from the numbers of sets by size and the lengths of the lists.

How rare an n-gram is tells a table of counts by hash, a fixed number of slots summed over all documents. It only decides which lists a set
enters, in one order for all sets, so equal slots cost time and lose nothing. What meets is ruled out by sizes and by parities of hashed
n-grams, a bound that always holds (large sets have more bits of them), and confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.durable import drop, durable
from episodica.llm.common import ship_package, tidy
from episodica.llm.minhash import _HASHES, _sides, maybe_in, placed_rows, settle, shingle_set
from episodica.llm.tokens import slices

#: Slots of the table of counts, 16 MB; slots that are sent together.
SLOT_BITS, CHUNK_BITS = 22, 12
#: Longs of the parities of a set: each bit tells whether an even or odd number of its n-grams fall on it.
PARITY_LONGS = 16
#: From so many n-grams on a set has wide parities too, a bit for each one or two n-grams, 8 KB at most: those above say nothing of sets of some
#: thousands. Longs of the widest.
WIDE_FROM, MOST_WIDE = 2048, 1024
#: Largest boundary that is considered: beyond it subsets are too many at any length of lists.
MOST_SMALL = 48
#: The share of all n-grams, the rarest, over which lists are measured: sets enter the lists of theirs.
RAREST = 0.1
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PARITIES = [f"p{i}" for i in range(PARITY_LONGS)]
PROFILE = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]
    + [T.StructField(p, T.LongType()) for p in PARITIES] + [T.StructField("wide", T.ArrayType(T.LongType())), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())]
)
POSTED = T.StructType([T.StructField("band", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("star_only", T.BooleanType()), T.StructField("reach", T.LongType()), T.StructField("weight", T.LongType())])


def need(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m members: percent / 100 of the union."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set of n lists: what its small partners ask for. Equal sets are one, so it needs no partner that is all of it."""
    return sorted({need(n, m, percent) for m in partners(n, percent) if 0 < m <= boundary and not m == n == need(n, m, percent)})


def listed(n: int, percent: int) -> int:
    """In how many lists a set of n is: one more than it may lack of a partner's members."""
    return n - -(-percent * n // 100) + 1


def reaches(n: int, percent: int) -> np.ndarray:
    """For each of its lists the largest partner of a set of n that may first meet it there: its members from there on must hold the overlap."""
    return (n - np.arange(listed(n, percent))) * (100 + percent) // percent - n


def boundary(sizes: dict[int, int], length: float, percent: int) -> int:
    """The size up to which sets list subsets: least total of subsets listed and of list entries scanned, lists having this length."""
    def cost(x: int) -> float:
        small = sum(k * comb(n, c) for n, k in sizes.items() if n <= x for c in subset_sizes(n, x, percent))
        in_lists = sum(k * listed(n, percent) * length for n, k in sizes.items() if n > x or 100 * n >= percent * (x + 1))
        return small + in_lists

    return min(range(MOST_SMALL + 1), key=cost)


def subset_keys(members: np.ndarray, c: int) -> np.ndarray:
    """A key for each subset of c members: the sum of the members' mixed hashes, so that all of them come from sums over what is left out."""
    mixed = (members ^ members >> np.uint64(31)) * _C1
    mixed ^= mixed >> np.uint64(29)
    out = len(members) - c
    left = np.array(list(combinations(range(len(members)), out)), np.int64).reshape(comb(len(members), out), out)
    sums = mixed.sum(dtype=np.uint64) - mixed[left].sum(axis=1, dtype=np.uint64)
    keys = (sums ^ np.uint64(c)) * _C2
    return keys ^ keys >> np.uint64(32)


def parities(members: np.ndarray, longs: int = PARITY_LONGS) -> np.ndarray:
    """Of `longs` longs, a power of two: the exclusive or of their two halves is what half as many longs would hold."""
    bits = np.bincount((members >> np.uint64(20) & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_parities(members: np.ndarray) -> np.ndarray | None:
    """Parities of a large set; those of linked sets are alike in length, or one is twice as long."""
    return parities(members, min(MOST_WIDE, 1 << (len(members).bit_length() - 7))) if len(members) >= WIDE_FROM else None


def forget_words() -> None:
    """Gives back what this worker remembers of words; a function, for a task's closure holds copies of a module's values."""
    _HASHES.clear()


def slot_of(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def profiles(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of the texts (kind 0: id, n, digest of the set, parities), and of each task's counts by slot (kind 1: chunk, counts)."""
    import xxhash

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
        counts, nulls = np.zeros(1 << SLOT_BITS, np.uint32), lambda field, n: pa.nulls(n, kinds.get(field.dataType, pa.binary()))
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                n, digest, wide, bits = [], [], [], np.zeros((len(texts), PARITY_LONGS), np.int64)
                for i, t in enumerate(texts):
                    s = shingle_set(t, size)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    wide.append(wide_parities(s))
                    if len(s):
                        bits[i] = parities(s)
                        np.add.at(counts, slot_of(s), 1)
                own = {"kind": pa.array(np.zeros(len(n), np.int32)), "id": batch.column(0).slice(first, len(texts)), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "wide": pa.array(wide, pa.list_(pa.int64()))}
                own |= {p: pa.array(bits[:, i]) for i, p in enumerate(PARITIES)}
                yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else nulls(f, len(texts)) for f in PROFILE], names=PROFILE.names)
            tidy()
        forget_words()
        parts = counts.reshape(-1, 1 << CHUNK_BITS)
        some = np.flatnonzero(parts.any(axis=1))
        for k in range(0, len(some), 256):
            at = some[k : k + 256]
            own = {"kind": pa.array(np.ones(len(at), np.int32)), "chunk": pa.array(at.astype(np.int32)), "counts": pa.array([pa.compress(parts[i].tobytes(), "zstd", asbytes=True) for i in at], pa.binary())}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else nulls(f, len(at)) for f in PROFILE], names=PROFILE.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PROFILE)


def slot_counts(found: DataFrame) -> np.ndarray:
    """How many sets have an n-gram on each slot, summed over all tasks: a stream of chunks in order to one array at a time, then 16 MB to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << CHUNK_BITS, np.uint64)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()], pa.binary())], names=["chunk", "counts"])
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at is not None and chunk != at:
                    yield row()
                    total = np.zeros(1 << CHUNK_BITS, np.uint64)
                at = chunk
                total += np.frombuffer(pa.decompress(counts.as_buffer(), decompressed_size=4 << CHUNK_BITS, codec="zstd"), np.uint32)
        if at is not None:
            yield row()

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = found.filter("kind = 1").select("chunk", "counts").repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, counts binary")
    out = np.zeros((1 << SLOT_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint32)
    for chunk, counts in chunks.collect():  # a row for each chunk
        out[chunk] = np.frombuffer(counts, np.uint32)
    return out.ravel()


def list_length(counts: np.ndarray) -> float:
    """Mean length of the lists of the rarest n-grams, RAREST of all occurrences."""
    ordered = np.sort(counts[counts > 0]).astype(np.float64)
    if not len(ordered):
        return 1.0
    upto = max(1, int(np.searchsorted(np.cumsum(ordered), RAREST * ordered.sum())))
    return float((ordered[:upto] ** 2).sum() / ordered[:upto].sum())


def postings(docs: DataFrame, size: int, percent: int, small: int, counts: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """band, node, n, star_only, reach, weight: the subsets that small sets list (star_only), and the lists that larger ones, and partners of such,
    are in, with reaches() and the mean logarithm, in thousandths, of how frequent the set's listed n-grams are."""
    spark = docs.sparkSession
    ship_package(spark)
    table = spark.sparkContext.broadcast(counts)  # 16 MB, however many documents

    def posted(s: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, bool, np.ndarray, int]]:
        n, out = len(s), []
        if n <= small:
            out += [(k, True, np.zeros(len(k), np.int64), 0) for k in (subset_keys(s, c) for c in subset_sizes(n, small, percent))]
        if n > small or 100 * n >= percent * (small + 1):
            own = counts[slot_of(s)]
            at = np.lexsort((s, own))[: listed(n, percent)]
            out.append((s[at], False, reaches(n, percent), int(1000 * np.log(own[at].astype(np.float64)).mean())))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                keys, reach, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
                for i, t in enumerate(texts):
                    s = shingle_set(t, size)
                    for k, star, r, weight in posted(s, counts) if len(s) else ():
                        keys.append(k)
                        reach.append(r)
                        rows.append((len(k), i, len(s), star, weight))
                ids = batch.column(0).slice(first, len(texts))
                each = np.array(rows, np.int64).reshape(-1, 5)
                of, n, star, weight = (np.repeat(each[:, c], each[:, 0]) for c in range(1, 5))
                cols = [pa.array(np.concatenate(keys).view(np.int64)), ids.take(pa.array(of)), pa.array(n), pa.array(star.astype(bool)), pa.array(np.concatenate(reach)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(cols, names=POSTED.names)
            tidy()
        forget_words()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, POSTED)


def most_apart(n, m, percent: int):
    """Members that linked sets of n and m may have apart from each other: numbers or arrays."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def _possible(a: str, b: str, percent: int) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    least = F.floor((percent * (na + nb) + 99 + percent) / (100 + percent))  # exact: below 2 ** 53
    differ = F.lit(0)
    for p in PARITIES:
        differ = differ + F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
    wa, wb = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    longs, xor = F.least(F.size(wa), F.size(wb)), lambda x, y: x.bitwiseXOR(y)
    folded = lambda w: F.when(F.size(w) == longs, w).when(F.size(w) == 2 * longs, F.zip_with(F.slice(w, 1, longs), F.slice(w, longs + 1, longs), xor))
    wide = F.aggregate(F.zip_with(folded(wa), folded(wb), xor), F.lit(0), lambda total, x: total + F.bit_count(x))  # null if either has none
    apart = na + nb - 2 * least
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (differ <= apart) & F.coalesce(wide <= apart, F.lit(True))


def _rule_out_wide(may: np.ndarray, x: np.ndarray, y: np.ndarray, wide: pa.ChunkedArray, most: np.ndarray) -> None:
    """Takes out of may the pairs whose wide parities differ in more than most."""
    lists = wide.combine_chunks()
    sizes, flat = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy().view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    held = lambda rows, longs: np.stack([np.bitwise_xor.reduce(flat[starts[r] : starts[r] + sizes[r]].reshape(-1, longs)) for r in rows])
    for p in np.unique(sizes[x[sizes[x] > 0]]):
        for q in {p // 2, p, 2 * p} - {0}:
            rows, columns = np.flatnonzero(sizes[x] == p), np.flatnonzero(sizes[y] == q)
            if len(columns):
                other = held(y[columns], min(p, q))
                for i, own in zip(rows, held(x[rows], min(p, q))):  # noqa: B905
                    may[i, columns] &= np.bitwise_count(own ^ other).sum(axis=1, dtype=np.int64) <= most[i, columns]


def _likely(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y, component, n = _sides(t)
    differ = np.zeros((len(x), len(y)), np.int64)
    for p in PARITIES:
        bits = t.column(p).to_numpy().view(np.uint64)
        differ += np.bitwise_count(bits[x][:, None] ^ bits[y])
    nx, ny, reach = n[x][:, None], n[y], t.column("reach").to_numpy()
    may = (component[x][:, None] != component[y]) & (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent) & (ny <= reach[x][:, None]) & (nx <= reach[y])
    most = most_apart(nx, ny, percent)
    may &= differ <= most
    _rule_out_wide(may, x, y, t.column("wide"), most)
    return x, y, may


def similar_sets(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", small: int | None = None) -> DataFrame:
    """id, n_shingles and component_id of every row: rows link if 100 * shared n-grams >= percent * all n-grams of both, n-grams being runs of
    `size` words (in ASCII lower case, between ASCII white space), or all words of a text with fewer. component_id is the smallest id that
    links lead to. small: the boundary; chosen by cost if not given, and without effect on the rows.

    A text without words, or null, has no n-grams and is linked with nothing. Rows of one id are one document, linked by any of their texts.
    A row with a null id is linked with nothing. Other columns are ignored; an empty table gives no rows.
    """
    found = durable(profiles(docs, size, id_col, text_col), "join-profiles")
    sets = found.filter("kind = 0")
    full = sets.filter("n > 0 and id is not null").select("id", "n", "digest", *PARITIES, "wide")
    classes = durable(full.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("rows")), "join-classes")
    reps = full.join(classes.drop("rows"), (full["digest"] == classes["digest"]) & (full["id"] == classes["node"]))
    light = durable(reps.select("node", "n", *PARITIES, "wide").distinct(), "join-reps")
    counts = slot_counts(found)
    if small is None:
        sizes = {r[0]: r[1] for r in light.filter(F.col("n") <= 2 * MOST_SMALL).groupBy("n").count().collect()}
        small = boundary(sizes, list_length(counts), percent)

    nodes = light.select("node").distinct()
    some = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter("__id is not null")
    ids = durable(nodes, "join-nodes")
    # lists are gathered once; who else is in one is asked of windows over it, and lists of one set end there
    lists = ["band", "star_only"]
    whole = Window.partitionBy(*lists)
    posted = postings(maybe_in(some, "__id", ids), size, percent, small, counts, "__id", "__text")
    met = posted.select("*", F.min("node").over(whole).alias("__a"), F.max("node").over(whole).alias("__b")).filter("__a < __b").drop("__a", "__b")
    several = durable(met.join(ids, "node").distinct(), "join-several")  # a few rows that are no class's passed the filter
    # sizes of linked sets are in one level or in neighbouring ones: a set is in the part of a list for its own level and in the next one's
    level = F.floor(F.log(F.col("n").cast("double")) / log(100 / min(percent, 99.9) + 1e-9)).cast("int")
    levels = F.explode(F.when(F.col("star_only"), F.array(F.lit(0))).otherwise(F.array(level, level + 1))).alias("level")
    part = Window.partitionBy(*lists, "level")
    dealt = several.repartition(*lists).select("*", levels)
    kept = dealt.select("*", F.min("n").over(part).alias("__n"), F.count("*").over(part).alias("__m")).filter("__m > 1 and (star_only or reach >= __n)").drop("__n", "__m")
    low = F.when(F.col("star_only"), F.min(F.struct("n", "node")).over(part)["node"]).otherwise(F.max(F.struct("weight", (-F.col("node")).alias("m"), "node")).over(part)["node"])
    lows = kept.select("*", low.alias("low"), F.count("*").over(part).alias("__m")).filter("__m > 1")
    band = F.when(F.col("star_only"), F.col("band")).otherwise(F.xxhash64("band", "level"))
    members = durable(lows.select(band.alias("band"), "node", "low", "star_only", "reach"), "join-members")
    drop(several, ids)

    # an id with several texts is one document: its texts' classes are linked
    twice = full.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("id")
    same = durable(full.select("id", "digest").join(twice, "id").join(classes, "digest").select(F.col("id").alias("a"), F.col("node").alias("b")), "join-same")
    out = settle(members, light, _possible, _likely, docs, size, percent, id_col, text_col, more=same)
    drop(members, light, same)
    return placed_rows(sets.select("id", "n", "digest"), classes, out, id_col)
