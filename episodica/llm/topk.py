"""Exact top-k by inner product, columnar with branch and bound.

Vectors of whole numbers are dealt in a grid of query blocks and candidate slices. Within a cell, candidates lie dimension by dimension;
scores are accumulated over blocks of dimensions, and after each block a candidate stays with a query only if its score so far plus the most
that the rest of both vectors could add (the product of their remaining norms) reaches the query's k-th best score so far. Each cell first
meets the table's candidates of greatest norm, so that it starts with bars of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import durable, ship_package

K, SCALE = 20, 64
#: Queries of a block on average, rows of candidates taken at once, those of greatest norm that each cell meets first, dimensions of a step,
#: and tasks at most.
QUERY_ROWS, TILE, SEEDS, STEP, MOST_TASKS = 2048, 2048, 256, 16, 1 << 18
#: Below this share of surviving pairs, pairs are compacted into lists.
DENSE = 0.2


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and q = floor(scale * component) as longs, of the vectors without null or non-finite components."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col(vector_col).isNotNull() & F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector_col, x.alias("x")).filter(good & F.col("id").isNotNull())
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("q"))


def _tails(m: np.ndarray) -> np.ndarray:
    """Norms of what is left from each step on (rows: steps); a little more than exact, so that rounding never rules a candidate out."""
    steps = range(0, m.shape[0], STEP)
    sums = np.array([(m[i : i + STEP].astype(np.float64) ** 2).sum(axis=0) for i in steps]).reshape(-1, m.shape[1])
    return np.sqrt(np.concatenate([np.cumsum(sums[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))])) * (1 + 1e-9)


def _most(m: np.ndarray) -> int:
    """The greatest absolute value, also where it has no positive counterpart in the type."""
    return max(int(m.max(initial=0)), -int(m.min(initial=0)))


class Cell:
    """The k best candidates so far of a block of queries. Queries and candidates are vertical (dimensions by rows), of long."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = q_ids, q, k
        self.most, self.tails, self.kinds = _most(q), _tails(q), {}
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
        self.bar = np.full(len(q_ids), -np.inf)

    def seed(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """Bars from candidates that come again in the slice of some cell: a query's k-th best of them is no higher than its k-th best of all."""
        self.feed(c_ids, c)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.ids]

    def feed(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """A tile of candidates, those of great norm first: the bounds bite sooner."""
        norms = _tails(c)[0]
        near = norms >= self._least_norm()
        if not near.all():
            c_ids, c = c_ids[near], c[:, near]
        if not len(c_ids):
            return
        n, k, dims = len(self.ids), self.k, self.q.shape[0]
        most = (self.most + 1) * (_most(c) + 1) * max(1, dims)
        if most >= 1 << 63:
            raise OverflowError("inner products of these vectors may not fit a long")
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64  # sums are exact in each of them
        q = self.kinds.get(kind)
        if q is None:
            q = self.kinds[kind] = np.ascontiguousarray(self.q.astype(kind))
        c, tq, tc, bar = np.ascontiguousarray(c.astype(kind)), self.tails, _tails(c), self.bar
        block, acc, score = np.arange(len(c_ids)), np.zeros((n, len(c_ids)), kind), None
        alive_q = alive_c = None
        for s, d in enumerate(range(0, dims, STEP), 1):
            if alive_q is None:
                acc += q[d : d + STEP].T @ c[d : d + STEP, block]
                keep = acc + tq[s][:, None] * tc[s][block] >= bar[:, None]
                if keep.mean() < DENSE:
                    alive_q, alive_c = np.nonzero(keep)
                    score = acc[alive_q, alive_c]
                else:  # candidates that no query here still needs go
                    some = keep.any(axis=0)
                    if not some.all():
                        block, acc = block[some], acc[:, some]
            else:
                score = score + np.einsum("ij,ij->j", q[d : d + STEP, alive_q], c[d : d + STEP, block[alive_c]])
                keep = score + tq[s][alive_q] * tc[s][block[alive_c]] >= bar[alive_q]
                alive_q, alive_c, score = alive_q[keep], alive_c[keep], score[keep]
        if alive_q is None:
            alive_q, alive_c = np.nonzero(acc >= bar[:, None])
            score = acc[alive_q, alive_c]
        ids, score = c_ids[block[alive_c]], score.astype(np.int64)
        own = ids != self.ids[alive_q]
        alive_q, ids, score = alive_q[own], ids[own], score[own]
        cuts = np.searchsorted(alive_q, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            s, x = np.concatenate([self.best[i][0], score[cuts[i] : cuts[i + 1]]]), np.concatenate([self.best[i][1], ids[cuts[i] : cuts[i + 1]]])
            if len(s) > 4 * k:  # ties of the k-th stay for the exact order
                part = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, x = s[part], x[part]
            top = np.lexsort((x, -s))[:k]
            self.best[i] = (s[top], x[top])
            if len(top) == k:
                self.bar[i] = max(self.bar[i], self.best[i][0][-1])

    def _least_norm(self) -> float:
        """A candidate of a smaller norm reaches no query's bar."""
        norms = self.tails[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norms > 0, self.bar / norms, np.where(self.bar <= 0, -np.inf, np.inf))
        return need.min(initial=np.inf) * (1 - 1e-9) if need.min(initial=np.inf) > 0 else -np.inf

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of each query's k best."""
        none = [np.zeros(0, np.int64)]
        return np.repeat(self.ids, [len(s) for s, _ in self.best]), np.concatenate([x for _, x in self.best] or none), np.concatenate([s for s, _ in self.best] or none)


def best_of_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best of these candidates."""
    cell = Cell(q_ids, q, k)
    order = np.argsort(-_tails(c)[0], kind="stable") if len(c_ids) else np.zeros(0, int)
    for at in range(0, len(order), TILE):
        cell.feed(c_ids[order[at : at + TILE]], c[:, order[at : at + TILE]])
    return cell.result()


def _vertical(lists: list[pa.Array], dims: int) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists]).reshape(sum(map(len, lists)), dims).T


def _cells(k: int):
    """A function over rows (gq, gc, dims, kind, id, q) in that order: of each cell the queries (kind 0) and seeds (1), then candidates by tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, queries, seeds, waiting, rows = None, None, [], [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal cell, queries, seeds, waiting, rows
            if queries and (waiting or last) and cell is None:
                cell = Cell(np.concatenate([i for i, _ in queries]), _vertical([v for _, v in queries], key[2]), k)
                queries = []
                if seeds and waiting:
                    cell.seed(np.concatenate([i for i, _ in seeds]), _vertical([v for _, v in seeds], key[2]))
            if cell is not None and waiting:
                cell.feed(np.concatenate([i for i, _ in waiting]), _vertical([v for _, v in waiting], key[2]))
            waiting, rows = [], 0
            if last:
                if cell is not None and len(cell.ids):
                    out = cell.result()
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])
                cell, queries, seeds = None, [], []

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own, kind = tuple(keys[lo, :3].tolist()), int(keys[lo, 3])
                if own != key:
                    if key is not None:
                        yield from flush(True)
                    key = own
                ids, lists = b.column(4).slice(lo, hi - lo).to_numpy(zero_copy_only=False), b.column(5).slice(lo, hi - lo)
                if kind == 0:
                    queries.append((ids, lists))
                    continue
                if not queries and cell is None:
                    continue  # candidates without a query here
                if kind == 1:
                    seeds.append((ids, lists))
                    continue
                for at in range(0, len(ids), TILE):
                    part = slice(at, min(len(ids), at + TILE))
                    waiting.append((ids[part], lists.slice(part.start, part.stop - part.start)))
                    rows += part.stop - part.start
                    if rows >= TILE:
                        yield from flush(False)
        if key is not None:
            yield from flush(True)

    return run


def _narrow(rows: DataFrame, most: int) -> DataFrame:
    """q in the narrowest type that holds numbers of up to `most`: it is what the grid ships."""
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    return rows.withColumn("q", F.col("q").cast(f"array<{kind}>"))


def top_k(df: DataFrame, every: int = 20, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row whose id is divisible by `every`, against all other rows.

    Scores are inner products of floor(scale * component); ties go to the smaller id; a query with fewer candidates has them all. Null ids and
    vectors that are null, or hold a null, NaN or infinity, take no part; vectors of another length than the query's are not compared with
    it. Rows that repeat an id are candidates each, but a query meets no row of its own id, and repeated queries are one. An empty table
    gives no rows; components so large that a score may not fit a long raise. Rows are dealt to a grid of blocks of about QUERY_ROWS queries by
    slices of the candidates, as many as it takes to keep all cores busy; a cell streams over its slice, those of great norm first, so it holds
    its queries and one tile, and only the best of each slice are ranked again. Before its slice, a cell meets the SEEDS rows of greatest norm
    in the table, which give its queries bars; a tile without a norm that reaches one is passed over.
    """
    spark = df.sparkSession
    ship_package(spark)
    square = F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    whole = whole_numbers(df, id_col, vector_col, scale).withColumn("dims", F.size("q")).withColumn("norm", square)
    rows = durable(whole, "top-vectors")
    n, most = rows.agg(F.count("*"), F.max(F.array_max(F.transform("q", lambda x: F.greatest(x, F.bitwise_not(x)))))).first()
    rows = _narrow(rows, most or 0)
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "dims"])
    n_asked = asked.count()
    wanted = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    g_q = max(1, -(-n_asked // QUERY_ROWS))
    g_c = max(1, min(-(-wanted // g_q), -(-n // TILE)))
    deal = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asked.withColumn("gq", deal(g_q, 1)).withColumn("gc", all_of(g_c)).withColumn("kind", F.lit(0))
    right = rows.withColumn("gc", F.pmod(F.xxhash64("id", F.xxhash64("q"), F.monotonically_increasing_id()), F.lit(g_c)).cast("int"))
    right = right.withColumn("gq", all_of(g_q)).withColumn("kind", F.lit(2))
    seeds = rows.orderBy(F.desc("norm"), "id").limit(SEEDS).withColumn("gq", all_of(g_q)).withColumn("gc", all_of(g_c)).withColumn("kind", F.lit(1))
    keys = ["gq", "gc", "dims", "kind"]
    both = left.select(*keys, "id", "q", "norm").unionByName(seeds.select(*keys, "id", "q", "norm")).unionByName(right.select(*keys, "id", "q", "norm"))
    dealt = both.repartitionById(min(g_q * g_c, MOST_TASKS), F.col("gq") * g_c + F.col("gc")).sortWithinPartitions(*keys, F.desc("norm")).drop("norm")
    best = dealt.mapInArrow(_cells(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # k rows from each of g_c slices
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
