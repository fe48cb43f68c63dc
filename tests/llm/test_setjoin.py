import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from episodica.llm import minhash as M
from episodica.llm import setjoin as S
from episodica.llm.queries import ORACLES, QUERIES
from tests.compare import duck, rows
from tests.llm.test_minhash import brute


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_table_like_brute_force_and_sql(spark, data, docs):
    got = QUERIES["op11_setjoin"](spark, data)
    assert result(got) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90)
    assert rows(got.toPandas()) == rows(duck(data).execute(ORACLES["op11_setjoin"]).df())


def family(rnd, sizes, copies, percent):
    """Texts of many sizes with edits around the threshold, chains, and passages that all of them share."""
    passage, table = [f"p{j}" for j in range(12)], []
    for n in sizes:
        base = [f"w{n}x{j}" for j in range(n)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.choice([0, 1])] = [f"e{rnd.randrange(10**9)}"] * rnd.choice([0, 1])
                w = w or ["only"]
            table.append(w + passage * rnd.choice([0, 0, 1]))
    rnd.shuffle(table)
    return [(i * 3 + 1, " ".join(w)) for i, w in enumerate(table)]


@pytest.mark.parametrize("small", [0, 14, 24, None])
def test_sizes_around_the_boundary(spark, small):
    """The boundary moves work between subsets and lists, not rows."""
    table = family(random.Random(5), [*range(1, 34), 60, 150], 6, 90)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert result(S.similar_sets(df, 3, 90, small=small)) == brute(table, 3, 90)


@pytest.mark.parametrize("percent, size", [(60, 1), (75, 2), (100, 3)])
def test_other_thresholds(spark, percent, size):
    table = family(random.Random(percent), [1, 2, 3, 5, 8, 9, 11, 12, 15, 40], 8, percent)
    df = spark.createDataFrame(table, "doc_id long, text string")
    for small in (0, 10):
        assert result(S.similar_sets(df, size, percent, small=small)) == brute(table, size, percent)


def test_outliers_meet_in_cells(spark, monkeypatch):
    """A long family whose members are not all like the first of a list: links between the others are found, also in blocks cut by set sizes."""
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 900)
    rnd, base = random.Random(7), [f"b{j}" for j in range(100)]
    table = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            w[rnd.randrange(100)] = f"n{rnd.randrange(10**9)}"
        table.append((i, " ".join(w)))
    table += [(500 + k, " ".join(f"c{j}" for j in range(k * 3, k * 3 + 80))) for k in range(25)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert result(S.similar_sets(df, 3, 90)) == brute(table, 3, 90)


def test_odd_rows(odd_docs, no_docs, spark):
    assert result(S.similar_sets(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 3, 90)
    assert S.similar_sets(no_docs).count() == 0
    table = [(1, "a b c d"), (2, "a b c d"), (2, "x y z w"), (3, "x y z w"), (9, "x y z w"), (4, "q"), (5, " Q "), (None, "a b c d"), (6, None), (7, "")]
    got = result(S.similar_sets(spark.createDataFrame(table, "doc_id long, text string")))
    assert got == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 2, 1), (9, 2, 1), (4, 1, 4), (5, 1, 4), (None, 2, None), (6, 0, 6), (7, 0, 7)], key=repr)


def test_similar_small_sets_list_one_subset():
    rng = np.random.default_rng(1)
    for percent, top in ((90, 26), (70, 12)):
        for n in range(1, top):
            for m in S.partners(n, percent):
                if not 0 < m <= top or (n == m == S.need(n, m, percent)):
                    continue
                common = S.need(n, m, percent)
                x = np.unique(rng.integers(0, 1 << 63, n + m, np.uint64))
                a, b = np.sort(x[: n]), np.sort(np.concatenate([x[:common], x[n : n + m - common]]))
                keys = [np.concatenate([S.subset_keys(s, c) for c in S.subset_sizes(len(s), top, percent)]) for s in (a, b)]
                assert np.intersect1d(*keys).size
                assert all(len(S.subset_keys(a, c)) == comb(n, c) for c in S.subset_sizes(n, top, percent))


def test_lists_meet_and_bounds_hold():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 1 << S.SLOT_BITS).astype(np.uint32)
    for _ in range(300):
        n = int(rng.integers(20, 400))
        k = int(rng.integers(0, n // 10 + 1))
        x = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        a, b = np.unique(x[:n]), np.unique(np.concatenate([x[k:n], x[n : n + int(rng.integers(0, n // 10 + 1))]]))
        both, apart = len(np.intersect1d(a, b)), len(np.setxor1d(a, b))
        assert int(np.bitwise_count((S.parities(a) ^ S.parities(b)).view(np.uint64)).sum()) <= apart
        if 100 * both >= 90 * (both + apart):
            assert apart <= S.most_apart(len(a), len(b), 90)
            lists = [s[np.lexsort((s, counts[S.slot_of(s)]))[: S.listed(len(s), 90)]] for s in (a, b)]
            assert np.intersect1d(*lists).size


def test_the_boundary_balances_both_costs():
    sizes = {n: 100 for n in range(1, 90)}
    assert S.boundary(sizes, 1.0, 90) < S.boundary(sizes, 30.0, 90) < S.boundary(sizes, 10_000.0, 90)
    assert S.boundary({}, 1.0, 90) == 0


def test_large_sets_have_wide_parities(spark):
    """The bound holds for them, also where one is twice as long, and rules out unrelated sets of thousands, which 1,024 bits do not."""
    rng = np.random.default_rng(11)
    draw = lambda n: rng.integers(0, 1 << 63, n, np.uint64)
    sets = []
    for n in (1990, 2047, 2048, 4090, 5500):
        base = draw(n)
        sets += [np.unique(base), np.unique(np.concatenate([base[: n - n // 50], draw(n // 40)])), np.unique(draw(n)), np.unique(np.concatenate([base[: n // 2], draw(n // 2)]))]
    wide = [S.wide_parities(s) for s in sets]
    assert {len(w) for w in wide if w is not None} == {32, 64} and wide[0] is None
    folded = np.bitwise_xor.reduce(S.parities(sets[0], 64).reshape(2, 32))
    assert (folded == S.parities(sets[0], 32)).all()

    k = len(sets)
    cell = pa.table({"block": [0] * k + [1] * k, "row": [0] * 2 * k, "column": [1] * 2 * k, "component": range(2 * k), "n": [len(s) for s in sets] * 2, "reach": [10**6] * 2 * k, "wide": pa.array(wide * 2, pa.list_(pa.int64()))}
                    | {p: [int(S.parities(s)[i]) for s in sets] * 2 for i, p in enumerate(S.PARITIES)})
    x, y, may = S._likely(cell, 90)
    rows_of = spark.createDataFrame([(i, len(s), None if w is None else w.tolist(), *S.parities(s).tolist()) for i, (s, w) in enumerate(zip(sets, wide))], "node long, n long, wide array<long>, " + ", ".join(f"{p} long" for p in S.PARITIES))  # noqa: B905
    pairs = rows_of.alias("x").crossJoin(rows_of.alias("y")).filter(S._possible("x", "y", 90)).select("x.node", "y.node").collect()
    assert {tuple(r) for r in pairs} == {(i, j) for i in range(k) for j in range(k) if may[i, j]}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 90 * (len(a) + len(b) - both)
            assert may[i, j] or not linked
            if len(a) >= 5000 and len(b) >= 5000:
                assert may[i, j] == linked
    assert sum(may[i, i + 1] for i in range(0, k, 4)) == 5


def test_lists_are_gathered_once(spark, docs, monkeypatch):
    """One shuffle of the lists, and one of those of several sets: not one for what is asked of them and another for the answer."""
    plans = {}
    durable = S.durable

    def spy(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return durable(df, tag)

    monkeypatch.setattr(S, "durable", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        S.similar_sets(docs, 3, 90).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(plans[tag].count("hashpartitioning(band") == 1 for tag in ("join-several", "join-members"))
