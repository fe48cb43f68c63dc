import random
import re

import numpy as np
import pytest

from episodica.llm import minhash as M
from episodica.llm.components import components


def brute(rows, size, percent):
    """Every pair on full sets; rows of one id are one node."""
    sets = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), root(i) if i is not None and s else i) for i, s in sets), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_table_like_brute_force(docs, size):
    assert result(M.near_duplicates(docs, size, 80)) == brute([(r.doc_id, r.text) for r in docs.collect()], size, 80)


def test_family_of_edits(spark):
    """Copies of one text with edits of many sizes: links at and around the threshold, outliers, chains."""
    rnd = random.Random(4)
    base = [f"word{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 3, 5, 6, 7, 8, 12])):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for k in range(20):  # a chain: neighbours are alike, ends are not
        rows.append((1000 + k, " ".join([f"c{j}" for j in range(k * 4, k * 4 + 100)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(M.near_duplicates(df, 2, 80)) == brute(rows, 2, 80)


def test_blocks_of_cells(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    test_family_of_edits(spark)


def test_odd_rows(odd_docs, no_docs):
    got = M.near_duplicates(odd_docs, 2, 80)
    assert result(got) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 2, 80)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())
    assert M.near_duplicates(no_docs).count() == 0
    kept = M.keep_one(odd_docs, 2)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, None, 8, 9, 10, 11], key=repr) and kept.columns == odd_docs.columns
    assert M.keep_one(no_docs).count() == 0


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(5)
    for j in (0.5, 0.8, 0.95):
        n, err = 400, []
        for _ in range(20):
            common = rng.integers(0, 2**63, int(n * 2 * j / (1 + j))).astype(np.uint64)
            a = np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64)]))
            b = np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common)).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            bits = M.packed_bits(np.array([M.minima(a), M.minima(b)])).view(np.uint64)
            d = bits[0] ^ bits[1]
            differ = int(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())
            assert differ <= M.MINIMA - M.least_matches(80) or true < 0.8
            err.append((1 - differ / M.MINIMA - 0.25) / 0.75 - true)
        assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.08


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 10), (10, 11), (11, 12), (12, 13), (13, 9), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[5] == 4 and got[13] == 9 and 7 not in got and all(got[100 + i] == 100 for i in range(41))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters_of_any_size_lose_nothing(spark):
    """Ids asked for are always among what is left; a filter too small for them gives way to a join."""
    from episodica.durable import durable

    docs = spark.range(20_000).selectExpr("id * 977 - 5000 as k", "id as slot", "'x' as size")
    for n in (0, 1, 700, 9000):
        ids = durable(spark.range(n).selectExpr("(id * 3) * 977 - 5000 as node"), "ids")
        wanted = {i * 3 * 977 - 5000 for i in range(n) if i * 3 < 20_000}
        for most in (M.MOST_BITS, 1 << 10):
            got = [r.k for r in M.maybe_in(docs, "k", ids, most).collect()]
            assert wanted <= set(got) and len(got) == len(set(got)) and len(got) - len(wanted) <= (20_000 - len(wanted)) / 6
            near, sure = M.split_by(docs, "k", ids, most)
            a, b = [r.k for r in near.collect()], [r.k for r in sure.collect()]
            assert wanted <= set(a) and sorted(a + b) == sorted(r.k for r in docs.collect()) and near.columns == docs.columns


def test_filters_pass_few_others(spark):
    """Whole sets are made of what passes a filter."""
    from episodica.durable import durable

    ids = durable(spark.range(9000).selectExpr("id * 11 as node"), "ids")
    assert 9000 <= M.maybe_in(spark.range(99_000).selectExpr("id as k"), "k", ids).count() <= 9000 + 90_000 // 32


def test_joins_in_place_of_filters_give_the_same(docs, monkeypatch):
    a = sorted((r.doc_id, r.component_id) for r in M.near_duplicates(docs, 2, 80).collect())
    kept = sorted(r.doc_id for r in M.keep_one(docs).collect())
    monkeypatch.setattr(M, "maybe_in", lambda df, c, ids, most=0, f=M.maybe_in: f(df, c, ids, 0))
    monkeypatch.setattr(M, "split_by", lambda df, c, ids, most=0, f=M.split_by: f(df, c, ids, 0))
    assert a == sorted((r.doc_id, r.component_id) for r in M.near_duplicates(docs, 2, 80).collect())
    assert kept == sorted(r.doc_id for r in M.keep_one(docs).collect())


def test_estimates_are_corrected_for_chance():
    """Sets of known similarity: the mean estimate is that similarity."""
    rng = np.random.default_rng(9)
    for share in (0.2, 0.5, 0.8):
        found = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 3000, np.uint64)
            n = int(2000 * share / (1 + share) * 1.5)
            a, b = np.unique(x[:1500]), np.unique(np.concatenate([x[:n], x[1500 : 3000 - n]]))
            bits = M.packed_bits(np.stack([M.minima(a), M.minima(b)])).view(np.uint64)
            d = bits[0] ^ bits[1]
            found.append(M.estimate(int(np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum())))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(found) - true) < 0.03, (share, np.mean(found), true)
