import math

import numpy as np
import pytest

from episodica.llm import topk


def brute(rows, every, k):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


def result(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_table_like_brute_force(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    assert result(topk.top_k(e)) == brute([(r.vec_id, r.embedding) for r in e.collect()], 20, 20)


def test_ties_nulls_and_few(spark):
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(60)] + [(100, None), (120, [1.0, None, 2.0]), (140, [1.0, float("nan"), 0.0]), (160, [float("inf"), 0.0, 0.0]), (180, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (61, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert result(topk.top_k(df)) == brute(rows, 20, 20)
    few = df.filter("vec_id in (20, 40, 61)")
    assert result(topk.top_k(few)) == brute([r for r in rows if r[0] in (20, 40, 61)], 20, 20)
    assert topk.top_k(df.limit(0)).count() == 0


def test_cells_prune_but_stay_exact():
    rng = np.random.default_rng(3)
    for scale in (1, 1000, 10**6):
        q, c = rng.integers(-64 * scale, 64 * scale, (64, 30)), rng.integers(-64 * scale, 64 * scale, (64, 5000))
        c[:, :40] += q[:, :1] * 3
        qi, ids = np.arange(30), np.arange(5000) + 7
        a, b, s = topk.best_of_cell(qi, q, ids, c, 20)
        full = q.T @ c
        for i in range(30):
            own = ids != i
            order = np.lexsort((ids[own], -full[i][own]))[:20]
            assert list(b[a == i]) == list(ids[own][order]) and list(s[a == i]) == list(full[i][own][order])


def test_scores_that_fit_no_long_raise(spark):
    df = spark.createDataFrame([(i, [1e9] * 64) for i in (0, 1)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit a long"):
        topk.top_k(df).collect()


def test_streams_of_many_tiles(spark, monkeypatch):
    """Small tiles and blocks: cells begin and end within batches, queries and candidates share them, vectors of several lengths and none."""
    monkeypatch.setattr(topk, "TILE", 7)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 1, 3 if i % 4 else 0 if i % 40 == 0 else 5).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(topk.top_k(df, 20, 6)) == brute(rows, 20, 6)


def test_norms_that_differ_widely(spark, monkeypatch):
    """Seeds and passed-over tiles: the few great vectors are the best of nearly all queries; repeated rows count each; all scores may be negative."""
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    monkeypatch.setattr(topk, "SEEDS", 12)
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(0, 1, 20) * (100.0 if i % 37 == 0 else 0.01 if i % 2 else 1.0)).tolist()) for i in range(700)]
    rows += [(i, [0.0] * 20) for i in range(700, 730)] + rows[:50]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 20, 5).collect())) == plain(rows, 20, 5)
    below = [(i, [-1.0 - i / 7, 2.0]) if i % 20 == 0 else (i, [3.0 + i, -1.0]) for i in range(300)]
    df = spark.createDataFrame(below, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 20, 5).collect())) == plain(below, 20, 5)


def plain(rows, every, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = []
    for i, q in {i: v for i, v in good if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_narrow_types_hold_the_numbers(spark):
    for top, kind in ((32_767, "smallint"), (32_768, "int"), (2**31, "bigint")):
        q = topk._narrow(spark.createDataFrame([(1, [top, -1])], "id long, q array<long>"), top)
        assert q.schema["q"].dataType.elementType.simpleString() == kind and q.first().q == [top, -1]
    for edge in (511.99, -512.0, 512.0, -512.5):  # floor(64 * x) at the ends of the types
        rows = [(i, [edge, float(i)]) for i in range(45)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.top_k(df, 20, 5).collect())) == plain(rows, 20, 5)
