"""Operators that deal a table by ranges, so that a key or a table of any length is many tasks: against plain loops."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import align as L
from episodica.operators import batching as B
from episodica.operators import histograms as H
from episodica.operators import windows as W


def around(samples, t, how):
    """samples: (time, value) in order; what the clock's time t gets."""
    past, future = [s for s in samples if s[0] <= t], [s for s in samples if s[0] > t]
    if not samples:
        return None
    if how == "hold":
        return past[-1][1] if past else future[0][1]
    if how == "nearest":
        return past[-1][1] if past and (not future or t - past[-1][0] <= future[0][0] - t) else future[0][1]
    if not past or not future:
        return (past or future[:1])[-1][1] * 1.0
    (t0, a), (t1, b) = past[-1], future[0]
    return a + (b - a) * ((t - t0) / (t1 - t0))


@pytest.mark.parametrize("key_rows", [0, 10**6])
def test_streams_on_a_clock(spark, monkeypatch, key_rows):
    """A long key, short ones, one without samples, a null one; ranges that hold no sample at all, and clock rows before and after all samples."""
    monkeypatch.setattr(L, "KEY_ROWS", key_rows)
    rnd = random.Random(4)
    keys, held, clock = ["long", "a", None, "none"], {}, []
    for k in keys:
        n = {"long": 300, "none": 0}.get(k, 5)
        held[k] = sorted({rnd.choice([rnd.randrange(0, 2000), rnd.randrange(9000, 9400)]): None for _ in range(n)})
        held[k] = [(t, rnd.randrange(100)) for t in held[k]]
        clock += [(k, rnd.randrange(-500, 12_000)) for _ in range(400 if k == "long" else 6)]
    clock += [("long", 100)] * 3 + [("a", None)]
    samples = spark.createDataFrame([(k, t, v) for k in keys for t, v in held[k]] + [("a", None, 999)], "k string, t long, v long")
    other = samples.withColumnRenamed("v", "h")
    third = samples.select("k", "t", samples.v.alias("near"))
    vectors = samples.selectExpr("k", "t", "array(v, 2 * v) as vec")
    streams = [L.Stream(samples, ["v"]), L.Stream(other, ["h"], "hold"), L.Stream(third, ["near"], "nearest"), L.Stream(vectors, ["vec"])]
    got = L.fused(spark.createDataFrame(clock, "k string, t long"), streams, ["k"], "t").collect()
    assert sorted(((r.k, r.t) for r in got), key=repr) == sorted(clock, key=repr)
    for r in got:
        own = held[r.k] if r.t is not None else []
        v = around(own, r.t, "linear")
        assert (r.v is None) == (v is None) and (v is None or math.isclose(r.v, v)), r
        assert r.h == around(own, r.t, "hold") and r.near == around(own, r.t, "nearest")
        assert r.vec is None if v is None else np.allclose(r.vec, [v, 2 * v])


def test_one_key_takes_time_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(L, "KEY_ROWS", 1000)
    seconds = []
    for n in (20_000, 160_000):
        clock = spark.range(n).selectExpr("1 as k", "id * 10 + 3 as t")
        samples = spark.range(n).selectExpr("1 as k", "id * 10 as t", "cast(id as double) as v")
        start = time.time()
        r = L.interpolate(clock, samples, ["k"], "t", ["v"]).selectExpr("count(*) as n", "max(abs(v - least((t / 10), %d))) as off" % (n - 1)).first()
        seconds.append(time.time() - start)
        assert r.n == n and r.off < 1e-6
    assert seconds[1] < 8 * seconds[0] + 5  # quadratic work would be 64 times as much


def test_streams_that_cannot_be_used(spark):
    clock = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k int, t int")
    samples = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (2, 4, 1.0), (3, None, 1.0)], "k int, t int, v double")
    assert {tuple(r) for r in L.stream_faults(clock, samples, ["k"], "t").collect()} == {(1, "repeated"), (3, "empty")}
    with pytest.raises(ValueError, match="invalid streams"):
        L.checked(clock, samples, ["k"], "t")
    assert L.checked(clock.filter("k = 2"), samples.filter("k = 2"), ["k"], "t").count() == 1


@pytest.mark.parametrize("n, size", [(0, 4), (3, 5), (57, 1), (57, 9), (57, 60), (400, 100)])
def test_moving_means_of_a_whole_table(spark, n, size):
    """Windows that reach over several ranges, longer than a range and longer than the table."""
    rnd = random.Random(n)
    rows = [(i * 2, rnd.random()) for i in range(n)]
    df = spark.createDataFrame(rnd.sample(rows, n), "i long, x double").repartition(3)
    x = [v for _, v in rows]
    want = {i: np.mean(x[max(0, j - size + 1) : j + 1]) for j, (i, _) in enumerate(rows)}
    got = {r.i: r.smooth for r in W.trailing_mean(df, "x", size, [], ["i"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)
    full = {r.i: r.smooth for r in W.trailing_mean(df, "x", size, [], ["i"], full_only=True).collect()}
    want = dict(rows) if n < size else {i: want[i] for j, (i, _) in enumerate(rows) if j >= size - 1}
    assert full.keys() == want.keys() and all(math.isclose(full[i], want[i]) for i in full)


def fit(sizes, limit):
    used, place, out = 0, 0, []
    for n in sizes:
        if used and used + n > limit:
            used, place = 0, place + 1
        used += n
        out.append(place)
    return out


def test_next_fit_by_ranges(spark):
    """One source with all rows, with sizes of zero, over the limit, and all alike; several sources; none."""
    rnd = random.Random(6)
    cases = [
        [rnd.choice([0, 0, 1, 3, 7, 50, 120]) for _ in range(700)], [5] * 300, [0] * 90 + [200] + [0] * 90, [200] * 50, [1] * 500, [0] * 60,
        [100, 0] * 60, [rnd.randrange(1, 101) for _ in range(900)], [0] * 200 + [1] * 200 + [300] * 5 + [0] * 100 + [99, 1, 1] * 40, [7],
    ]
    for sizes in cases:
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i long, n long").repartition(3)
        got = {r.i: r.bin for r in B.next_fit(df, "i", "n", [], 100).collect()}
        assert [got[i] for i in range(len(sizes))] == fit(sizes, 100)
    rows = [(k if k else None, i, n) for k, sizes in enumerate(cases) for i, n in enumerate(sizes)]
    got = {(r.k, r.i): r.bin for r in B.next_fit(spark.createDataFrame(rows, "k long, i long, n long").repartition(5), "i", "n", ["k"], 100).collect()}
    assert got == {(k if k else None, i): b for k, sizes in enumerate(cases) for i, b in enumerate(fit(sizes, 100))}
    assert B.next_fit(spark.createDataFrame([], "i long, n long"), "i", "n", [], 100).count() == 0


def test_summaries_of_a_run_of_items():
    rnd = random.Random(9)
    for _ in range(3000):
        sizes, limit = [rnd.choice([0, 0, 1, 2, 5, 9, 14]) for _ in range(rnd.randint(1, 25))], 10
        upto = np.concatenate([[0], np.cumsum(sizes)])
        starts, bins, rest = B._entries(upto, limit)
        for used in (None, *range(13)):
            in_use, new = used, 0
            for n in sizes:
                if in_use is None or (in_use and in_use + n > limit):
                    in_use, new = 0, new + 1
                in_use += n
            assert B._follow(upto[starts].tolist(), bins, rest, int(upto[-1]), used, limit) == (in_use, new), (sizes, used)


def test_histograms_merge_like_a_loop_over_batches(spark):
    """States of batches whose ranges grow, merged one after the other and all at once, against numpy in the same order and against exact quantiles."""
    rng, bins, q = np.random.default_rng(3), 5000, {"q01": 0.01, "q02": 0.02, "q98": 0.98, "q99": 0.99}
    batches = [rng.normal(0, s, 3000) for s in (0.5, 1.0, 3.0, 2.0)] + [np.full(500, 1.25)]
    states = [H.histogram(spark.createDataFrame([("g", float(x)) for x in b], "g string, x double"), "x", ["g"], bins) for b in batches]
    low, high, counts = batches[0].min(), batches[0].max(), None
    chain = states[0]
    for b, s in zip(batches, states):
        new_low, new_high = min(low, b.min()), max(high, b.max())
        place = lambda x, lo, hi: np.clip(np.floor((x - lo) / (hi - lo) * bins), 0, bins - 1).astype(int)
        if counts is not None:
            if (new_low, new_high) != (low, high):
                moved = np.zeros(bins, int)
                np.add.at(moved, place(low + (high - low) * np.arange(bins) / bins, new_low, new_high), counts)
                counts = moved
            chain = H.merged([chain, s])
        own = np.zeros(bins, int)
        blow, bhigh = b.min(), b.max()
        np.add.at(own, place(b, blow, bhigh) if bhigh > blow else np.zeros(len(b), int), 1)
        if (blow, bhigh) != (new_low, new_high):
            moved = np.zeros(bins, int)
            edges = blow + (bhigh - blow) * np.arange(bins) / bins
            np.add.at(moved, place(edges, new_low, new_high), own)
            own = moved
        counts = own if counts is None else counts + own
        low, high = new_low, new_high
    every = np.concatenate(batches)
    loop = {name: low + (high - low) * int(np.searchsorted(np.cumsum(counts), p * len(every))) / bins for name, p in q.items()}
    for state, exact_loop in ((chain, True), (H.merged(states), False)):
        r = H.statistics(state, q).first()
        assert r.n == len(every) and (r.low, r.high) == (every.min(), every.max())
        assert math.isclose(r["mean"], every.mean(), abs_tol=1e-9) and math.isclose(r["std"], every.std(), rel_tol=1e-9)
        for name, p in q.items():
            assert abs(r[name] - np.quantile(every, p, method="inverted_cdf")) <= len(batches) * (high - low) / bins
            assert not exact_loop or math.isclose(r[name], loop[name], abs_tol=1e-9)


def test_states_are_met_without_their_joins(spark):
    """What a driver holds of merged states doesn't grow with their number: no join of theirs is left in the plan."""
    parts = [spark.range(5).select(F.lit("g").alias("g"), (F.col("id") * k).cast("double").alias("x")) for k in (1, 2, 3)]
    one = H.merged([H.histogram(p, "x", ["g"], 10) for p in parts])
    assert "Join" not in one.counts._jdf.queryExecution().optimizedPlan().toString()
    assert one.counts.agg(F.sum("count")).first()[0] == 15


def test_histograms_of_odd_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", float("inf")), ("b", 2.0), ("b", 2.0), (None, 0.0), (None, 10.0)], "g string, x double")
    got = {r.g: tuple(r)[1:] for r in H.statistics(H.histogram(df, "x", ["g"], 10), {"q50": 0.5, "q99": 0.99}).collect()}
    assert got == {"a": (1, 1.0, None, 1.0, 1.0, None, None), "b": (2, 2.0, 0.0, 2.0, 2.0, 2.0, 2.0), None: (2, 5.0, 5.0, 0.0, 10.0, 0.0, 9.0)}
    with pytest.raises(ValueError):
        H.merged([H.histogram(df, "x", ["g"], 10), H.histogram(df, "x", ["g"], 20)])
    assert H.statistics(H.histogram(df.limit(0), "x", ["g"]), {"q": 0.5}).count() == 0


@pytest.mark.parametrize("longest", [3, 900])
def test_overlaps_of_spans_of_any_length(spark, longest):
    rnd = random.Random(longest)
    spans = lambda n: [(rnd.choice([1, 2, None]), i, (lo := rnd.randrange(-200, 400)), lo + (rnd.randrange(0, longest) if rnd.random() < 0.1 else rnd.randrange(0, 4))) for i in range(n)]
    x, y = spans(150), spans(130)
    a, b = spark.createDataFrame(x, "k int, i int, lo long, hi long"), spark.createDataFrame(y, "k int, j int, lo2 long, hi2 long")
    got = sorted((r.k, r.i, r.j, r.overlap) for r in L.overlaps(a, b, ["k"], ("lo", "hi"), ("lo2", "hi2")).collect())
    want = sorted((p[0], p[1], q[1], min(p[3], q[3]) - max(p[2], q[2])) for p in x for q in y if p[0] is not None and p[0] == q[0] and max(p[2], q[2]) < min(p[3], q[3]))
    assert got == want


def test_p_of_cells_without_variance_or_degrees(spark):
    """Constant cells: 1 where means are equal, 0 where not, and so they count in the rates of false discovery; one value has no test."""
    from episodica.operators import stats as S
    from episodica.shipping import ship_package

    ship_package(spark)
    rows = [(1, u, 5.0) for u in (True, False)] * 3 + [(2, u, 5.0 + u) for u in (True, False)] * 3 + [(3, u, float(i % 5 + u)) for i in range(8) for u in (True, False)]
    t = S.welch(spark.createDataFrame(rows, "c int, u boolean, x double"), ["c"], "u", "x").withColumn("p", S.welch_p())
    got = {r.c: (r.p, r.q) for r in S.benjamini_hochberg(t, "p", ["c"]).collect()}
    assert got[1] == (1.0, 1.0) and got[2] == (0.0, 0.0) and 0.1 < got[3][0] < 0.4 and math.isclose(got[3][1], got[3][0] * 1.5)
    one = S.one_sample(spark.createDataFrame([(1, 3.0), (2, 1.0), (2, 2.0), (2, 4.5)], "c int, x double"), ["c"], "x", 1.0)
    got = {r.c: r.p for r in one.select("c", S.p_value(one.t, one.df).alias("p")).collect()}
    t = 1.5 / (np.std([1.0, 2.0, 4.5], ddof=1) / math.sqrt(3))
    assert got[1] is None and math.isclose(got[2], 1 - t / math.sqrt(t * t + 2), rel_tol=1e-9)  # two degrees have a closed form


def test_relabellings_by_slices_like_whole_ranks(spark, monkeypatch):
    """Slices of any width and units with null values: the same p as ranking all units in each relabelling."""
    import hashlib

    from episodica.operators import stats as S

    rnd = random.Random(5)
    units = [(i, i % 3 == 0, None if i % 11 == 0 else rnd.random() + 0.1 * (i % 3 == 0)) for i in range(120)]
    mean = lambda xs: sum(xs) / len(xs)
    some = lambda ids: [x for i, _, x in units if i in ids and x is not None]
    own = {i for i, u, _ in units if u}
    observed, hits = mean(some(own)) - mean(some({i for i, u, _ in units if not u})), 0
    for rep in range(1, 200):
        order = sorted((hashlib.md5(f"3|{rep}|{i}".encode()).hexdigest(), i) for i, _, _ in units)
        ids = {i for _, i in order[: len(own)]}
        hits += abs(mean(some(ids)) - mean(some({i for i, _, _ in units} - ids))) >= abs(observed) - 1e-12
    for digits in (1, 3):
        monkeypatch.setattr(S, "SLICE_DIGITS", digits)
        r = S.permutation_test(spark.createDataFrame(units, "i long, u boolean, x double"), "i", "u", "x", 199, 3).first()
        assert math.isclose(r.observed, observed) and math.isclose(r.p, (1 + hits) / 200)


def test_permutation_of_few_bytes_is_many_tasks(spark, monkeypatch):
    """Units of few bytes and much work are dealt by number, and a border that isn't where it is looked for is found all the same."""
    from episodica.operators import stats as S

    units = spark.range(400).repartition(1).select(F.col("id").alias("i"), (F.col("id") % 3 == 0).alias("u"), F.sqrt(F.col("id").cast("double")).alias("x"))
    want = S.permutation_test(units, "i", "u", "x", 49, 3).first()
    seen, kept = [], S._relabelled

    def watched(base, seed, reps, k, low, high):
        seen.append((base.rdd.getNumPartitions(), low, high))
        return kept(base, seed, reps, k, low, high)

    monkeypatch.setattr(S, "_relabelled", watched)
    monkeypatch.setattr(S, "BORDER_DEVIATIONS", 0.5)
    assert S.permutation_test(units, "i", "u", "x", 49, 3).first() == want
    assert [n for n, _, _ in seen] == [4, 4] and seen[1][1:] == ("", "g")
