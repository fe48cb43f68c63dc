"""Operators against plain Python and numpy on small frames, properties, and faults."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import closed_forms as C
from episodica.functions import mapping as M
from episodica.functions import text as X
from episodica.functions import vectors as V
from episodica.functions.normalize import Scaling, normalized
from episodica.operators import aggregates as A
from episodica.operators import align as L
from episodica.operators import batching as B
from episodica.operators import datasets as D
from episodica.operators import quality as Q
from episodica.operators import sampling as P
from episodica.operators import stats as S
from episodica.operators import windows as W
from episodica.sources import scans, sinks


def frames(spark, sizes=(1, 7, 60)):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(e, i, float(rng.normal())) for e, n in enumerate(sizes) for i in range(n)], "episode long, frame long, x double")


def test_chunk_holds_the_tail(spark):
    df = frames(spark)
    got = {(r.episode, r.frame): (r.chunk, r.chunk_is_pad) for r in W.future_chunk(df, "x", 50, ["episode"], ["frame"]).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.episode, {})[r.frame] = r.x
    for (e, f), (chunk, pad) in got.items():
        n = len(by[e])
        assert chunk == [by[e][min(f + h, n - 1)] for h in range(50)]
        assert pad == [f + h >= n for h in range(50)]


def test_resample_and_interpolate_like_numpy(spark):
    df = frames(spark)
    got = {}
    for r in L.resample(df, "x", 25, ["episode"], ["frame"]).collect():
        got.setdefault(r.episode, {})[r.k] = r.x
    for e in (0, 1, 2):
        x = [r.x for r in df.filter(F.col("episode") == e).orderBy("frame").collect()]
        want = np.interp(np.linspace(0, 1, 25), np.linspace(0, 1, len(x)), x) if len(x) > 1 else np.repeat(x, 25)
        assert np.allclose([got[e][k] for k in range(25)], want)
    samples = spark.createDataFrame([(0, 10, 1.0), (0, 20, 3.0), (0, 40, -1.0)], "episode long, t long, x double")
    clock = spark.createDataFrame([(0, t) for t in (5, 10, 15, 20, 33, 40, 99)], "episode long, t long")
    lin = {r.t: r.x for r in L.interpolate(clock, samples, ["episode"], "t", ["x"]).collect()}
    assert np.allclose([lin[t] for t in sorted(lin)], np.interp(sorted(lin), [10, 20, 40], [1, 3, -1]))
    zoh = {r.t: r.x for r in L.zero_order_hold(clock, samples, ["episode"], "t", ["x"]).collect()}
    assert zoh == {5: 1.0, 10: 1.0, 15: 1.0, 20: 3.0, 33: 3.0, 40: -1.0, 99: -1.0}
    assert L.order_faults(samples.union(samples.limit(1)), ["episode"], "t", ["x"]).count() == 1


def test_alignment_without_samples(spark):
    empty = spark.createDataFrame([], "episode long, t long, x double")
    clock = spark.createDataFrame([(0, 1)], "episode long, t long")
    assert L.zero_order_hold(clock, empty, ["episode"], "t", ["x"]).first().x is None


def test_exact_stats_like_numpy(spark):
    r = A.exact_stats(frames(spark), ["episode"], "x").filter("episode = 2").first()
    x = np.array([v.x for v in frames(spark).filter("episode = 2").collect()])
    assert np.allclose([r["mean"], r["std"], r["min"], r["max"], r.q01, r.q99], [x.mean(), x.std(), x.min(), x.max(), *np.quantile(x, [0.01, 0.99])])
    exact = A.from_moments(A.moments(["episode"], frames(spark), "x").withColumn("k", F.lit(1)), ["k"]).first()
    everything = np.array([v.x for v in frames(spark).collect()])
    assert np.allclose([exact["mean"], exact["std"]], [everything.mean(), everything.std()])


def test_normalization_inverts(spark):
    stats = {"mean": [1.0, 2.0], "std": [0.0, 3.0], "min": [-1.0, 0.0], "max": [1.0, 0.0], "q01": [0.0, 0.0], "q99": [1.0, 5.0]}
    from episodica.functions.normalize import unnormalized

    df = spark.createDataFrame([([0.5, -7.0],), ([1e3, 2.0],)], "v array<double>")
    for kind in ("meanstd", "bounds_99", "minmax", "identity"):
        s = Scaling(kind, stats)
        for r in df.select("v", unnormalized(normalized(F.col("v"), s), s).alias("b")).collect():
            assert np.allclose(r.v, r.b)
    assert df.select(normalized(F.col("v"), Scaling("meanstd", None)).alias("n")).first().n == [0.5, -7.0]
    with pytest.raises(ValueError):
        normalized(F.col("v"), Scaling("other", stats))


def test_mapping_faults():
    with pytest.raises(ValueError):
        M.Feature("action.effector.position", "x", relative_to="state")
    with pytest.raises(ValueError):
        M.FeatureMap((M.Feature("a", "b"),)).check(["c"])


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10, 0.05), (12.706, 1, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0), (3.169, 10, 0.01)])
def test_student_tail(t, df, p):
    assert abs(float(S.two_sided_p([t], [df])[0]) - p) < 2e-4


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.5, float("nan")]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    q = {r.i: r.q for r in S.benjamini_hochberg(df, "p", ["i"]).collect()}
    ordered = sorted((1.0 if math.isnan(p) else p, i) for i, p in enumerate(ps))
    want, least = {}, 1.0
    for rank in range(len(ps), 0, -1):
        p, i = ordered[rank - 1]
        least = min(least, p * len(ps) / rank)
        want[i] = least
    assert all(abs(q[i] - want[i]) < 1e-12 for i in want)


def test_budget_packer_keeps_all_and_the_budget(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(1, 150)), int(i % 3)) for i in range(200)] + [(999, 5000, 0)]
    df = spark.createDataFrame(rows, "id long, n long, shard long")
    from episodica.shipping import ship_package

    ship_package(spark)
    got = B.packed_by_budget(df, "id", "n", "shard", 300, 8).collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    sums = {}
    for r in got:
        sums.setdefault((r.shard, r.batch), []).append(r.n)
    assert all(sum(v) <= 300 or len(v) == 1 for v in sums.values())
    buffer = B.BudgetBuffer([(1, 200), (2, 200), (3, 100)])
    assert buffer.take(300) == [(1, 200), (3, 100)] and buffer.items == [(2, 200)]
    assert B.BudgetBuffer().take(10) == []


def test_stream_packs_like_the_batch(spark, tmp_path):
    from episodica.shipping import ship_package
    from episodica.streaming.monitor import run_to_end
    from episodica.streaming.packing import packed_stream

    ship_package(spark)
    src, schema = str(tmp_path / "src"), "shard long, sample_id long, length long"
    spark.createDataFrame([(i % 2, i, 10 + i % 7) for i in range(40)], schema).coalesce(1).write.parquet(src)
    run = lambda: run_to_end(packed_stream(spark.readStream.schema(schema).parquet(src), 50, 5), str(tmp_path / "cp"), str(tmp_path / "out"))
    run()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    spark.createDataFrame([(i % 2, i, 10 + i % 7) for i in range(40, 80)], schema).coalesce(1).write.mode("append").parquet(src)
    run()  # goes on from the checkpoint
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert first < len(got) and len({r.sample_id for r in got}) == len(got)
    sums = {}
    for r in got:
        sums[r.shard, r.batch] = sums.get((r.shard, r.batch), 0) + r.length
    assert max(sums.values()) <= 50


def test_splits_partition(spark):
    df = spark.range(1003).withColumn("g", F.col("id") % 3 == 0)
    out = P.stratified_split(df, "id", ["g"], 0.1, 5)
    assert out.count() == 1003 and out.filter("is_test").count() == round(1003 * 0.1)
    assert P.stratified_sample(df, "id", ["g"], 64, 5).count() == 64


def test_reasons_take_the_first(spark):
    df = spark.createDataFrame([(1, None), (5, 2), (9, 9)], "a int, b int")
    got = [r.reason for r in D.reasons(df, [("small", F.col("a") < 3), ("equal", F.col("a") == F.col("b"))]).orderBy("a").collect()]
    assert got == ["small", None, "equal"]


def test_schemas_are_not_coerced(spark):
    with pytest.raises(ValueError):
        D.same_schema(spark.range(1), spark.range(1).select(F.col("id").cast("int")))


def test_integrity_finds_faults(spark):
    df = spark.createDataFrame([(0, 0, [1.0]), (0, 2, [float("nan")]), (1, 0, [1.0])], "e long, f long, v array<double>")
    ep = spark.createDataFrame([(0, 3), (1, 1), (2, 4)], "e long, n long")
    got = {r.e: (r.bad_length, r.bad_index, r.nonfinite) for r in Q.integrity(df, ep, "e", "f", "n", ["v"], 1).collect()}
    assert got == {0: (True, True, 1), 1: (False, False, 0), 2: (True, False, 0)}


def test_prefix_weights_closed_form(spark):
    for start, end, total in ((20, 25, 50), (20, 30, 50), (0, 30, 50), (25, 25, 50)):
        got = [r.w for r in spark.range(total).select(C.prefix_weight(F.col("id"), start, end, total).alias("w")).collect()]
        for i, w in enumerate(got):
            c = max(0.0, min(1.0, (start - 1 - i) / (end - start + 1) + 1))
            assert abs(w - (0 if i >= end else c * math.expm1(c) / (math.e - 1))) < 1e-12


def test_recent_delay(spark):
    rows = [0.69, 0.74] + [0.1] * 10
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(rows)], "c int, i int, x double")
    got = [r.delay for r in W.recent_delay(df, "x", 30.0, ["c"], ["i"]).orderBy("i").collect()]
    assert got[0] == 21 and got[1] == 23 and got[-1] == 3


def test_templates_raise(spark):
    with pytest.raises(ValueError):
        X.template("other")
    with pytest.raises(Exception, match="unknown role"):
        spark.createDataFrame([("robot", "x")], "r string, c string").select(X.instructed(F.col("r"), F.col("c"))).collect()


def test_empty_vectors(spark):
    r = spark.createDataFrame([([],), (None,)], "v array<int>").select(V.chunks(F.col("v"), 3).alias("c"), V.indices(F.size("v")).alias("i")).first()
    assert r.c == [] and r.i == []


def test_readers_and_writers(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    with pytest.raises(FileNotFoundError):
        scans.read_files(spark, at("none.parquet"))
    (tmp_path / "a.xyz").write_text("1")
    with pytest.raises(ValueError):
        scans.read_files(spark, at("a.xyz"))
    df = frames(spark)
    sinks.write_episodes(df, at("eps"), "episode", "frame", 2)
    assert sinks.verify(df, at("eps")) == 0
    with pytest.raises(Exception, match="already exists"):
        sinks.write_episodes(df, at("eps"), "episode", "frame", 2)
    assert scans.read_files(spark, at("eps")).count() == df.count()
    sinks.write_document(spark, {"a": [1, "é"]}, at("m/doc.json"))
    assert scans.read_document(spark, at("m/doc.json")) == {"a": [1, "é"]}
    with pytest.raises(FileExistsError):
        sinks.write_document(spark, {}, at("m/doc.json"))
    (tmp_path / "l.jsonl").write_text('{"a":1}\nnope\n{"a":2}\n')
    assert scans.lenient_json(spark, at("l.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        scans.strict_json(spark, at("l.jsonl"), "a int").collect()
    from pyspark.sql import types as T

    s = T.StructType([T.StructField("a", T.IntegerType())])
    for i, body in enumerate(('[{"a":1},{"a":2}]', '{"a":1},{"a":2}', '{"a":1}\nx\n{"a":2}')):
        (tmp_path / f"s{i}.jsonl").write_text(body)
        assert sorted(r.a for r in scans.lenient_stats(spark, at(f"s{i}.jsonl"), s).collect()) == [1, 2]
    sinks.write_csv(spark.createDataFrame([(1, True)], "a int, b boolean"), at("c"))
    assert scans.read_files(spark, at("c"), "a int, b string").first().b == "True"
    sinks.write_json_lines(df, at("j"))
    assert scans.read_files(spark, at("j"), df.schema).count() == df.count()
    stats = A.exact_stats(A.long_form(spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],)], "v array<double>"), ["v"]), ["feature", "dim"])
    doc = json.loads(json.dumps(sinks.stats_document(stats)))
    assert doc["v"]["mean"] == [2.0, 3.5]
    assert sinks.stats_table(spark, doc).count() == 2
    import pyarrow as pa

    t = pa.table({"a": [1, 2, 3]})
    with pa.OSFile(at("t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert scans.read_files(spark, at("t.arrow"), "a long").count() == 3
    digest = scans.content_digest(spark.read.format("binaryFile").load(at("a.xyz"))).first()
    assert digest.sha256 == "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"


def test_rounding_keeps_what_is_not_finite(spark):
    from episodica.plans.base import r6

    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, 1e15), (5, 0.1234567), (6, None)], "k int, x double")
    got = {r.k: r.y for r in df.select("k", r6(F.col("x")).alias("y")).collect()}
    assert math.isnan(got[1]) and got[2] == math.inf and got[3] == -math.inf and got[4] == 1e15 and got[5] == 0.123457 and got[6] is None


def test_loss_of_an_impossible_label(spark, tmp_path):
    """A probability of 0 has an infinite loss, and is not passed over."""
    from episodica.plans.catalog import ORACLES, QUERIES
    from tests.compare import rows

    spark.createDataFrame([(1, "a", 0.0), (2, "a", 250.0), (3, "b", 0.0), (4, "b", 250.0), (5, "c", -1.0), (7, "d", None)], "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["masked_cross_entropy"](spark, str(tmp_path)).toPandas()
    want = duckdb.sql(ORACLES["masked_cross_entropy"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")).df()
    assert rows(got) == rows(want) and math.isinf(got.set_index("event_type").loss["a"])


def test_rotation_beyond_a_unit_quaternion(spark, tmp_path):
    """A w above 1 leaves no real vector part: the result is not a number, and not a rotation by nothing."""
    from episodica.plans.catalog import ORACLES, QUERIES
    from tests.compare import rows

    spark.createDataFrame([(1, 560.21), (2, 100.0), (3, 0.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["quaternions"](spark, str(tmp_path)).toPandas()
    want = duckdb.sql(ORACLES["quaternions"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")).df()
    assert rows(got) == rows(want) and got.set_index("event_id").x.isna()[1]


def test_sketch_is_near_by_ranks(spark):
    """Where the exact quantile lies between two values far apart, the sketch has one of them: near by rank, though not by value. A wrong one is not."""
    rows = spark.range(5000).select(F.lit(0).alias("dim"), F.when(F.col("id") < 100, 1.0).otherwise(50.0).alias("value"))
    y = A.sketched_stats(rows, ["dim"])
    assert A.ranks_near(rows, ["dim"], "value", y, A.QUANTILES, 0.001).first().near
    assert not A.ranks_near(rows, ["dim"], "value", y.withColumn("q02", F.lit(49.0)).withColumn("q01", F.lit(50.0)), A.QUANTILES, 0.001).first().near


def test_stats_sketch_of_few_values(spark, tmp_path):
    from episodica.plans.catalog import QUERIES

    rows = spark.range(5000).select(F.col("id").alias("l_orderkey"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.when(F.col("id") < 100, 1.0).otherwise(2.0).alias("l_quantity"))
    rows.select("*", *(F.col("l_quantity").alias(c) for c in ("l_extendedprice", "l_discount", "l_tax"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert all(r.close for r in QUERIES["stats_sketch"](spark, str(tmp_path)).collect())


def test_mapping_of_a_known_horizon(spark):
    """Chunks of the expected sizes come from generated code, others as before: the same numbers, and no lambda on the way."""
    stats = {"mean": [1.0, 2.0], "std": [0.5, 3.0], "q01": [0.0, 1.0], "q99": [4.0, 9.0]}
    sc = {"state": Scaling("meanstd", stats), "action": Scaling("bounds_99", stats)}
    df = spark.createDataFrame([([1.0, 2.0], [[3.0, 4.0], [5.0, 7.0]]), ([0.5, -2.0], [[1.0, 1.0]]), ([0.5, -2.0], [[1.0, 1.0], None]), (None, [[1.0, 1.0], [2.0, 3.0]]), ([1.0, 2.0], [[None, 4.0], [5.0, 7.0]])], "v array<double>, c array<array<double>>")
    for relative in (True, False):
        got = []
        for h in (None, 2):
            state, acts, mask = M.apply(F.col("v"), F.col("c"), sc, 4, relative, h)
            made = df.select(state.alias("s"), acts.alias("a"), mask.alias("m"))
            got.append((made.collect(), made.select(*M.unapply(F.col("s"), F.col("a"), sc, 2, relative, h)).collect()))
        assert got[0] == got[1]
    assert got[1][1][0][1] == [pytest.approx([3.0, 4.0]), pytest.approx([5.0, 7.0])]


def test_every_pair(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 3.0]), ([1.0, None], [1.0, 2.0]), ([None, 1.0], [1.0, 2.0]), ([1.0], [1.0]), ([1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    same = lambda n: [r[0] for r in df.select(V.every(F.col("x"), F.col("y"), lambda a, b: a == b, n)).collect()]
    assert same(None) == same(2) == [True, False, None, False, True, None]


def test_deltas_of_a_known_horizon(spark):
    df = spark.createDataFrame([([1.0, 2.0], [[3.0, 4.0], [5.0, 7.0]]), ([1.0, 2.0], [[3.0, 4.0]]), ([1.0, 2.0], [[3.0], [5.0, 7.0]]), (None, [[1.0, 1.0], [2.0, 3.0]]), ([1.0, 2.0], None)], "v array<double>, c array<array<double>>")
    both = df.select(M.to_delta(F.col("c"), F.col("v")).alias("a"), M.to_delta(F.col("c"), F.col("v"), 2, 2).alias("b")).collect()
    assert all(r.a == r.b for r in both) and both[0].b == [[2.0, 2.0], [4.0, 5.0]]
