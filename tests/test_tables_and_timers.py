"""Routing, table functions and timers against plain loops."""

import math
import random
import time

import numpy as np

from episodica.operators import batching as B
from episodica.operators import routing as R
from episodica.operators import table_functions
from episodica.streaming import alarms


def test_routing_like_a_loop(spark):
    rng = np.random.default_rng(1)
    n, experts, k, d = 70, 6, 3, 4
    scores, x = rng.integers(0, 4, (n, experts)).astype(float), rng.normal(size=(n, d))
    df = spark.createDataFrame([(i, scores[i].tolist(), x[i].tolist()) for i in range(n)], "t long, s array<double>, x array<double>").repartition(3)
    routed = R.routes(df, "t", "s", k)
    want, out = [], np.zeros((n, d))
    for i in range(n):
        chosen = sorted(range(experts), key=lambda e: (-scores[i][e], e))[:k]
        w = np.exp(scores[i][chosen] - scores[i].max())
        for c, (e, own) in enumerate(zip(chosen, w / w.sum(), strict=True)):
            want.append((e, i, c, own))
            out[i] += own * (e + 1) * x[i]
    want.sort()
    placed = sorted((r.place, r.expert, r.t, r.choice, r.weight) for r in R.placed(routed, "t").collect())
    assert [p[:4] for p in placed] == [(j, *w[:3]) for j, w in enumerate(want)] and np.allclose([p[4] for p in placed], [w[3] for w in want])
    counts = np.bincount([w[0] for w in want], minlength=experts)
    assert [(r.expert, r.n, r.first) for r in R.offsets(routed.filter("expert <> 2"), experts).orderBy("expert").collect()][:2] == [(0, counts[0], 0), (1, counts[1], counts[0])]
    assert {r.expert: r.n for r in R.offsets(routed.filter("expert <> 2"), experts).collect()}[2] == 0
    done = R.gathered(routed, df, "t", ["x"]).selectExpr("t", "weight", "transform(x, v -> v * (expert + 1)) as x")
    got = {r.t: r.x for r in R.combined(done, "t", "x", d).collect()}
    assert np.allclose([got[i] for i in range(n)], out)
    whole = {r.t: r.w for r in R.routes(df, "t", "s", k, renormalize=False).groupBy("t").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()}
    assert all(math.isclose(whole[i], np.sort(np.exp(scores[i]) / np.exp(scores[i]).sum())[-k:].sum()) for i in range(n))
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0])], "t long, s array<double>")
    assert [(r.t, r.expert, r.weight) for r in R.routes(odd, "t", "s", 2).collect()] == [(3, 1, 1.0)]


def test_packing_by_a_table_function(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([1, 5, 30, 80])) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, i long, n long").repartition(4)
    table_functions.register(spark)
    df.createOrReplaceTempView("__rows")
    got = spark.sql("select * from pack_by_budget(table(__rows) partition by (s) order by (i), 100, 7)").collect()
    want = B.packed_by_budget(df, "i", "n", "s", 100, 7).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    pieces = spark.sql("select k, c.* from (select explode(array(0, 3, 4, 9, null)) as k), lateral text_pieces(k, 4) as c").collect()
    assert sorted(map(tuple, pieces)) == [(0, 0, 1), (3, 0, 4), (4, 0, 4), (4, 1, 1), (9, 0, 4), (9, 1, 4), (9, 2, 2)]


def test_alarms_by_the_logs_clock_and_after_a_restart(spark, tmp_path):
    """The watermark is the clock. A new row puts an alarm off; an alarm comes once; what was due while the query was down comes after it."""
    spark.conf.set(*alarms.PROVIDER)
    log, out = tmp_path / "log", tmp_path / "out"
    put = lambda k, rows: spark.createDataFrame(rows, "run string, ts long").selectExpr("run", "timestamp_seconds(ts) as ts").coalesce(1).write.mode("append").parquet(str(log))

    def step():
        stream = spark.readStream.schema("run string, ts timestamp").parquet(str(log))
        found = alarms.silence_alarms(stream, "run", "ts", 900, event_time=True)
        q = found.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.run, r.last.timestamp()) for r in spark.read.schema("run string, last timestamp, silent_s double").parquet(str(out)).selectExpr("run", "last").collect())

    base = 1_700_000_000
    put(0, [("a", base), ("b", base + 10), (None, base + 5)])
    assert step() == []
    put(1, [("a", base + 800), ("c", base + 899)])
    assert step() == []
    put(2, [("c", base + 1200)])  # b has been silent for 900 s at base + 910
    assert step() == [("b", base + 10)]
    put(3, [("c", base + 1650), ("b", base + 1650)])  # the query was down: a's alarm, for base + 800, is due at base + 1700
    put(4, [("c", base + 5000)])
    found = step()
    assert ("a", base + 800) in found and ("b", base + 1650) in found and found.count(("b", base + 10)) == 1
    spark.conf.unset(alarms.PROVIDER[0])


def test_alarms_by_the_machines_clock(spark, tmp_path):
    spark.conf.set(*alarms.PROVIDER)
    spark.createDataFrame([("a", 1), ("b", 1)], "run string, ts long").selectExpr("run", "timestamp_seconds(ts) as ts").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("run string, ts timestamp").parquet(str(tmp_path / "log"))
    q = alarms.silence_alarms(stream, "run", "ts", 1.0).writeStream.format("memory").queryName("alarms").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("alarms").count() < 2:
            time.sleep(0.5)
        rows = spark.table("alarms").collect()
        assert sorted(r.run for r in rows) == ["a", "b"] and all(r.silent_s >= 1.0 for r in rows)
    finally:
        q.stop()
        spark.conf.unset(alarms.PROVIDER[0])
