"""The pipeline against plain Python: each stage on its own input."""

import corpus_pipeline as P
from episodica.llm import queries
from episodica.llm.langid import identify
from tests.compare import duck, rows
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import poisson, unit


def test_stages(spark, data, docs):
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "near_dedup", "mixing", "packing"]
    known = P.language(spark, docs, data)
    pred = {r.doc_id: r for r in identify(docs).collect()}
    assert {r.doc_id for r in known.collect()} == {i for i, r in pred.items() if r.lang_pred != "und" and r.score >= 0.3}
    assert known.columns == docs.columns

    once = P.near_dedup(spark, known, data)
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in known.collect()], 5, 80)}
    assert {r.doc_id for r in once.collect()} == want and once.columns == docs.columns

    mixed = P.mixing(spark, once, data)
    assert mixed.columns == docs.columns
    n = {}
    for r in once.collect():
        n[r.source] = n.get(r.source, 0) + 1
    weight, total = sum(x**0.5 for x in n.values()), sum(n.values())
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    for r in once.collect():
        assert counts.get(r.doc_id, 0) == poisson(n[r.source] ** 0.5 / weight * total / n[r.source], unit("mix0", r.doc_id, 1))

    packed = P.packing(spark, mixed, data).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run(spark, data):
    assert P.run(spark, data).count() > 0


def test_queries_like_their_sql(spark, data):
    con = duck(data)
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want), name


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_scratch_tables_can_be_dropped(spark):
    from episodica.llm.common import drop_tables, durable, longs, range_of
    from pyspark.sql import functions as F

    path = durable(spark.range(3), "x").inputFiles()[0]
    assert drop_tables(spark) > 0
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    cuts = [3, 7, 7, 20, 30, 41]
    for n in range(len(cuts) + 1):
        at = longs(cuts[:n])
        got = spark.range(45).select("id", range_of(n, lambda i: F.get(at, i.cast("int")) <= F.col("id")).alias("r")).collect()
        assert all(r.r == sum(c <= r.id for c in cuts[:n]) for r in got)
