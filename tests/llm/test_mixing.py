import hashlib
import math

import pytest
from pyspark.sql import functions as F

from episodica.llm import mixing


def unit(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_counts_are_poisson_quantiles(docs):
    got = mixing.mix(docs).collect()
    n = {}
    for r in docs.collect():
        n[r.source] = n.get(r.source, 0) + 1
    weight, total = sum(math.sqrt(x) for x in n.values()), sum(n.values())
    want = {r.doc_id: poisson(math.sqrt(n[r.source]) / weight * total / n[r.source], unit("mix0", r.doc_id, 1)) for r in docs.collect()}
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(have.get(i, [])) == list(range(1, k + 1)) for i, k in want.items())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == text[r.doc_id] for r in got)


def test_large_rates_and_targets(spark):
    df = spark.createDataFrame([(i, "a" if i < 3000 else "b") for i in range(3030)], "doc_id long, source string")
    got = mixing.mix(df, {"a": 1, "b": 1, "none": 5}, total=6000).groupBy("source").count().collect()
    assert all(abs(r["count"] - 3000) < 300 for r in got) and len(got) == 2
    assert mixing.mix(df, {"a": 1.0}).filter("source = 'b'").count() == 0


def test_the_shuffled_join_gives_the_same(docs, monkeypatch):
    a = sorted((r.doc_id, r.copy, r.mix_key) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert a == sorted((r.doc_id, r.copy, r.mix_key) for r in mixing.mix(docs).collect())


def test_order_and_positions(docs):
    mixed = mixing.mix(docs)
    keys = [r.mix_key for r in mixing.shuffled(mixed).select("mix_key").collect()]
    assert keys == sorted(keys)
    got = mixing.with_positions(mixed, ["doc_id", "copy"]).orderBy("mix_key", "doc_id", "copy").collect()
    assert [r.position for r in got] == list(range(len(keys)))


def test_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs, total=2000)
    assert {r.source for r in got.collect()} == {"a", "b", "c", None} and set(odd_docs.columns) <= set(got.columns)
    assert got.filter("copy is null").count() == 0
    assert mixing.mix(no_docs).count() == 0


@pytest.mark.parametrize("mean", [0.1, 1.0, 15.9])
def test_distribution_function(spark, mean):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(mean)).alias("c")).first().c
    assert len(cdf) == mixing.TERMS and abs(cdf[-1] - 1) < 1e-12 and all(a <= b for a, b in zip(cdf, cdf[1:]))
