"""Ranks, quantiles and samples without hot tasks, training examples, arrays from files; against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica import durable
from episodica.operators import aggregates as A
from episodica.operators import batching as B
from episodica.operators import examples as Ex
from episodica.operators import ranks as R
from episodica.operators import sampling as P
from episodica.operators import stats as S
from episodica.operators import windows as W
from episodica.sources import scans


def test_numbered_is_a_total_rank(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 2, 2, 5]), i) for i in range(700)]
    got = {r.i: r.place for r in R.numbered(spark.createDataFrame(rows, "a int, i int"), ["a", "i"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == {i: k for k, (_, i) in enumerate(want, 1)}
    assert R.numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 999, 60_000])
def test_exact_quantiles_of_any_size(spark, n):
    """Beyond SMALL values quantiles come from brackets; ties, negatives and nulls among them."""
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 100, n), 0 if n % 2 else 3)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("g", None), (None, 4.0), ("empty", None)], "g string, x double")
    got = {r.g: r for r in A.exact_quantiles(df, ["g"], "x", {"a": 0.01, "b": 0.5, "c": 0.98, "d": 0.999, "e": 0.0, "f": 1.0}).collect()}
    assert np.allclose([got["g"][k] for k in "abcdef"], np.quantile(x, [0.01, 0.5, 0.98, 0.999, 0, 1]), rtol=1e-12, atol=1e-12)
    assert [got[None][k] for k in "abcdef"] == [4.0] * 6 and [got["empty"][k] for k in "abcdef"] == [None] * 6


def test_samples_by_slices_are_the_first_by_hash(spark):
    """A group with nine tenths of the rows, a small one and a null one."""
    rows = [(i, "big" if i % 10 else ("small" if i % 20 else None)) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, g string")
    order = lambda i, seed: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i)
    by = {}
    for i, g in rows:
        by.setdefault(g, []).append(i)
    got = {}
    for r in P.split(df, "id", ["g"], 0.1, 1).collect():
        got.setdefault((r.g, r.is_test), set()).add(r.id)
    for g, ids in by.items():
        first = set(sorted(ids, key=lambda i: order(i, 1))[: round(len(ids) * 0.1)])
        assert got[g, True] == first and got[g, False] == set(ids) - first
    got = {(r.g, r["rank"]): r.id for r in P.balanced_sample(df, "id", ["g"], 25, 2).collect()}
    assert got == {(g, k): i for g, ids in by.items() for k, i in enumerate(sorted(ids, key=lambda i: order(i, 2))[:25], 1)}
    assert P.balanced_sample(df, "id", ["g"], 10**6, 2).count() == len(rows) and P.split(df, "id", ["g"], 0.0, 1).filter("is_test").count() == 0
    placed = P.hash_shuffle(df, "id", 5).orderBy("place").collect()
    assert [r.id for r in placed] == sorted((i for i, _ in rows), key=lambda i: order(i, 5))


def test_false_discovery_of_a_large_family(spark):
    rng = np.random.default_rng(4)
    ps = np.round(rng.random(3000) ** 3, 3)
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "i int, p double")
    got = {r.i: r.q for r in S.benjamini_hochberg(df, "p", ["i"]).collect()}
    ranked, least, want = sorted((p, i) for i, p in enumerate(ps)), 1.0, {}
    for k in range(len(ps), 0, -1):
        p, i = ranked[k - 1]
        least = min(least, p * len(ps) / k)
        want[i] = least
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_argmax_takes_the_first_place(spark):
    df = spark.createDataFrame([(1, 0, -3.0), (1, 1, 3.0), (1, 2, None), (2, 5, 0.5), (3, 7, None)], "g int, k int, x double")
    got = {r.g: (r.peak, r.k) for r in A.argmax(df, ["g"], F.col("x"), ["k"]).collect()}
    assert got == {1: (3.0, 0), 2: (0.5, 5), 3: (None, 7)}


def test_block_mask_rows_make_the_mask(spark):
    rng = np.random.default_rng(5)
    starts, valid = rng.random(40) < 0.3, rng.random(40) < 0.8
    df = spark.createDataFrame([(0, k, bool(s), bool(v)) for k, (s, v) in enumerate(zip(starts, valid, strict=True))], "e int, k int, s boolean, v boolean")
    rows = W.block_mask(df, ["e"], "k", F.col("s"), F.col("v"))
    block, keys = np.cumsum(starts), [k for k in range(40) if valid[k]]
    positions = F.array(*map(F.lit, keys))
    for r in rows.withColumn("mask", W.mask_row(positions, F.col("until"))).collect():
        want = [bool(block[k] <= block[r["query"]]) for k in keys]
        assert r["mask"] == want and r["allowed"] == sum(want)


def plain_steps(items, budget, buffer_size, micro, steps, drop_last):
    """The loader sample by sample: a source that begins again, a list of batches, a final step with copies."""
    buffer, out, made, last, source = [], [], [], [], iter(items)
    while not (steps and len(out) >= steps):
        if len(buffer) >= buffer_size and sum(n for _, n in buffer) >= budget:
            used, last, rest = 0, [], []
            for x in buffer:
                if used < budget and (used + x[1] <= budget or not last):
                    last.append(x)
                    used += x[1]
                else:
                    rest.append(x)
            buffer = rest
            made.append((last, False))
            if len(made) == micro:
                out.append(made)
                made = []
                continue
        try:
            buffer.append(next(source))
        except StopIteration:
            if len(out) < steps:
                source = iter(items)
                buffer.append(next(source))
                continue
            if not drop_last and buffer:
                while buffer:
                    used, last, rest = 0, [], []
                    for x in buffer:
                        if used < budget and (used + x[1] <= budget or not last):
                            last.append(x)
                            used += x[1]
                        else:
                            rest.append(x)
                    buffer = rest
                    made.append((last, False))
                    if len(made) == micro:
                        out.append(made)
                        made = []
                out.append(made + [(last, True)] * (micro - len(made)))
            break
    return [(s, m, k, i, n, pad) for s, step in enumerate(out) for m, (batch, pad) in enumerate(step) for k, (i, n) in enumerate(batch)]


@pytest.mark.parametrize(("steps", "drop_last"), [(0, False), (0, True), (7, False), (40, False)])
def test_dynamic_batches_like_the_plain_loader(spark, steps, drop_last):
    from episodica.shipping import ship_package

    ship_package(spark)
    rnd = random.Random(steps)
    rows = [(s, i, rnd.randint(1, 150)) for s in (0, 1) for i in range(60)]
    got = {}
    for r in B.dynamic_batches(spark.createDataFrame(rows, "s long, i long, n long"), "i", "n", "s", 300, 8, 3, steps, drop_last).collect():
        got.setdefault(r.s, []).append(tuple(r)[1:])
    for s in (0, 1):
        assert sorted(got.get(s, [])) == sorted(plain_steps([(i, n) for x, i, n in rows if x == s], 300, 8, 3, steps, drop_last))


def test_packed_stream_query_takes_every_sample_once(spark, data):
    from episodica.plans import catalog

    got = catalog.QUERIES["packed_stream"](spark, data).collect()
    docs = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len({r.sample_id for r in got}) == len(got) and all(docs[r.sample_id] == r.length and r.sample_id % 4 == r.shard for r in got)
    sums = {}
    for r in got:
        sums.setdefault((r.shard, r.batch), []).append(r.length)
    assert all(sum(v) <= 8000 or len(v) == 1 for v in sums.values())
    for shard in range(4):  # as the batch form makes them, up to what the stream still holds
        buffer, want, k = B.BudgetBuffer(), [], 0
        for i in sorted(i for i in docs if i % 4 == shard):
            buffer.add(i, docs[i])
            while buffer.ready(20, 8000):
                want += [(k, p, x, n) for p, (x, n) in enumerate(buffer.take(8000))]
                k += 1
        assert sorted((r.batch, r.place, r.sample_id, r.length) for r in got if r.shard == shard) == sorted(want)


def test_image_examples_of_generation_tasks(spark):
    rows = [(1, 0, "system", " s "), (1, 1, "user", "uee"), (1, 2, "assistant", "aee"), (1, 3, "assistant", "b")]
    df = spark.createDataFrame(rows, "c int, t int, r string, x string")
    r = Ex.image_examples(df, "c", "t", "r", "x", F.col("r") == "assistant", 101, "interleave_generation", image_tokens=2).first()
    text = "s\n\n" + "User: uee\n\n" + "Assistant: aee\n\n" + "b<｜end▁of▁sentence｜>"
    ids = list(text.encode())
    assert r.input_ids == ids and r.images_seq_mask == [i == 101 for i in ids]
    head = len("s\n\nUser: uee\n\n".encode())
    assert r.labels == [-100] * head + ids[head:]
    assert [len(m) for m in r.images_emb_mask] == [bytes(p.encode()).count(b"e") for p in ("User: uee\n\n", "Assistant: aee\n\n", "b<｜end▁of▁sentence｜>") if p.encode().count(b"e") >= 2]
    with pytest.raises(ValueError):
        Ex.sft_examples(df, "c", "t", "r", ["messages", "text"], "chatml", F.lit(True))


def test_cross_entropy_like_numpy(spark):
    rng = np.random.default_rng(6)
    logits, labels = rng.normal(0, 300, (50, 7)), rng.integers(0, 7, 50)
    labels[::4] = -100
    df = spark.createDataFrame([(x.tolist(), int(y)) for x, y in zip(logits, labels, strict=True)], "x array<double>, y int").withColumn("k", F.lit(1))
    z = logits - logits.max(axis=1, keepdims=True)
    loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(50), np.maximum(labels, 0)])[labels != -100]
    assert abs(Ex.mean_loss(df, ["k"], "x", "y").first().loss - loss.mean()) < 1e-9
    assert abs(Ex.mean_loss(df, ["k"], "x", "y", F.lit(10.0)).first().loss - loss.sum() / 10) < 1e-9


def test_arrays_of_files_in_long_form(spark, tmp_path):
    from episodica.shipping import ship_package

    ship_package(spark)
    cube = np.arange(24.0).reshape(2, 3, 4)
    np.savez(tmp_path / "x.npz", cube=cube, up=np.array([True, False]), one=np.float32(2.5), none=np.zeros((0, 3)))
    got = {(r["name"], tuple(r["index"])): r["value"] for r in scans.read_npz(spark, str(tmp_path / "x.npz"), batch=5).collect()}
    want = {("cube", i): v for i, v in np.ndenumerate(cube)} | {("up", (0,)): 1.0, ("up", (1,)): 0.0, ("one", ()): 2.5}
    assert got == want


def test_tables_are_dropped(spark):
    df = durable.durable(spark.range(5), "x")
    assert df.count() == 5
    path = df._episodica_path
    assert scans.exists(spark, path)
    durable.drop(df)
    assert not scans.exists(spark, path)
    durable.drop(df)


def test_large_documents_are_not_collected(spark, tmp_path, monkeypatch):
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert scans.read_document(spark, str(tmp_path / "x.json")) == {"a": 1}
    monkeypatch.setattr(scans, "MOST_DOCUMENT", 4)
    with pytest.raises(ValueError, match="more than a document"):
        scans.read_document(spark, str(tmp_path / "x.json"))


def test_strata_without_keys_are_ntiles(spark):
    for rows, n in ((23, 10), (5, 10), (40, 4), (1, 3)):
        df = spark.range(rows).withColumn("k", F.col("id") % 7)
        got = [r.stratum for r in W.strata(df, n, ["k", "id"]).orderBy("k", "id").collect()]
        assert got == [i + 1 for i, part in enumerate(np.array_split(np.arange(rows), n)) for _ in part]
