"""Arrow and NumPy files as data sources, against pyarrow and numpy."""

import numpy as np
import pyarrow as pa
import pytest

from episodica.sources import arrays


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("arrays")
    schema = pa.schema([("i", pa.int64()), ("s", pa.string()), ("v", pa.list_(pa.float64()))])
    rows = lambda lo, n: pa.RecordBatch.from_pylist([{"i": i, "s": None if i % 7 == 0 else f"s{i}", "v": [i / 2, None][: i % 3]} for i in range(lo, lo + n)], schema=schema)
    with pa.ipc.new_file(str(d / "a.arrow"), schema) as w:
        for k in range(5):
            w.write(rows(k * 10, 10))
    with pa.ipc.new_stream(str(d / "b.arrow"), schema) as w:
        w.write(rows(50, 4))
    with pa.ipc.new_file(str(d / "c.arrow"), schema):
        pass
    np.savez(d / "x.npz", a=np.arange(24.0).reshape(2, 3, 4), f=np.asfortranarray(np.arange(6, dtype=np.int32).reshape(2, 3)), one=np.float32(2.5), none=np.zeros((0, 3)))
    np.savez_compressed(d / "y.npz", a=np.arange(200_000, dtype=np.int16))
    return d


def test_arrow_files_by_record_batches(spark, folder):
    arrays.register(spark)
    read = spark.read.format("arrow_batches").schema("s string, i long, v array<double>")
    df = read.load(f"{folder}/*.arrow")
    assert df.rdd.getNumPartitions() == 6
    got = sorted((r.i, r.s, r.v) for r in df.collect())
    assert got == [(i, None if i % 7 == 0 else f"s{i}", [i / 2, None][: i % 3]) for i in range(54)]
    assert read.option("batches", 2).load(f"{folder}/a.arrow").rdd.getNumPartitions() == 3
    assert spark.read.format("arrow_batches").schema("i long").load(f"file://{folder}/a.arrow").count() == 50
    with pytest.raises(Exception, match="FileNotFound"):
        read.load(f"{folder}/*.none").count()


def test_arrow_stream_goes_on_within_an_epoch(spark, folder, tmp_path):
    """Three epochs of six batches, four to a trigger: stopped and taken up again, each row comes once an epoch."""
    arrays.register(spark)

    def run(**trigger):
        s = spark.readStream.format("arrow_batches").schema("i long").option("epochs", 3).option("most", 4).load(f"{folder}/*.arrow")
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(**trigger).start()
        q.awaitTermination()
        return spark.read.schema("i long").parquet(str(tmp_path / "out")).groupBy("i").count().collect()

    first = run(once=True)
    assert sum(r["count"] for r in first) == 40
    for _ in range(6):
        rows = run(once=True)
    assert {r.i: r["count"] for r in rows} == {i: 3 for i in range(54)}


def test_npz_cells_by_slices(spark, folder):
    arrays.register(spark)
    df = spark.read.format("npz_slices").option("rows", 7).load(f"{folder}/x.npz")
    with np.load(folder / "x.npz") as found:
        want = sorted((name, list(map(int, at)), float(found[name][at])) for name in found.files for at in np.ndindex(found[name].shape))
    assert sorted((r["name"], r["index"], r["value"]) for r in df.collect()) == want and df.rdd.getNumPartitions() == 4 + 1 + 1
    big = spark.read.format("npz_slices").option("rows", 90_000).load(f"{folder}/y.npz")
    assert big.rdd.getNumPartitions() == 3 and big.selectExpr("sum(value)").first()[0] == float(np.arange(200_000, dtype=np.int16).sum(dtype=np.int64)) and big.selectExpr("max(index[0])").first()[0] == 199_999
