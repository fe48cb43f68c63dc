"""Arrow files and NumPy archives as Spark data sources: a partition for each run of record batches or slice of an array, never a file as one row.

    register(spark)
    spark.read.format("arrow_batches").schema("a long, b string").load("/shared/*.arrow")
    spark.readStream.format("arrow_batches").schema(...).option("epochs", 3).load(...)
    spark.read.format("npz_slices").option("rows", 100_000).load("/shared/*.npz")

Files are opened by the tasks themselves, so paths must be in a store that driver and executors reach by pyarrow.fs (a shared folder or a URI).
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from episodica.shipping import ship_package

CELLS = "path string, name string, index array<bigint>, value double"


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (pa.fs.LocalFileSystem(), path)


def _files(pattern: str) -> list[str]:
    """Paths that a pattern (in the last part only) or a folder names, sorted; an error if there are none."""
    fs, path = _opened(pattern)
    prefix = pattern[: len(pattern) - len(path)]
    folder, name = posixpath.split(path.rstrip("/"))
    if fs.get_file_info(path).type == pa.fs.FileType.Directory:
        folder, name = path, "*"
    infos = fs.get_file_info(pa.fs.FileSelector(folder)) if "*" in name or "?" in name else [fs.get_file_info(path)]
    found = sorted(prefix + i.path for i in infos if i.type == pa.fs.FileType.File and fnmatch.fnmatch(i.base_name, name) and not i.base_name.startswith(("_", ".")))
    if not found:
        raise FileNotFoundError(pattern)
    return found


class Batches(InputPartition):
    """Record batches [start, stop) of a file; None where the file is a stream, which has to be read from its start."""

    def __init__(self, path: str, start: int | None = None, stop: int | None = None):
        self.path, self.start, self.stop = path, start, stop


def _batches(path: str) -> int | None:
    """Record batches of an Arrow file, from its footer; None for a stream."""
    fs, own = _opened(path)
    with fs.open_input_file(own) as f:
        if f.size() < 8 or f.read_at(6, 0) != b"ARROW1":
            return None
        return pa.ipc.open_file(f).num_record_batches


def _read(part: Batches, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    fs, own = _opened(part.path)
    with fs.open_input_file(own) as f:
        source = pa.ipc.open_stream(f) if part.start is None else pa.ipc.open_file(f)
        for b in source if part.start is None else (source.get_batch(i) for i in range(part.start, part.stop)):
            yield b.select(list(names))


class _ArrowReader(DataSourceReader):
    def __init__(self, names: Sequence[str], path: str, per: int):
        self.names, self.path, self.per = names, path, per

    def partitions(self) -> list[Batches]:
        out: list[Batches] = []
        for path in _files(self.path):
            n = _batches(path)
            out += [Batches(path)] if n is None else [Batches(path, i, min(n, i + self.per)) for i in range(0, n, self.per)]
        return out

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.names)


class _ArrowStream(DataSourceStreamReader):
    """The record batches of all files in order, `epochs` times over. An offset is an epoch and a number of batches, so a restart goes on within it."""

    def __init__(self, names: Sequence[str], path: str, per: int, epochs: int, most: int):
        self.names, self.path, self.per, self.epochs, self.most = names, path, per, epochs, most
        self.at: dict | None = None

    def _sizes(self) -> list[tuple[str, int | None]]:
        return [(p, _batches(p)) for p in _files(self.path)]

    def initialOffset(self) -> dict:
        return {"epoch": 0, "batch": 0}

    def latestOffset(self) -> dict:
        total = sum(1 if n is None else n for _, n in self._sizes())
        end = {"epoch": self.epochs, "batch": 0}
        if not self.most:
            return end
        at = self.at or self.initialOffset()
        done = min(self.epochs * total, at["epoch"] * total + at["batch"] + self.most)
        return {"epoch": done // total, "batch": done % total} if total else end

    def partitions(self, start: dict, end: dict) -> list[Batches]:
        sizes = self._sizes()
        total, out = sum(1 if n is None else n for _, n in sizes), []
        for epoch in range(start["epoch"], end["epoch"] + 1):
            low, high, seen = start["batch"] if epoch == start["epoch"] else 0, end["batch"] if epoch == end["epoch"] else total, 0
            for path, n in sizes:
                a, b = max(0, low - seen), min(1 if n is None else n, high - seen)
                out += [Batches(path)] * (a < b) if n is None else [Batches(path, i, min(b, i + self.per)) for i in range(a, b, self.per)]
                seen += 1 if n is None else n
        self.at = end
        return out

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        yield from _read(partition, self.names)

    def commit(self, end: dict) -> None:
        self.at = end


class ArrowBatches(DataSource):
    """Columns by name, as the schema that the caller gives has them. Options: batches, record batches in a partition (1); epochs and most (record
    batches in a trigger; 0: all) for streams."""

    @classmethod
    def name(cls) -> str:
        return "arrow_batches"

    def _columns(self, schema) -> list[str]:
        return [f.name for f in schema.fields]

    def reader(self, schema) -> DataSourceReader:
        return _ArrowReader(self._columns(schema), self.options["path"], int(self.options.get("batches", 1)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return _ArrowStream(self._columns(schema), o["path"], int(o.get("batches", 1)), int(o.get("epochs", 1)), int(o.get("most", 0)))


class Slice(InputPartition):
    def __init__(self, path: str, name: str, start: int, stop: int):
        self.path, self.name, self.start, self.stop = path, name, start, stop


class _Header(NamedTuple):
    shape: tuple[int, ...]
    fortran: bool
    dtype: np.dtype


def _header(f) -> _Header:
    version = np.lib.format.read_magic(f)
    return _Header(*(np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)))


class _NpzReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Slice]:
        out = []
        for path in _files(self.path):
            fs, own = _opened(path)
            with fs.open_input_file(own) as f, zipfile.ZipFile(f) as z:
                for member in z.namelist():
                    with z.open(member) as m:
                        size = int(np.prod(_header(m).shape, dtype=np.int64))  # from the header: no array is read
                    out += [Slice(path, member, i, min(size, i + self.rows)) for i in range(0, size, self.rows)]
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        fs, own = _opened(part.path)
        with fs.open_input_file(own) as f, zipfile.ZipFile(f) as z, z.open(part.name) as m:
            head = _header(m)
            m.seek(m.tell() + part.start * head.dtype.itemsize)
            for at in range(part.start, part.stop, 65_536):
                some = np.arange(at, min(part.stop, at + 65_536))
                values = np.frombuffer(m.read(len(some) * head.dtype.itemsize), head.dtype).astype(np.float64)
                index = np.stack(np.unravel_index(some, head.shape, order="F" if head.fortran else "C"), axis=1) if head.shape else np.zeros((1, 0), np.int64)
                ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(head.shape))
                lists = pa.ListArray.from_arrays(ends, pa.array(index.ravel().astype(np.int64)))
                text = lambda s, n=len(some): pa.array([s] * n, pa.string())
                yield pa.RecordBatch.from_arrays([text(part.path), text(part.name.removesuffix(".npy")), lists, pa.array(values)], names=["path", "name", "index", "value"])


class NpzSlices(DataSource):
    """Cells of the numeric arrays of .npz files. Option: rows, cells in a partition (1,000,000). A slice of a compressed array is read from its start on."""

    @classmethod
    def name(cls) -> str:
        return "npz_slices"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _NpzReader(self.options["path"], int(self.options.get("rows", 1_000_000)))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    for source in (ArrowBatches, NpzSlices):
        spark.dataSource.register(source)
