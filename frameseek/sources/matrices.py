"""Numpy matrices as a Spark data source: ``.npy`` files and the members of ``.npz`` archives, read and written.

A matrix is cut into ranges of rows by its header, so one large matrix is many tasks and each reads
only its bytes; the members of an archive are found in its directory, and stored ones are read in
place like files (a compressed one is one task). Columns: file, pos (the row's place in the matrix)
and v, an array of floats; of a matrix of texts v is a string; of one of 64-bit numbers, longs or doubles.
One-dimensional arrays have a value a row.

Written, every task makes archives ``part-*.npz`` of at most ``rows`` rows with two stored members,
``row_id`` and ``vec``; they appear when all tasks are done and none if one fails.
"""

from __future__ import annotations

import ast
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from frameseek.sources import storage

#: Bytes of a matrix that one task reads.
RANGE_BYTES = 32 << 20
#: Rows of a written archive.
ROWS = 65_536
MAGIC = b"\x93NUMPY"


@dataclass
class Header:
    dtype: np.dtype
    rows: int
    width: int
    by_column: bool
    flat: bool
    start: int

    @property
    def kind(self) -> str:
        """The Spark type of v."""
        if self.dtype.kind in "US":
            return "string"
        one = "long" if self.dtype.kind in "iu" and self.dtype.itemsize == 8 else "double" if self.dtype == np.float64 else "float"
        return one if self.flat else f"array<{one}>"


def header(f, start: int = 0) -> Header:
    """The header of a matrix that begins at byte ``start`` of an open file."""
    f.seek(start)
    head = f.read(10)
    if head[:6] != MAGIC:
        raise ValueError("not a numpy matrix")
    wide = head[6] > 1
    size = struct.unpack("<I", head[8:10] + f.read(2))[0] if wide else struct.unpack("<H", head[8:10])[0]
    said = ast.literal_eval(f.read(size).decode("latin1"))
    dtype, shape = np.dtype(said["descr"]), said["shape"]
    if dtype.hasobject or dtype.names or len(shape) > 2:
        raise ValueError(f"a matrix of {dtype} in the shape {shape} has no rows of values")
    rows, width = (*shape, 1, 1)[:2]
    return Header(dtype, rows, width, bool(said["fortran_order"]), len(shape) < 2, start + (12 if wide else 10) + size)


def member(f, size: int, name: str) -> int | None:
    """Where a stored member of an archive begins, or None if it is compressed."""
    with zipfile.ZipFile(f) as z:
        info = z.getinfo(name)
    if info.compress_type != zipfile.ZIP_STORED:
        return None
    f.seek(info.header_offset + 26)
    a, b = struct.unpack("<HH", f.read(4))
    return info.header_offset + 30 + a + b


@dataclass
class Rows(InputPartition):
    """Rows of one matrix: its file, its place there (None: compressed), and the range."""

    file: str
    start: int | None
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.name = options["path"], options.get("member", "")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.paths = storage.files(self.path, "*.npz" if self.name else "*.npy")

    def _open(self, path: str):
        return storage.at(self.path)[0].open_input_file(path)

    def _header(self, path: str) -> tuple[Header, int | None]:
        with self._open(path) as f:
            if not self.name:
                return header(f), 0
            start = member(f, f.size(), f"{self.name}.npy")
            if start is not None:
                return header(f, start), start
            with zipfile.ZipFile(f) as z:
                return header(io.BytesIO(z.open(f"{self.name}.npy").read(1 << 16))), None

    def schema(self) -> str:
        kinds = {self._header(p)[0].kind for p in self.paths}
        if len(kinds) > 1:
            raise ValueError(f"matrices of several kinds: {sorted(kinds)}")
        return f"file string, pos long, v {kinds.pop() if kinds else 'array<float>'}"

    def partitions(self) -> list[Rows]:
        out = []
        for p in self.paths:
            h, start = self._header(p)
            step = h.rows if start is None else max(1, self.range_bytes // max(1, h.width * h.dtype.itemsize))
            out += [Rows(p, start, a, min(a + step, h.rows)) for a in range(0, h.rows, max(step, 1))]
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.last <= part.first:
            return
        with self._open(part.file) as f:
            if part.start is None:
                with zipfile.ZipFile(f) as z:
                    data = io.BytesIO(z.read(f"{self.name}.npy"))
                h = header(data)
                yield self._batch(part.file, 0, self._rows(data, h, 0, h.rows), h)
                return
            h = header(f, part.start)
            for a in range(part.first, part.last, ROWS):
                b = min(a + ROWS, part.last)
                yield self._batch(part.file, a, self._rows(f, h, a, b), h)

    @staticmethod
    def _rows(f, h: Header, a: int, b: int) -> np.ndarray:
        one = h.dtype.itemsize

        def take(first: int, many: int) -> np.ndarray:
            f.seek(h.start + first * one)
            return np.frombuffer(f.read(many * one), h.dtype)

        if not h.by_column:
            return take(a * h.width, (b - a) * h.width).reshape(b - a, h.width)
        return np.stack([take(c * h.rows + a, b - a) for c in range(h.width)], axis=1)

    @staticmethod
    def _batch(file: str, first: int, rows: np.ndarray, h: Header) -> pa.RecordBatch:
        if h.kind == "string":
            v = pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in rows[:, 0]], pa.string())
        else:
            one = {"long": np.int64, "double": np.float64, "float": np.float32}[h.kind.removeprefix("array<").removesuffix(">")]
            flat = pa.array(np.ascontiguousarray(rows, dtype=one).ravel())
            v = flat if h.flat else pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * h.width), flat)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(np.arange(first, first + len(rows))), v], names=["file", "pos", "v"])


@dataclass
class Made(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    """Archives in a folder that listings pass over, moved out by the driver when all are there."""

    def __init__(self, options: dict) -> None:
        # The job's folder is named once, in the driver, and the same in every task.
        self.path, self.rows, self.job = options["path"], int(options.get("rows", ROWS)), f"_{uuid.uuid4().hex}"
        self.half = options.get("dtype", "float32")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Made:
        system, path = storage.at(self.path)
        system.create_dir(f"{path}/{self.job}", recursive=True)
        made, held = [], []

        def flush(tbl: pa.Table) -> None:
            lists = tbl["v"].combine_chunks()
            if lists.null_count or len(set(np.diff(lists.offsets.to_numpy()).tolist())) > 1:
                raise ValueError("a matrix has vectors of one length and no null")
            vec = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(self.half)
            data = io.BytesIO()
            np.savez(data, row_id=tbl["row_id"].to_numpy().astype(np.int64), vec=vec)
            name = f"{path}/{self.job}/part-{uuid.uuid4().hex}.npz"
            with system.open_output_stream(name) as f:
                f.write(data.getvalue())
            made.append(name)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= self.rows:
                tbl = pa.Table.from_batches(held)
                flush(tbl.slice(0, self.rows))
                held = tbl.slice(self.rows).to_batches()
        if sum(b.num_rows for b in held):
            flush(pa.Table.from_batches(held))
        return Made(made)

    def commit(self, messages: list[Made | None]) -> None:
        system, path = storage.at(self.path)
        storage.settle(system, {name: f"{path}/{name.rpartition('/')[2]}" for m in messages if m for name in m.files})
        storage.remove(f"{self.path}/{self.job}")

    def abort(self, messages: list[Made | None]) -> None:
        storage.remove(f"{self.path}/{self.job}")


class Matrices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numpy"

    def schema(self) -> str:
        return Reader(self.options).schema()

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read(spark: SparkSession, path: str, member: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, pos, v) of the rows of all matrices below ``path``, or of one member of all archives there."""
    spark.dataSource.register(Matrices)
    options = {"path": path, "rangebytes": str(range_bytes)} | ({"member": member} if member else {})
    return spark.read.format("numpy").options(**options).load()


def write(vectors: DataFrame, path: str, dtype: str = "float32", rows: int = ROWS) -> None:
    """``vectors`` (row_id, v) into archives under ``path``; a null or a vector of another length writes nothing."""
    vectors.sparkSession.dataSource.register(Matrices)
    chosen = vectors.selectExpr("cast(row_id as long) as row_id", f"cast(v as array<{'double' if dtype == 'float64' else 'float'}>) as v")
    chosen.write.format("numpy").mode("append").options(path=path, dtype=dtype, rows=str(rows)).save()
