"""Many small files from rows (path, content): all of them or none.

A job writes below a folder of its own that listings pass over. What it wrote is a table of a row a file in the
shared folder; tasks move the files into place by it when all are written. The driver holds no names. What failed
or repeated attempts leave goes with the job's folder, and what was moved when a later move failed is taken back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameseek.operators.staging import dropped, written
from frameseek.sources import storage


def _put(folder: str, job: str):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage.at(folder)
        own = f"{root}/{job}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        n = 0
        for batch in batches:
            hidden, final = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                parts = (path or "").split("/")
                if "" in parts or ".." in parts or parts[-1][0] in "._":
                    raise ValueError(f"no path for a file: {path!r}")
                hidden.append(f"{own}/{n}")
                final.append(f"{root}/{path}")
                n += 1
                with system.open_output_stream(hidden[-1]) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array(hidden, pa.string()), pa.array(final, pa.string())], names=["hidden", "final"])

    return put


def _move(folder: str, back: bool = False):
    """Moves files to their names, passing over those that an earlier attempt moved; or takes those that were moved away."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = storage.at(folder)
        for batch in batches:
            pairs = dict(zip(batch.column("hidden").to_pylist(), batch.column("final").to_pylist()))
            waiting = {i.path for i in system.get_file_info(list(pairs)) if i.type == fs.FileType.File}
            if back:
                moved = [final for hidden, final in pairs.items() if hidden not in waiting]
                for info in system.get_file_info(moved):
                    if info.type == fs.FileType.File:
                        system.delete_file(info.path)
            else:
                storage.settle(system, {hidden: final for hidden, final in pairs.items() if hidden in waiting})
            yield pa.RecordBatch.from_arrays([pa.array([len(pairs)], pa.int64())], names=["n"])

    return move


def _run(made: DataFrame, step) -> None:
    made.mapInArrow(step, "n long").agg(F.sum("n")).collect()


def write(files: DataFrame, folder: str) -> None:
    """``files`` (path, content) below ``folder``; a null content is an empty file. Names that begin with . or _ are an error."""
    job = f"_{uuid.uuid4().hex}"
    try:
        made = written(files.selectExpr("cast(path as string) as path", "cast(content as binary) as content").mapInArrow(_put(folder, job), "hidden string, final string"))
        if not made.groupBy("final").count().where("count > 1").isEmpty():
            raise ValueError("several rows have one path")
        try:
            _run(made, _move(folder))
        except Exception:
            _run(made, _move(folder, back=True))
            raise
        dropped(made)
    finally:
        storage.remove(f"{folder}/{job}")
