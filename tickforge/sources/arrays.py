"""NumPy array files as tables, read by byte ranges and written by parts.

``ArrayFile`` is a data source: a header of some hundred bytes gives the schema, and each task reads
the bytes of its own items. An array that is written has its items numbered first, so that each
task knows where its items go; nothing of it passes the driver but the header. Where a store can't
write into a file (all but ``file:``), or if wanted, the array is a folder of part files.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickforge.operators import ordered
from tickforge.sources.places import store

#: Bytes that a task reads or writes at once.
CHUNK = 1 << 24
_HEADER = 1 << 16


@dataclass(frozen=True)
class Layout:
    """What a header says: shape, dtype, order, where data begin."""

    path: str
    shape: tuple[int, ...]
    dtype: np.dtype
    fortran: bool
    offset: int
    before: int = 0  # items in files before this one

    @property
    def item(self) -> int:
        return int(np.prod(self.shape[1:])) * self.dtype.itemsize


def layout(path: str, before: int = 0) -> Layout:
    system, place = store(path)
    with system.open_input_file(place) as f:
        head = io.BytesIO(f.read(_HEADER))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(head)
    if dtype.hasobject or dtype.names or len(shape) not in (2, 3):
        raise ValueError("an array of numbers with 2 or 3 dimensions is wanted")
    return Layout(path, shape, dtype, fortran, head.tell(), before)


def layouts(path: str) -> list[Layout]:
    """Of a file, or of the part files of a folder in order of name."""
    from pyarrow import fs

    system, place = store(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [layout(path)]
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.endswith(".npy"))
    out: list[Layout] = []
    for name in names:
        out.append(layout(f"{path}/{name}", out[-1].before + out[-1].shape[0] if out else 0))
    if len({x.shape[1:] for x in out}) != 1:
        raise ValueError(f"no parts, or parts of different shapes: {path}")
    return out


def schema_of(shape: tuple[int, ...]) -> str:
    return "id long, v array<double>" if len(shape) == 2 else ", ".join(["window_id long, step int", *[f"f{k} float" for k in range(shape[2])]])


def items(at: Layout, first: int, last: int) -> np.ndarray:
    """Items from ``first`` to before ``last``; of column-major arrays a run of each column is read."""
    system, place = store(at.path)
    n, size = last - first, at.dtype.itemsize
    with system.open_input_file(place) as f:
        if not at.fortran:
            f.seek(at.offset + first * at.item)
            data = f.read(n * at.item)
        else:
            runs = []
            for c in range(at.item // size):
                f.seek(at.offset + (c * at.shape[0] + first) * size)
                runs.append(f.read(n * size))
            data = b"".join(runs)
    return np.frombuffer(data, at.dtype).reshape((n, *at.shape[1:]), order="F" if at.fortran else "C")


@dataclass
class Range(InputPartition):
    at: Layout
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for at in layouts(self.path):
            step = max(1, CHUNK // max(1, at.item))
            out += [Range(at, k, min(k + step, at.shape[0])) for k in range(0, at.shape[0], step)]
        return out or [Range(layouts(self.path)[0], 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        n = part.last - part.first
        if not n:
            return
        x, ids = items(part.at, part.first, part.last), np.arange(part.first, part.last) + part.at.before
        if x.ndim == 2:
            flat = pa.array(np.ascontiguousarray(x, np.float64).ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids), v], names=["id", "v"])
        else:
            steps = x.shape[1]
            columns = [pa.array(np.repeat(ids, steps)), pa.array(np.tile(np.arange(steps, dtype=np.int32), n))]
            columns += [pa.array(np.ascontiguousarray(x[:, :, k], np.float32).ravel()) for k in range(x.shape[2])]
            yield pa.RecordBatch.from_arrays(columns, names=["window_id", "step", *[f"f{k}" for k in range(x.shape[2])]])


class ArrayFile(DataSource):
    """``spark.read.format("npy").load(path)``: rows (id, v), or windows (window_id, step, f0..)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return schema_of(layouts(self.options["path"])[0].shape)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrayFile)
    return spark.read.format("npy").schema(schema_of(layouts(path)[0].shape)).load(path)


def write(windows: DataFrame, path: str, features: list[str], parts: bool | None = None) -> None:
    """Windows ([ticker,] window_id, step, features) as a float32 array, in order of ticker and window_id.

    ``parts`` makes a folder of part files; by default only where the store can't write into a file.
    All windows must be of one length; a window without rows is not there.
    """
    from pyarrow import fs

    keys = [k for k in ("ticker", "window_id") if k in windows.columns]
    cells = F.transform(F.array_sort(F.collect_list(F.struct("step", F.array(*[F.col(c).cast("float") for c in features]).alias("x")))), lambda s: s["x"])
    rows = windows.groupBy(*keys).agg(F.flatten(cells).alias("x"))  # a window's steps
    placed = ordered.numbered(rows, [], keys, "_at")
    n, least, most = placed.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError("windows of different lengths")
    length, width = (most or 0) // len(features), len(features)
    system, place = store(path)
    parts = not isinstance(system, fs.LocalFileSystem) if parts is None else parts
    per = max(1, CHUNK // max(1, length * width * 4))

    def header(count: int) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (count, length, width)})
        return out.getvalue()

    start = header(n)
    if parts:
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir_contents(place)
        system.create_dir(place, recursive=True)
        if not n:
            with system.open_output_stream(f"{place}/part-{0:012d}.npy") as f:
                f.write(start)
    else:
        system.create_dir(os.path.dirname(place), recursive=True)
        with system.open_output_stream(place) as f:
            f.write(start)

    def put(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        first = int(part["_at"].iloc[0])
        data = np.stack(part["x"].to_numpy()).astype("<f4").tobytes()
        where, there = store(path)
        if parts:
            with where.open_output_stream(f"{there}/part-{first // per:012d}.npy") as f:
                f.write(header(len(part)) + data)
        else:  # places are fixed, so that a task tried again writes the same bytes to the same place
            with open(there, "r+b") as f:
                f.seek(len(start) + first * length * width * 4)
                f.write(data)
        return pd.DataFrame({"n": [len(part)]})

    chunk = F.floor(F.col("_at") / per).alias("_chunk")
    written = placed.select("_at", "x").groupBy(chunk).applyInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise OSError(f"{written} of {n} windows written to {path}")
