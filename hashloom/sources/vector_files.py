"""Vector files: npy, u8bin, fbin, bvecs, fvecs and headerless raw, read by row ranges through a Spark data source.

`read_vectors(spark, path)` gives vec_id, embedding. The file lies where driver and executors can open it (a shared mount); vectors in
object stores are read as Parquet. A layout is told by its exact file size, and a size that fits none raises.
"""

from __future__ import annotations

import ast
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "vec_id bigint, embedding array<float>"


@dataclass(frozen=True)
class Layout:
    """Where the rows of a file lie: n rows of d values of `dtype`, each after `lead` bytes, from `start` on."""

    n: int
    d: int
    dtype: str
    start: int
    lead: int = 0

    @property
    def row(self) -> int:
        return self.lead + self.d * np.dtype(self.dtype).itemsize


def npy_layout(path: str) -> Layout:
    """Layout of a two-dimensional C-order .npy file of version 1 or 2."""
    with open(path, "rb") as f:
        magic = f.read(8)
        if magic[:6] != b"\x93NUMPY" or magic[6] not in (1, 2):
            raise ValueError(f"{path} is no .npy file of version 1 or 2")
        n = struct.unpack("<H", f.read(2))[0] if magic[6] == 1 else struct.unpack("<I", f.read(4))[0]
        head = ast.literal_eval(f.read(n).decode("latin-1"))
        start = f.tell()
    if head["fortran_order"] or len(head["shape"]) != 2:
        raise ValueError(f"{path} isn't a two-dimensional matrix in C order")
    out = Layout(*head["shape"], head["descr"], start)
    if os.path.getsize(path) < start + out.n * out.row:
        raise ValueError(f"{path} is cut short")
    return out


def headed_layout(path: str, dtype: str) -> Layout:
    """Layout of a file with two unsigned counts (rows, values a row) before the values: u8bin and fbin."""
    with open(path, "rb") as f:
        n, d = struct.unpack("<II", f.read(8))
    out = Layout(n, d, dtype, 8)
    if os.path.getsize(path) != 8 + n * out.row:
        raise ValueError(f"{path}: its size doesn't fit {n} x {d}")
    return out


def row_headed_layout(path: str, dtype: str, probes: int = 64) -> Layout:
    """Layout of a file whose every row begins with its count: bvecs and fvecs; `probes` evenly spaced rows are checked."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        d = struct.unpack("<i", f.read(4))[0]
        row = 4 + d * np.dtype(dtype).itemsize
        if d <= 0 or size % row:
            raise ValueError(f"{path}: its size doesn't fit rows of {d}")
        n = size // row
        for k in range(min(probes, n)):
            f.seek(k * (n - 1) // max(1, min(probes, n) - 1) * row)
            if struct.unpack("<i", f.read(4))[0] != d:
                raise ValueError(f"{path}: its rows differ in length")
    return Layout(n, d, dtype, 4 - 4, 4)


def dim_headed_layout(path: str, dtype: str) -> Layout:
    """Layout of a file that begins with the values a row alone."""
    with open(path, "rb") as f:
        d = struct.unpack("<I", f.read(4))[0]
    size = os.path.getsize(path) - 4
    row = d * np.dtype(dtype).itemsize
    if not row or size % row:
        raise ValueError(f"{path}: its size doesn't fit rows of {d}")
    return Layout(size // row, d, dtype, 4)


def raw_layout(path: str, dtype: str, n: int | None = None, d: int | None = None) -> Layout:
    """Layout of a file without header, from its rows or its values a row."""
    values = os.path.getsize(path) // np.dtype(dtype).itemsize
    if not n and not d:
        raise ValueError("a raw file needs n or d")
    n, d = (n or values // d), (d or values // n)
    if n * d * np.dtype(dtype).itemsize != os.path.getsize(path):
        raise ValueError(f"{path}: its size doesn't fit {n} x {d}")
    return Layout(n, d, dtype, 0)


def layout(path: str, fmt: str = "auto", dtype: str | None = None, n: int | None = None, d: int | None = None) -> Layout:
    """Layout by format, or for auto by the name's ending and the size. Raises if an expected n, d or dtype differs."""
    ending = os.path.splitext(path)[1].lstrip(".").lower()
    kind = ending if fmt == "auto" else fmt

    def first(*ways):
        errors = []
        for way, t in ways:
            try:
                return way(path, t)
            except (ValueError, struct.error) as e:
                errors.append(str(e))
        raise ValueError("; ".join(errors))

    if kind == "npy":
        out = npy_layout(path)
    elif kind in ("u8bin", "bvecs"):
        out = first((headed_layout, "u1"), (row_headed_layout, "u1"), (dim_headed_layout, "u1"))
    elif kind in ("fbin", "fin", "fvecs"):
        out = first((headed_layout, "<f4"), (row_headed_layout, "<f4"))
    elif kind in ("bin", "raw"):
        out = raw_layout(path, dtype or "<f4", n, d)
    else:
        raise ValueError(f"unknown format {kind!r}")
    for what, want, got in (("n", n, out.n), ("d", d, out.d), ("dtype", dtype and np.dtype(dtype), np.dtype(out.dtype))):
        if want and want != got:
            raise ValueError(f"{path}: expected {what} {want}, found {got}")
    return out


def rows(path: str, at: Layout, start: int, stop: int) -> np.ndarray:
    """Rows start..stop as floats."""
    with open(path, "rb") as f:
        f.seek(at.start + start * at.row)
        raw = np.frombuffer(f.read((stop - start) * at.row), np.uint8).reshape(-1, at.row)
    return np.ascontiguousarray(raw[:, at.lead :]).view(at.dtype).astype(np.float32)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, at: Layout, size: int) -> None:
        self.path, self.at, self.size = path, at, size

    def partitions(self) -> list[_Range]:
        return [_Range(s, min(s + self.size, self.at.n)) for s in range(0, self.at.n, self.size)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator:
        import pyarrow as pa

        for s in range(part.start, part.stop, 8192):
            x = rows(self.path, self.at, s, min(s + 8192, part.stop))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * self.at.d), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(x))), lists], names=["vec_id", "embedding"])


class VectorFiles(DataSource):
    """Spark data source `vectors`: options path, fmt, dtype, n, d, rows (rows of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        number = lambda k: int(o[k]) if o.get(k) else None
        at = layout(o["path"], o.get("fmt", "auto"), o.get("dtype"), number("n"), number("d"))
        return _Reader(o["path"], at, number("rows") or max(1, (64 << 20) // max(1, at.row)))


def read_vectors(spark: SparkSession, path: str, fmt: str = "auto", **options) -> DataFrame:
    spark.dataSource.register(VectorFiles)
    return spark.read.format("vectors").options(path=path, fmt=fmt, **{k: str(v) for k, v in options.items() if v is not None}).load()


def head(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("vec_id") < n)


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last n rows by id."""
    last = df.agg((F.max("vec_id") - n).alias("_last"))
    return df.crossJoin(F.broadcast(last)).where(F.col("vec_id") > F.col("_last")).drop("_last")


def to_npy(src: str, dst: str, fmt: str = "auto", dtype: str = "<f4", chunk: int = 65_536, scale: float = 1.0) -> None:
    """Copy a vector file to .npy in chunks, values over `scale`; unsigned bytes are cut to 0..255. The result appears whole or not at all."""
    at = layout(src, fmt)
    part = f"{dst}.part"
    out = np.lib.format.open_memmap(part, "w+", np.dtype(dtype), (at.n, at.d))
    for s in range(0, at.n, chunk):
        x = rows(src, at, s, min(s + chunk, at.n)) / scale
        out[s : s + len(x)] = np.clip(x, 0, 255) if np.dtype(dtype) == np.uint8 else x
    out.flush()
    os.replace(part, dst)


def to_raw(src: str, dst: str, fmt: str = "auto", dtype: str | None = None, head_rows: int | None = None, tail_rows: int | None = None) -> None:
    """Write rows without header; the first or the last ones if asked for, not both."""
    if head_rows and tail_rows:
        raise ValueError("head or tail, not both")
    at = layout(src, fmt)
    start = max(0, at.n - tail_rows) if tail_rows else 0
    stop = min(at.n, head_rows) if head_rows else at.n
    kind = np.dtype(dtype or at.dtype)
    with open(f"{dst}.part", "wb") as f:
        for s in range(start, stop, 65_536):
            x = rows(src, at, s, min(s + 65_536, stop))
            f.write((np.clip(x, 0, 255) if kind == np.uint8 else x).astype(kind).tobytes())
    os.replace(f"{dst}.part", dst)
