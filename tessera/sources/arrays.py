"""NumPy's .npy files: read by ranges of rows in parallel, written by the executors. Nothing is unpickled.

A file's header names its type, order and shape; rows are of equal size, so a partition is a range of rows that is read at
its place. A plain array gives row and values (a list for two dimensions), a structured one
a column for each field. Arrays of objects are refused: they are pickles.
"""

from __future__ import annotations

import ast
import io
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from .files import opened, write_files

MAGIC = b"\x93NUMPY"
PART_BYTES = 4 << 20


@dataclass(frozen=True)
class Header:
    dtype: np.dtype
    fortran: bool
    shape: tuple[int, ...]
    start: int


def header(read) -> Header:
    """The header of a file; read(n) gives its next bytes."""
    if read(6) != MAGIC:
        raise ValueError("not a .npy file")
    major = read(2)[0]
    size = struct.unpack("<H", read(2))[0] if major == 1 else struct.unpack("<I", read(4))[0]
    start = (10 if major == 1 else 12) + size
    fields = ast.literal_eval(read(size).decode("utf-8" if major >= 3 else "latin-1"))
    dtype = np.dtype(fields["descr"] if isinstance(fields["descr"], str) else [tuple(x) for x in fields["descr"]])
    if dtype.hasobject:
        raise ValueError("an array of objects is a pickle and is not read")
    if len(fields["shape"]) not in (1, 2) or (dtype.names and len(fields["shape"]) != 1):
        raise ValueError(f"an array of shape {fields['shape']} is no table")
    return Header(dtype, bool(fields["fortran_order"]), tuple(fields["shape"]), start)


def _column(x: np.ndarray) -> pa.Array:
    if x.dtype.kind == "S":
        x = x.astype(f"U{x.dtype.itemsize}")
    if x.dtype.kind in "iufb":
        x = x.astype(x.dtype.newbyteorder("=") if x.dtype.itemsize > 1 else x.dtype)
        x = x.astype({"u1": "i2", "u2": "i4", "u4": "i8", "u8": "i8", "f2": "f4"}.get(x.dtype.str[1:], x.dtype), casting="same_kind" if x.dtype.kind != "u" else "unsafe")
    if x.ndim == 1:
        return pa.array(x if x.dtype.kind != "U" else x.tolist())
    flat = pa.array(np.ascontiguousarray(x).reshape(-1) if x.dtype.kind != "U" else x.reshape(-1).tolist())
    width = int(np.prod(x.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), flat)


def columns(head: Header, rows: np.ndarray) -> dict[str, pa.Array]:
    if head.dtype.names:
        return {n: _column(rows[n]) for n in head.dtype.names}
    return {"values": _column(rows)}


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, paths: list[str], part_bytes: int):
        self.paths, self.part_bytes = paths, part_bytes

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            head = _head(path)
            n, width = head.shape[0], head.dtype.itemsize * int(np.prod(head.shape[1:]))
            step = max(1, self.part_bytes // max(1, width))
            out += [Range(path, a, min(n, a + step)) for a in range(0, n, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        head, (fs, path) = _head(part.path), opened(part.path)
        n, size, wide = head.shape[0], head.dtype.itemsize, int(np.prod(head.shape[1:]))
        count = part.last - part.first
        with fs.open_input_file(path) as f:
            if head.fortran and len(head.shape) == 2:  # a column after another: a piece of each
                rows = np.stack([np.frombuffer(f.read_at(count * size, head.start + (k * n + part.first) * size), head.dtype) for k in range(wide)], axis=1)
            else:
                rows = np.frombuffer(f.read_at(count * size * wide, head.start + part.first * size * wide), head.dtype).reshape(count, *head.shape[1:])
        names = pa.array([path.rpartition("/")[2]] * count), pa.array(np.arange(part.first, part.last))
        found = columns(head, rows)
        yield pa.record_batch([*names, *found.values()], ["file", "row", *found])


def _head(path: str) -> Header:
    fs, p = opened(path)
    with fs.open_input_file(p) as f:
        return header(f.read)


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_npy"

    def _paths(self) -> list[str]:
        fs, p = opened(self.options["path"])
        info = fs.get_file_info(p)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(p)
        if info.is_file:
            return [self.options["path"]]
        found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(p)) if x.is_file and x.path.endswith(".npy"))
        if not found:
            raise FileNotFoundError(f"no .npy files in {p}")
        before = self.options["path"].rstrip("/")
        return [f"{before}/{x.rpartition('/')[2]}" for x in found]

    def schema(self):
        head = _head(self._paths()[0])
        found = columns(head, np.zeros((1, *head.shape[1:]), head.dtype))
        return from_arrow_schema(pa.schema([("file", pa.string()), ("row", pa.int64()), *((n, c.type) for n, c in found.items())]))

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self._paths(), int(self.options.get("partbytes", PART_BYTES)))


def read_arrays(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """file, row, and values or the fields, of a .npy file or a folder of such files of one type."""
    spark.dataSource.register(Arrays)
    return spark.read.format("tessera_npy").option("partbytes", part_bytes).load(path)


def write_arrays(rows: DataFrame, root: str, most_rows: int = 1 << 16) -> None:
    """Numbers, and lists of numbers of one length, as structured .npy files: each partition's rows, most_rows to a file."""
    names = rows.columns

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def file():
            nonlocal held, k
            table, kinds, parts = pa.Table.from_batches(held), [], []
            for name in names:
                c = table[name].combine_chunks()
                if pa.types.is_list(c.type):
                    flat, sizes = c.flatten().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy())
                    if len(set(sizes.tolist())) > 1 or c.null_count:
                        raise ValueError(f"lists of {name} differ in length")
                    parts.append(flat.reshape(len(c), -1))
                    kinds.append((name, flat.dtype, (parts[-1].shape[1],)))
                else:
                    parts.append(c.to_numpy(zero_copy_only=False))
                    kinds.append((name, parts[-1].dtype))
            out = np.zeros(table.num_rows, kinds)
            for name, x in zip(names, parts, strict=True):
                out[name] = x
            content = io.BytesIO()
            np.lib.format.write_array(content, out, allow_pickle=False)
            held, k = [], k + 1
            return pa.record_batch([pa.array([f"part-{task:05}-{k:05}.npy"]), pa.array([content.getvalue()], pa.binary())], ["path", "content"])

        for b in batches:
            while b.num_rows:
                room = most_rows - sum(x.num_rows for x in held)
                held.append(b.slice(0, room))
                b = b.slice(min(room, b.num_rows))
                if sum(x.num_rows for x in held) == most_rows:
                    yield file()
        if held:
            yield file()

    write_files(rows.mapInArrow(run, "path string, content binary"), root)
