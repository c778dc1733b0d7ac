"""Array, Arrow and raw binary files as Spark data sources: read by byte ranges, written in parts that appear together.

Formats: `arrays.npy`, `arrays.npz`, `arrays.raw` and `arrays.ipc` (see `register`). A path is a file, or a folder of parts with a
list of those that count; it may have any scheme that pyarrow opens, and all executors must reach it.

Writing has two phases. A task writes files of names that no other attempt uses to a hidden folder; the commit moves
those of the attempts that succeeded and then puts a new list in place of the old one. Readers go by the list, so they
see all of a write or nothing of it, and a failed write leaves nothing.
"""

from __future__ import annotations

import io
import json
import posixpath
import struct
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LIST = "_parts.json"
#: Bytes that a task reads, rows of a batch handed to Spark, rows of a written file (held by the writing task).
SPLIT, BATCH, PART_ROWS = 32 << 20, 8192, 16_384
#: Arrow files are written in batches of so many rows.
IPC_ROWS = 128
_NAMES = {"f4": "float", "f8": "double", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "b1": "boolean"}
_WIDER = {"u1": "i2", "u2": "i4", "u4": "i8"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parts_of(path: str, suffix: str) -> list[str]:
    """The files of a path in order: itself, those on its list, or all of that suffix in a folder without one."""
    files, at = opened(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if files.get_file_info(posixpath.join(at, LIST)).type == fs.FileType.File:
        with files.open_input_stream(posixpath.join(at, LIST)) as f:
            return [posixpath.join(at, n) for n in json.loads(f.read())]
    return sorted(x.path for x in files.get_file_info(fs.FileSelector(at)) if x.path.endswith(suffix) and not posixpath.basename(x.path).startswith(("_", ".")))


@dataclass
class Array:
    """An array in a file: numbers of one kind from `offset` on, a row after the other."""

    name: str
    dtype: str
    shape: tuple[int, ...]
    offset: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize

    def field(self) -> str:
        kind = _NAMES[np.dtype(self.dtype).str[1:]]
        return f"`{self.name}` {kind}" if len(self.shape) == 1 else f"`{self.name}` array<{kind}>"

    def read(self, f: pa.NativeFile, first: int, last: int) -> pa.Array:
        """Rows first to last as Arrow; unsigned numbers as the next wider kind."""
        flat = np.frombuffer(f.read_at((last - first) * self.row_bytes, self.offset + first * self.row_bytes), self.dtype)
        kind = np.dtype(self.dtype)
        flat = flat.astype(kind.newbyteorder("=") if kind.str[1:] not in _WIDER else _WIDER[kind.str[1:]], copy=False)
        if len(self.shape) == 1:
            return pa.array(flat)
        return pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1) * self.width, pa.int32()), pa.array(flat))


def _header(f: io.RawIOBase | pa.NativeFile, name: str, at: int) -> Array:
    """The array whose .npy header begins at a place of a file."""
    f.seek(at)
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValueError(f"{name} is stored by columns")
    if dtype.str[1:] not in _NAMES or not shape:
        raise ValueError(f"{name} has no rows of numbers: {dtype}, {shape}")
    return Array(name, dtype.str, tuple(shape), f.tell())


def arrays_in(files: fs.FileSystem, at: str, kind: str, options: dict[str, str]) -> list[Array]:
    """The arrays of a file."""
    if kind == "raw":
        dtype, width = np.dtype(options.get("dtype", "<u4")), int(options.get("width", 1))
        size, each = files.get_file_info(at).size, dtype.itemsize * width
        if size % each:
            raise ValueError(f"{at} doesn't hold whole rows of {each} bytes")
        return [Array("values", dtype.str, (size // each,) + (() if width == 1 else (width,)), 0)]
    with files.open_input_file(at) as f:
        if kind == "npy":
            return [_header(f, "values", 0)]
        out = []
        with zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if m.compress_type != zipfile.ZIP_STORED:
                    raise ValueError(f"{m.filename} is compressed: it can't be read by byte ranges")
                f.seek(m.header_offset)
                name_size, extra = struct.unpack("<HH", f.read(30)[26:30])
                out.append(_header(f, m.filename.removesuffix(".npy"), m.header_offset + 30 + name_size + extra))
        return out


@dataclass
class Rows(InputPartition):
    """Rows first to last of a file; `start` is the number of its first row among all files."""

    file: str
    first: int
    last: int
    start: int

    def __init__(self, file: str, first: int, last: int, start: int) -> None:
        super().__init__((file, first, last, start))
        self.file, self.first, self.last, self.start = file, first, last, start


class ArrayReader(DataSourceReader):
    """Splits files into ranges of rows, and so of bytes; only the chosen columns' bytes are read."""

    def __init__(self, kind: str, options: dict[str, str], columns: list[str]) -> None:
        self.kind, self.options, self.columns = kind, options, columns

    def partitions(self) -> list[InputPartition]:
        files, _ = opened(self.options["path"])
        out, start, split = [], 0, int(self.options.get("split", SPLIT))
        for at in parts_of(self.options["path"], f".{self.kind}"):
            held = [a for a in arrays_in(files, at, self.kind, self.options) if a.name in self.columns]
            sizes = {a.shape[0] for a in held}
            if len(held) < len([c for c in self.columns if c != "row"]) or len(sizes) > 1:
                raise ValueError(f"{at} lacks a column, or its columns have other numbers of rows: {sorted(sizes)}")
            n = sizes.pop() if sizes else 0
            step = max(1, split // max(1, sum(a.row_bytes for a in held)))
            out += [Rows(at, first, min(n, first + step), start) for first in range(0, n, step)]
            start += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, _ = opened(self.options["path"])
        held = {a.name: a for a in arrays_in(files, partition.file, self.kind, self.options)}
        with files.open_input_file(partition.file) as f:
            for first in range(partition.first, partition.last, BATCH):
                last = min(partition.last, first + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, last) + partition.start) if c == "row" else held[c].read(f, first, last) for c in self.columns], self.columns)


class IpcReader(DataSourceReader):
    """A partition for each run of record batches of a file; other columns than the chosen ones aren't read."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns = options, columns

    def partitions(self) -> list[InputPartition]:
        files, _ = opened(self.options["path"])
        out, each = [], int(self.options.get("batches", 64))
        for at in parts_of(self.options["path"], ".arrow"):
            with files.open_input_file(at) as f:
                n = pa.ipc.open_file(f).num_record_batches
            out += [Rows(at, first, min(n, first + each), 0) for first in range(0, n, each)]
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, at = opened(self.options["path"])
        local = isinstance(files, fs.LocalFileSystem)
        with pa.memory_map(partition.file) if local else files.open_input_file(partition.file) as f:
            whole = pa.ipc.open_file(f).schema
            wanted = [whole.get_field_index(c) for c in self.columns]
            held = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=sorted(wanted)))
            for i in range(partition.first, partition.last):
                yield held.get_batch(i).select(self.columns)


@dataclass
class Wrote(WriterCommitMessage):
    partition: int
    files: list[str]


class PartWriter(DataSourceArrowWriter):
    """Each task writes whole files of at most `rows` rows to a hidden folder; see the module about commits."""

    def __init__(self, kind: str, options: dict[str, str], overwrite: bool) -> None:
        self.kind, self.options, self.overwrite = kind, options, overwrite
        self.suffix = "arrow" if kind == "ipc" else kind
        self.job = uuid.uuid4().hex
        self.rows = int(options.get("rows", PART_ROWS))
        files, at = opened(options["path"])
        files.create_dir(self._hidden(at), recursive=True)  # here alone: a task that outlives an abort finds no folder to write to

    def _hidden(self, at: str) -> str:
        return posixpath.join(at, f"_writing-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, at = opened(self.options["path"])
        partition, made, held, n = TaskContext.get().partitionId(), [], [], 0

        def save() -> None:
            nonlocal held, n
            name = f"part-{partition:06d}-{len(made):05d}-{uuid.uuid4().hex}.{self.suffix}"
            with files.open_output_stream(posixpath.join(self._hidden(at), name)) as out:
                out.write(self.encoded(pa.Table.from_batches(held).combine_chunks()))
            made.append(name)
            held, n = [], 0

        for batch in iterator:
            while batch.num_rows:
                taken = batch.slice(0, self.rows - n)
                held.append(taken)
                n += taken.num_rows
                batch = batch.slice(taken.num_rows)
                if n == self.rows:
                    save()
        if n:
            save()
        return Wrote(partition, made)

    def encoded(self, table: pa.Table) -> bytes:
        """A file's bytes."""
        out = io.BytesIO()
        if self.kind == "ipc":
            with pa.ipc.new_file(out, table.schema) as w:
                w.write_table(table, int(self.options.get("batch", IPC_ROWS)))
            return out.getvalue()
        columns = {c: self._numbers(table.column(c), c) for c in table.column_names}
        if self.kind == "npz":
            np.savez(out, **columns)
        elif len(columns) != 1:
            raise ValueError(f"one column makes a .{self.kind} file, not {len(columns)}")
        elif self.kind == "npy":
            np.save(out, next(iter(columns.values())))
        else:
            out.write(np.ascontiguousarray(next(iter(columns.values()))).tobytes())
        return out.getvalue()

    def _numbers(self, column: pa.ChunkedArray, name: str) -> np.ndarray:
        """A column as an array; all its lists have one length, and no number is missing."""
        array = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        rows, flat = len(array), array.flatten() if pa.types.is_list(array.type) else array
        if array.null_count or flat.null_count:
            raise ValueError(f"{name} has nulls, which arrays can't hold")
        numbers = flat.to_numpy(zero_copy_only=False)
        if "dtype" in self.options:
            numbers = numbers.astype(self.options["dtype"])
        if not pa.types.is_list(array.type):
            return numbers
        sizes = np.diff(array.offsets.to_numpy())
        if len(set(sizes.tolist())) > 1:
            raise ValueError(f"{name} has lists of several lengths")
        return numbers.reshape(rows, -1)

    def commit(self, messages: list[Wrote | None]) -> None:
        files, at = opened(self.options["path"])
        hidden = self._hidden(at)
        found = files.get_file_info(posixpath.join(at, LIST)).type == fs.FileType.File
        before = [posixpath.basename(p) for p in parts_of(self.options["path"], self.suffix)] if found else []
        new = [n for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for n in m.files]
        new = [(n, f"{len(before) * (not self.overwrite) + i:06d}-{self.job}-{n}") for i, n in enumerate(new)]
        for n, name in new:
            files.move(posixpath.join(hidden, n), posixpath.join(at, name))
        names = ([] if self.overwrite else before) + [name for _, name in new]
        with files.open_output_stream(posixpath.join(hidden, LIST)) as out:
            out.write(json.dumps(names).encode())
        files.move(posixpath.join(hidden, LIST), posixpath.join(at, LIST))  # from here on the write is there
        files.delete_dir(hidden)
        for n in before if self.overwrite else []:
            files.delete_file(posixpath.join(at, n))

    def abort(self, messages: list[Wrote | None]) -> None:
        files, at = opened(self.options["path"])
        for left in range(5, 0, -1):  # a running task may add a file meanwhile
            try:
                if files.get_file_info(self._hidden(at)).type == fs.FileType.Directory:
                    files.delete_dir(self._hidden(at))
                return
            except OSError:
                if left == 1:
                    raise
                time.sleep(0.2)


class _Arrays(DataSource):
    """option path; columns (comma-separated; of arrays also `row`, a row's number among all files); split, rows, dtype, width."""

    kind = ""

    @classmethod
    def name(cls) -> str:
        return f"arrays.{cls.kind}"

    def schema(self) -> str:
        files, _ = opened(self.options["path"])
        first = parts_of(self.options["path"], f".{self.kind}")
        fields = {"row": "row long"} | ({a.name: a.field() for a in arrays_in(files, first[0], self.kind, dict(self.options))} if first else {})
        wanted = self.options["columns"].split(",") if self.options.get("columns") else list(fields)
        return ", ".join(fields[c] for c in wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.kind, dict(self.options), schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.kind, dict(self.options), overwrite)


class Npy(_Arrays):
    kind = "npy"


class Npz(_Arrays):
    kind = "npz"


class Raw(_Arrays):
    kind = "raw"


class Ipc(_Arrays):
    kind = "ipc"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files, _ = opened(self.options["path"])
        first = parts_of(self.options["path"], ".arrow")
        if not first:
            raise ValueError(f"no Arrow file in {self.options['path']}")
        with files.open_input_file(first[0]) as f:
            whole = from_arrow_schema(pa.ipc.open_file(f).schema)
        wanted = self.options["columns"].split(",") if self.options.get("columns") else whole.fieldNames()
        return StructType([whole[c] for c in wanted])

    def reader(self, schema: StructType) -> DataSourceReader:
        return IpcReader(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Npy, Npz, Raw, Ipc):
        spark.dataSource.register(source)
