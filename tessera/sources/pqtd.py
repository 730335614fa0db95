"""The PQTD format of numeric tables as a Spark data source: ``spark.read.format("pqtd")`` and ``df.write.format("pqtd")``.

A file is the four bytes PQTD, rows and columns as 8-byte numbers, each column's name as a 4-byte length and UTF-8, and then the rows as
4-byte floats, all with the least byte first.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

MAGIC = b"PQTD"
#: Bytes of rows that a partition reads, and rows that are turned into a batch at once.
PARTITION_BYTES, BATCH_ROWS = 32 << 20, 16_384
NUMBERS = (FloatType(), DoubleType(), IntegerType(), LongType())


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path, which a scheme may name, and the path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The file itself, or the data files of a folder in order of name."""
    store, at = located(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        return sorted(f.path for f in store.get_file_info(pafs.FileSelector(at)) if f.is_file and f.path.endswith(".pqtd"))
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [at]


def exactly(stream: pa.NativeFile, n: int, what: str) -> bytes:
    got = stream.read(n)
    if len(got) < n:
        raise ValueError(f"incomplete file: {what} ends after {len(got)} of {n} bytes")
    return got


def header(store: pafs.FileSystem, path: str) -> tuple[int, list[str], int]:
    """Rows, names, and where the rows start."""
    with store.open_input_file(path) as f:
        if f.read(4) != MAGIC:
            raise ValueError(f"{path} is no PQTD file")
        rows, columns = struct.unpack("<QQ", exactly(f, 16, "header"))
        names = [exactly(f, struct.unpack("<I", exactly(f, 4, "a name"))[0], "a name").decode() for _ in range(columns)]
        return rows, names, f.tell()


@dataclass
class Slice(InputPartition):
    """Rows of one file, from a byte on."""

    path: str
    start: int
    rows: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[Slice]:
        """Ranges of whole rows, told from the headers alone; a file that is too short is an error here, before any task."""
        store, _ = located(self.path)
        out = []
        for path in files_of(self.path):
            rows, names, start = header(store, path)
            if names != self.names:
                raise ValueError(f"{path} has columns {names}, not {self.names}")
            width = 4 * len(names)
            if store.get_file_info(path).size < start + rows * width:
                raise ValueError(f"incomplete file: {path} hasn't {rows} rows")
            each = max(1, PARTITION_BYTES // max(1, width))
            out += [Slice(path, start + at * width, min(each, rows - at)) for at in range(0, rows, each)]
        return out or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        store, _ = located(self.path)
        with store.open_input_file(part.path) as f:
            f.seek(part.start)
            for at in range(0, part.rows, BATCH_ROWS):
                n = min(BATCH_ROWS, part.rows - at)
                x = np.frombuffer(exactly(f, 4 * n * len(self.names), "rows"), "<f4").reshape(n, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1])], self.names)


@dataclass
class Written(WriterCommitMessage):
    """A task's file under its passing name; none if the task had no rows."""

    path: str | None


class Writer(DataSourceArrowWriter):
    """Each task writes a file of its own under a passing name; the driver renames those of the tasks that count, or removes them all."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.job = path, names, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, at = located(self.path)
        store.create_dir(at, recursive=True)
        task = TaskContext.get()
        path = f"{at}/_part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job}"
        rows, body = 0, f"{path}.rows"
        with store.open_output_stream(body) as out:
            for b in batches:
                cells = [np.nan_to_num(c.to_numpy(zero_copy_only=False).astype("<f4"), nan=0.0) if c.null_count else c.to_numpy(zero_copy_only=False).astype("<f4") for c in b.columns]
                out.write(np.stack(cells, 1).tobytes())
                rows += b.num_rows
        if rows:
            with store.open_output_stream(path) as out, store.open_input_stream(body) as whole:
                names = [n.encode() for n in self.names]
                out.write(MAGIC + struct.pack("<QQ", rows, len(names)) + b"".join(struct.pack("<I", len(n)) + n for n in names))
                while piece := whole.read(1 << 20):
                    out.write(piece)
        store.delete_file(body)
        return Written(path if rows else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = located(self.path)
        old = files_of(self.path) if self.overwrite and store.get_file_info(at).type == pafs.FileType.Directory else []
        for m in messages:
            if m and m.path:
                store.move(m.path, m.path.replace("/_part-", "/part-") + ".pqtd")
        for path in old:
            store.delete_file(path)
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Removes what attempts that don't count have left."""
        store, at = located(self.path)
        for f in store.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith("_part-") and self.job in f.base_name:
                store.delete_file(f.path)


class PqtdSource(DataSource):
    """Options: ``path``, a file or a folder of files with the same columns, in a store that pyarrow knows (local, HDFS, S3, GCS). Columns are
    float; nulls are written as 0."""

    @classmethod
    def name(cls) -> str:
        return "pqtd"

    def schema(self) -> StructType:
        store, _ = located(self.options["path"])
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"{self.options['path']} has no PQTD files")
        return StructType([StructField(n, FloatType()) for n in header(store, files[0])[1]])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        wrong = [f.name for f in schema if f.dataType not in NUMBERS]
        if wrong or not schema.names:
            raise TypeError(f"only numeric columns can be written, not {wrong}")
        return Writer(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PqtdSource)


def save(df: DataFrame, path: str) -> None:
    """The numeric columns of ``df`` as a folder of PQTD files, one a partition, in place of what is there."""
    names = [f.name for f in df.schema if f.dataType in NUMBERS]
    if not names:
        raise TypeError("no numeric columns")
    register(df.sparkSession)
    df.select(*[f"`{n}`" for n in names]).write.format("pqtd").mode("overwrite").save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("pqtd").load(path)
