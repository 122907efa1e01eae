"""Helpers that the corpus operators share: the cluster's shared folder, lineage cuts, and file access from executors."""

from __future__ import annotations

import ctypes
import gc
import os
import posixpath
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], the white space of the operators' contracts, as a regular expression.
WS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which the driver and all executors share.

    Only where that setting is absent (a local session, as in tests) does a temporary folder stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/strataflow-shared"
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives a lost executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """As many partitions as keep each one at about per_partition rows, the session's setting at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


#: Row keys that may be broadcast, 8 bytes each.
BROADCAST_KEYS = 2_000_000


def without(rows: DataFrame, drop: DataFrame, path: str, key: str = "_row") -> DataFrame:
    """rows whose key isn't in drop.  The list is written first; it's broadcast if it has at most BROADCAST_KEYS rows."""
    drop = materialize(drop.select(key), path)
    return rows.join(F.broadcast(drop) if drop.count() <= BROADCAST_KEYS else drop, key, "left_anti")


def among(rows: DataFrame, keep: DataFrame, path: str, key: str = "_row") -> DataFrame:
    """rows whose key is in keep, before anything moves them: the list is written and broadcast as in without."""
    keep = materialize(keep.select(key), path)
    return rows.join(F.broadcast(keep) if keep.count() <= BROADCAST_KEYS else keep, key, "left_semi")


def files_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for use on executors."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class NewFile:
    """A file in the shared folder that appears under its final name only once it is whole.

    The name is unique to the task attempt, so a repeated or speculative attempt never touches another's file; rows
    that an attempt returns name its own file.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.fs, root = files_of(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = posixpath.join(root, self.name)
        self.partial = posixpath.join(root, f"_{self.name}.partial")
        self.stream = self.fs.open_output_stream(self.partial)
        self.offset = 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        at, self.offset = self.offset, self.offset + len(data)
        return at

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.partial, self.final)

    def abort(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.partial)


def open_range(folder: str, name: str):
    """A seekable file of the shared folder."""
    fs, root = files_of(folder)
    return fs.open_input_file(posixpath.join(root, name))


def read_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)


def arrow_schema(spec: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in spec])


def ddl(schema: pa.Schema) -> str:
    """The Spark DDL of a flat Arrow schema."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: in the folder TOKENIZERS_DIR if set, else where its package says."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Ranges (first, last) of a batch whose text in column is about most bytes, one row at least."""
    import numpy as np

    sizes = np.array([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()], np.int64) if batch.num_rows else np.zeros(0, np.int64)
    at = 0
    while at < len(sizes):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield at, end
        at = end


_STATE: list = []


def worker_state(key, make):
    """What make() gave for this key in this worker process.  A worker keeps one operator's state: the one before is
    dropped when another key is asked for, so what stages of a pipeline keep doesn't add up, and its memory goes back to
    the system."""
    if not _STATE or _STATE[0] != key:
        held = bool(_STATE)
        _STATE.clear()
        if held:
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)
        _STATE.extend((key, make()))
    return _STATE[1]
