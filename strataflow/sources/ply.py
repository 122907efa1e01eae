"""PLY point clouds: reading ascii and both binary orders, writing little-endian binary parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of the format.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
COLUMNS = "x float, y float, z float, nx float, ny float, nz float, r short, g short, b short"
_NAMES = {"x": "x", "y": "y", "z": "z", "nx": "nx", "ny": "ny", "nz": "nz", "red": "r", "green": "g", "blue": "b"}
LAYOUTS = {"rgb_normal": ("x", "y", "z", "r", "g", "b", "nx", "ny", "nz"), "normal_rgb": ("x", "y", "z", "nx", "ny", "nz", "r", "g", "b")}


def parse(content: bytes) -> dict[str, np.ndarray]:
    """The vertex properties that are known, by column name; unknown ones are passed over."""
    head, _, body = content.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    form = next(x[1] for x in lines if x[:1] == ["format"])
    element, count, properties = None, 0, []
    for x in lines:
        if x[:1] == ["element"]:
            element = x[1]
            count = int(x[2]) if element == "vertex" else count
        elif x[:1] == ["property"] and element == "vertex":
            properties.append((x[2], TYPES[x[1]]))
    if form == "ascii":
        rows = [line.split() for line in body.decode("ascii").splitlines()[:count]]
        data = {name: np.array([r[i] for r in rows]).astype(t) if rows else np.zeros(0, t) for i, (name, t) in enumerate(properties)}
    else:
        order = "<" if form == "binary_little_endian" else ">"
        table = np.frombuffer(body, [(n, order + t) for n, t in properties], count)
        data = {n: table[n] for n, _ in properties}
    return {_NAMES[n]: v for n, v in data.items() if n in _NAMES}


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """One row per vertex of each file: file, idx and the columns of COLUMNS (null where a file lacks them)."""
    schema = f"file string, idx long, {COLUMNS}"
    kinds = {"x": pa.float32(), "r": pa.int16()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = parse(content)
                n = len(data["x"])
                for at in range(0, n, 50_000):
                    k = min(50_000, n - at)
                    arrays = [pa.array([name] * k), pa.array(np.arange(at, at + k))]
                    for c in _NAMES.values():
                        t = kinds["r" if c in "rgb" else "x"]
                        arrays.append(pa.array(data[c][at : at + k].astype(t.to_pandas_dtype()), t) if c in data else pa.nulls(k, t))
                    yield pa.RecordBatch.from_arrays(arrays, ["file", "idx", *_NAMES.values()])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, schema)


def encode(cloud: dict[str, np.ndarray], layout: str = "rgb_normal") -> bytes:
    """A binary PLY file; white where colours are missing, no normals where they are."""
    n = len(cloud["x"])
    names = [c for c in LAYOUTS[layout] if c in cloud or c in "rgb"]
    out = np.zeros(n, [(c, "u1" if c in "rgb" else "<f4") for c in names])
    for c in names:
        out[c] = cloud.get(c, 255)
    back = {v: k for k, v in _NAMES.items()}
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {'uchar' if c in 'rgb' else 'float'} {back[c]}" for c in names], "end_header", ""]
    return "\n".join(head).encode() + out.tobytes()


def ply_parts(cloud: DataFrame, layout: str = "rgb_normal", rows: int = 1_000_000) -> DataFrame:
    """(part, content): whole PLY files of up to rows vertices each, made on the executors."""
    columns = [c for c in LAYOUTS[layout] if c in cloud.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, part = [], 0, TaskContext.get().partitionId() << 20

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([encode({c: table[c].to_numpy() for c in columns}, layout)], pa.binary())], ["part", "content"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield flush()
                held, size, part = [], 0, part + 1
        if size:
            yield flush()

    return cloud.select(*[F.col(c) for c in columns]).mapInArrow(work, "part long, content binary")
