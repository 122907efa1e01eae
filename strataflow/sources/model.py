"""Model folders in the common sparse-model format (binary and text): cameras, images with 2D points, 3D points with tracks.

A folder's three files become three tables.  A file is one unit of its format (records of varying length behind a count), so
one task parses one file; many folders are read side by side.  Binary files are preferred where a folder has both forms.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Number of parameters per camera model, by model number, and the names used in text files.
PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
NAMES = {0: "SIMPLE_PINHOLE", 1: "PINHOLE", 2: "SIMPLE_RADIAL", 3: "RADIAL", 4: "OPENCV", 5: "OPENCV_FISHEYE", 6: "FULL_OPENCV", 7: "FOV", 8: "SIMPLE_RADIAL_FISHEYE", 9: "RADIAL_FISHEYE", 10: "THIN_PRISM_FISHEYE"}
#: A 2D point without a 3D point.
NONE = 2**64 - 1

SCHEMAS = {
    "cameras": "folder string, camera_id long, model int, width long, height long, params array<double>",
    "images": "folder string, image_id long, q array<double>, t array<double>, camera_id long, name string, points array<struct<x: double, y: double, point3d_id: long>>",
    "points3D": "folder string, point3d_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id: long, point2d_idx: long>>",
}


class _Bytes:
    """A cursor over little-endian bytes; reading past the end is an error."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at = content, 0

    def take(self, form: str) -> tuple:
        found = struct.unpack_from("<" + form, self.content, self.at)
        self.at += struct.calcsize("<" + form)
        return found

    def text(self) -> str:
        end = self.content.index(b"\0", self.at)
        found, self.at = self.content[self.at : end].decode(), end + 1
        return found


def _linked(point: int) -> int | None:
    return None if point == NONE or point == -1 else point


def parse_binary(kind: str, content: bytes) -> Iterator[dict]:
    """Records of a binary file; a truncated file raises struct.error."""
    b = _Bytes(content)
    (count,) = b.take("Q")
    for _ in range(count):
        if kind == "cameras":
            camera, model, width, height = b.take("IiQQ")
            yield {"camera_id": camera, "model": model, "width": width, "height": height, "params": list(b.take(f"{PARAMETERS[model]}d"))}
        elif kind == "images":
            image, *pose, camera = b.take("I7dI")
            name, (n,) = b.text(), b.take("Q")
            flat = b.take("ddQ" * n)
            yield {"image_id": image, "q": pose[:4], "t": pose[4:], "camera_id": camera, "name": name, "points": [{"x": flat[i], "y": flat[i + 1], "point3d_id": _linked(flat[i + 2])} for i in range(0, 3 * n, 3)]}
        else:
            point, x, y, z, red, green, blue, error, n = b.take("QdddBBBdQ")
            flat = b.take("II" * n)
            yield {"point3d_id": point, "x": x, "y": y, "z": z, "r": red, "g": green, "b": blue, "error": error, "track": [{"image_id": flat[i], "point2d_idx": flat[i + 1]} for i in range(0, 2 * n, 2)]}


def parse_text(kind: str, content: bytes) -> Iterator[dict]:
    """Records of a text file: comment lines and blank lines skipped, but an image's second line may be empty."""
    lines = [x.strip() for x in content.decode().splitlines() if not x.lstrip().startswith("#")]
    numbers, at = {v: k for k, v in NAMES.items()}, 0
    while at < len(lines):
        parts, at = lines[at].split(), at + 1
        if not parts:
            continue
        if kind == "cameras":
            yield {"camera_id": int(parts[0]), "model": numbers[parts[1]], "width": int(parts[2]), "height": int(parts[3]), "params": [float(v) for v in parts[4:]]}
        elif kind == "images":
            flat = lines[at].split() if at < len(lines) else []
            at += 1
            yield {"image_id": int(parts[0]), "q": [float(v) for v in parts[1:5]], "t": [float(v) for v in parts[5:8]], "camera_id": int(parts[8]), "name": " ".join(parts[9:]), "points": [{"x": float(flat[i]), "y": float(flat[i + 1]), "point3d_id": _linked(int(flat[i + 2]))} for i in range(0, len(flat), 3)]}
        else:
            track = [int(v) for v in parts[8:]]
            yield {"point3d_id": int(parts[0])} | {c: float(v) for c, v in zip("xyz", parts[1:4])} | {c: int(v) for c, v in zip("rgb", parts[4:7])} | {"error": float(parts[7]), "track": [{"image_id": track[i], "point2d_idx": track[i + 1]} for i in range(0, len(track), 2)]}


def read_model(spark: SparkSession, folder: str, form: str = "auto") -> dict[str, DataFrame]:
    """Tables cameras, images and points3D of a folder, or of all folders a glob names (column folder tells them apart).

    form is binary, text or auto (binary where present).  A 2D point that no 3D point has is linked to null.  A folder
    without one of the files has no rows in that table; a malformed file is an error.
    """
    tables = {}
    for kind, schema in SCHEMAS.items():
        pattern = {"auto": f"{kind}.{{bin,txt}}", "binary": f"{kind}.bin", "text": f"{kind}.txt"}[form]
        found = spark.read.format("binaryFile").load(posixpath.join(folder, pattern)).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.endswith("path", F.lit(".bin")).alias("binary"), "path")
        first = found.groupBy("folder").agg(F.max_by("path", "binary").alias("path"))
        content = spark.read.format("binaryFile").load(posixpath.join(folder, pattern)).select("path", "content")
        arrow = spark.createDataFrame([], schema).schema

        def parse(batches, kind=kind, fields=arrow):
            from pyspark.sql.pandas.types import to_arrow_schema

            for batch in batches:
                for path, where, body in zip(*(batch.column(c).to_pylist() for c in ("path", "folder", "content"))):
                    records = (parse_binary if path.endswith(".bin") else parse_text)(kind, body)
                    rows = []
                    for record in records:
                        rows.append({"folder": where} | record)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(fields))
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(fields))

        tables[kind] = content.join(first, "path").mapInArrow(parse, arrow)
    return tables


def format_binary(kind: str, rows: list[dict]) -> bytes:
    """One file's bytes; 3D links that are null become the format's mark."""
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        if kind == "cameras":
            out.append(struct.pack(f"<IiQQ{PARAMETERS[r['model']]}d", r["camera_id"], r["model"], r["width"], r["height"], *r["params"]))
        elif kind == "images":
            out.append(struct.pack("<I7dI", r["image_id"], *r["q"], *r["t"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(r["points"])))
            out += [struct.pack("<ddQ", p["x"], p["y"], NONE if p["point3d_id"] is None else p["point3d_id"]) for p in r["points"]]
        else:
            out.append(struct.pack("<QdddBBBdQ", r["point3d_id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["error"], len(r["track"])))
            out += [struct.pack("<II", t["image_id"], t["point2d_idx"]) for t in r["track"]]
    return b"".join(out)


def format_text(kind: str, rows: list[dict]) -> bytes:
    """One file's text, numbers with 17 significant digits."""
    number, out = "{:.17g}".format, []
    for r in rows:
        if kind == "cameras":
            out.append(" ".join([str(r["camera_id"]), NAMES[r["model"]], str(r["width"]), str(r["height"]), *map(number, r["params"])]))
        elif kind == "images":
            out.append(" ".join([str(r["image_id"]), *map(number, [*r["q"], *r["t"]]), str(r["camera_id"]), r["name"]]))
            out.append(" ".join(f"{number(p['x'])} {number(p['y'])} {-1 if p['point3d_id'] is None else p['point3d_id']}" for p in r["points"]))
        else:
            out.append(" ".join([str(r["point3d_id"]), *(number(r[c]) for c in "xyz"), *(str(r[c]) for c in "rgb"), number(r["error"]), *(f"{t['image_id']} {t['point2d_idx']}" for t in r["track"])]))
    return "".join(line + "\n" for line in out).encode()


def _writer(kind: str, form: str):
    suffix = {"binary": "bin", "text": "txt"}[form]

    def write(key, table):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(key[0].as_py())
        rows = table.sort_by(table.column_names[1]).to_pylist()
        path, body = f"{base}/{kind}.{suffix}", (format_binary if form == "binary" else format_text)(kind, rows)
        files.create_dir(base, recursive=True)
        part = f"{base}/.{kind}-{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(body)
        files.move(part, path)
        return pa.table({"path": [path], "records": [len(rows)]})

    return write


def write_models(tables: dict[str, DataFrame], form: str = "binary") -> None:
    """Writes each table's rows to the file of its folder column (a URI): one task a file, renamed when it is whole.

    Images without a pose (q null) are left out; records follow their ids.
    """
    for kind, df in tables.items():
        own = df.filter("q is not null") if kind == "images" else df
        own.groupBy("folder").applyInArrow(_writer(kind, form), "path string, records long").write.format("noop").mode("overwrite").save()
