"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the samples of an 8-bit grey PNG 64 pixels wide.
Payloads are addressed by their SHA-256: each task writes the distinct payloads among its rows into tar shards, and of a
digest that several tasks met one place is chosen for all (the other copies cost disk, one a task at most, and are never
read).  Rows carry digest, shard, offset and length of the stored form.  Range reads of the image headers alone fill the
metadata columns (width, height, depth); features come from a second pass that reads the stored bytes back.

Defined results: null text is empty (a payload of 64 zero bytes); equal texts refer to one stored payload; repeated rows and
null ids are kept; an empty table gives no shards and no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataflow.llm.common import NewFile, arrow_schema, ddl, materialize, open_range, partitions_for, read_range, shared_dir, text_of

WIDTH = 64
#: A shard is closed at about this size.
SHARD_BYTES = 64 << 20
HEADER_BYTES = 33  # PNG signature and the whole IHDR chunk
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PLACES = arrow_schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
HEADERS = arrow_schema([("width", pa.int64()), ("height", pa.int64()), ("depth", pa.int64())])
FEATURES = arrow_schema([("payload_bytes", pa.int64()), ("payload_digest", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_digest", pa.binary()), ("statistics", pa.string())])
#: Stored payloads, and their bytes, that a reading task takes on, about.
PER_TASK, BYTES_PER_TASK = 100_000, 256 << 20


# --- payloads and images


def pad(data: bytes, width: int = WIDTH) -> bytes:
    return data + bytes(-len(data) % width or (0 if data else width))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each row begins with filter type 0
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first HEADER_BYTES."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack_from(">IIB", head, 16)


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG that encode_png made."""
    width, height, _ = png_header(media[:HEADER_BYTES])
    at, data = 8, b""
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("broken PNG chunk")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, standard deviation and entropy (bits) of the samples, to three places."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ (np.arange(256) - mean) ** 2)))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum()) + 0.0
    return f"mean={mean:.3f};std={deviation:.3f};entropy={entropy:.3f}"


# --- shards


class ShardWriter:
    """A tar file in the shared folder; members are named by their digest."""

    def __init__(self, folder: str):
        self.file = NewFile(folder, "media", ".tar")

    def add(self, digest: bytes, media: bytes) -> int:
        """Appends a member and returns where its bytes begin."""
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(media)
        self.file.write(info.tobuf(tarfile.USTAR_FORMAT))
        at = self.file.write(media)
        self.file.write(bytes(-len(media) % 512))
        return at

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.commit()


def write_shards(texts: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores the distinct texts of column text; one row per digest of a payload: shard, offset, length.

    Each task writes the payloads it meets, each once (the digests it has seen take 32 bytes each), so no payload is
    shuffled.  Of a payload that several tasks met, all rows refer to one stored copy; the others are never read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = None, set()
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                data = text.encode()
                payload = pad(data)
                digest = hashlib.sha256(payload).digest()
                if digest in seen:
                    continue
                seen.add(digest)
                media = encode_png(payload)
                shard = shard or ShardWriter(f"{folder}/shards")
                rows.append((digest, shard.file.name, shard.add(digest, media), len(media)))
                if shard.file.offset >= shard_bytes:
                    shard.close()
                    shard = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PLACES.types)], schema=PLACES)
        if shard:
            shard.close()

    place = F.struct("shard", "offset", "length")
    kept = texts.mapInArrow(work, ddl(PLACES)).groupBy("digest").agg(F.min(place).alias("place")).select("digest", "place.*")
    return materialize(kept, f"{folder}/places")


def _handles(folder: str, batch: pa.RecordBatch):
    """(row, open file) for each row of a batch that is sorted by shard."""
    handle, current = None, None
    for row in batch.to_pylist():
        if row["shard"] != current:
            if handle is not None:
                handle.close()
            handle, current = open_range(f"{folder}/shards", row["shard"]), row["shard"]
        yield row, handle
    if handle is not None:
        handle.close()


def _by_shard(places: DataFrame, folder: str, read, schema: pa.Schema) -> DataFrame:
    """The rows of places and what read(row, open file) gives for each, in the order of the shards.

    Rows keep their columns on the way, so no join has to bring them together again."""
    total = places.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    n = max(partitions_for(places.sparkSession, total[0], PER_TASK), partitions_for(places.sparkSession, total[1], BYTES_PER_TASK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := [read(row, h) for row, h in _handles(folder, batch)]:
                added = [pa.array(x, t) for x, t in zip(zip(*rows), schema.types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *schema.names])

    out = StructType(places.schema.fields + StructType.fromDDL(ddl(schema)).fields)
    return places.repartition(n, "shard", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset").mapInArrow(work, out)


def media_headers(places: DataFrame, folder: str) -> DataFrame:
    """places with width, height and depth, from HEADER_BYTES of each stored image."""
    return _by_shard(places, folder, lambda row, h: png_header(read_range(h, row["offset"], HEADER_BYTES)), HEADERS)


def media_features(places: DataFrame, folder: str) -> DataFrame:
    """places with what the stored bytes give: sizes, checksums (digests in 32 bytes) and statistics of the samples."""

    def read(row: dict, handle) -> tuple:
        media = read_range(handle, row["offset"], row["length"])
        payload = decode_png(media)
        digest = hashlib.sha256(payload).digest()
        if digest != row["digest"]:
            raise ValueError(f"{row['shard']} at {row['offset']} isn't the payload of its digest")
        return len(payload), digest, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).digest(), feature_of(payload)

    return _by_shard(places, folder, read, FEATURES)


def media_table(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores every document's payload.  (rows, places): doc_id, n_bytes and digest of each row; the shard, offset, length
    and, from header reads, width, height and depth of each digest."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    places = write_shards(own.select("text"), folder)
    placed = materialize(media_headers(places, folder), f"{folder}/placed")
    data = F.col("text").cast("binary")
    n = F.octet_length("text")
    zeros = F.unhex(F.repeat(F.lit("00"), F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))))
    rows = own.select("doc_id", n.cast("long").alias("n_bytes"), F.unhex(F.sha2(F.concat(data, zeros), 256)).alias("digest"))
    return rows, placed


def media_roundtrip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every document's payload, reads it back; doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and digest, shard, offset, length, width, height and depth of the stored form.

    Equal texts have equal values.  Texts that differ only by zero bytes at their ends share a payload."""
    folder = shared_dir(docs.sparkSession, "media")
    rows, placed = media_table(docs, folder, id_col, text_col)
    # payload_digest was read back and found equal to digest, the key that moves; features aren't written, for disk
    known = media_features(placed, folder).drop("digest").withColumnRenamed("payload_digest", "digest")
    size = F.concat_ws("x", "width", "height", "depth")
    return rows.join(known, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("digest")).alias("payload_sha256"), "tail_crc32",
        "media_bytes", F.lower(F.hex("media_digest")).alias("media_sha256"),
        F.concat(F.lit("png:"), size, F.lit(";"), F.col("statistics")).alias("feature"),
        F.lower(F.hex("digest")).alias("digest"), "shard", "offset", "length", "width", "height", "depth",
    )
