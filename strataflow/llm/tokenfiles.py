"""Token ids in flat binary files with 64-bit document offsets, in ascending document order.

Rows are dealt out by ranges of doc_id, so part p holds smaller ids than part p + 1.  A part is two files: NAME.bin, ids
as little-endian unsigned integers (16 bits if the vocabulary allows it, else 32), and NAME.idx: the magic word, width,
counts, then 64-bit offsets (one more than documents) and 64-bit doc_ids with a byte per document that is 1 where doc_id
is null.  A document's place in the whole is its part's base, a prefix sum over parts, plus its offset.  Files on a local
or mounted path are memory-mapped; on another store a part is read by ranges of about READ_BYTES.

Defined results: null text is an empty document (its end id alone); null ids come first; repeated ids keep all their
rows, ordered by a hash of their text; an empty table gives no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import NewFile, arrow_schema, ddl, files_of, materialize, open_range, partitions_for, read_range, shared_dir, text_of
from strataflow.llm.tokens import encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Rows per part, about, and bytes read at once from a store that can't be mapped.
PER_PART, READ_BYTES = 200_000, 8 << 20
MAGIC = b"SFTOKEN1"
_HEAD = struct.Struct("<8sQQQ")  # magic, bytes per id, documents, ids
PARTS = arrow_schema([("part", pa.int64()), ("data", pa.string()), ("index", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])
ROWS = arrow_schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def index_bytes(width: int, lengths: list[int], doc_ids: list[int | None]) -> bytes:
    offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.array(lengths, "<u8"), dtype="<u8")])
    known = np.array([d or 0 for d in doc_ids], "<i8")
    missing = np.array([d is None for d in doc_ids], "u1")
    return _HEAD.pack(MAGIC, width, len(lengths), int(offsets[-1])) + offsets.tobytes() + known.tobytes() + missing.tobytes()


def parse_index(raw: bytes) -> tuple[int, np.ndarray, list[int | None]]:
    """Bytes per id, offsets and doc_ids."""
    magic, width, n, ids = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not an index of token files")
    offsets = np.frombuffer(raw, "<u8", n + 1, _HEAD.size)
    known = np.frombuffer(raw, "<i8", n, _HEAD.size + 8 * (n + 1)).tolist()
    missing = np.frombuffer(raw, "u1", n, _HEAD.size + 8 * (2 * n + 1)).tolist()
    if int(offsets[-1]) != ids:
        raise ValueError("offsets don't reach the last id")
    return width, offsets, [None if m else d for d, m in zip(known, missing)]


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes the parts; one row per part: part, data, index, documents, ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if encode is None:
                encode = encoder(vocabulary)
                kind = "<u2" if max(encode.tokenizer.get_vocab_size(), end_id) <= 1 << 16 else "<u4"
                out, lengths, ids = NewFile(folder, f"part-{part:06d}", ".bin"), [], []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for own in encode.ids(texts[at : at + 256]):
                    out.write(np.append(own, np.uint32(end_id)).astype(kind).tobytes())
                    lengths.append(len(own) + 1)
            ids += batch.column(0).to_pylist()
        if encode is not None:
            index = NewFile(folder, f"part-{part:06d}", ".idx")
            index.write(index_bytes(np.dtype(kind).itemsize, lengths, ids))
            out.commit()
            index.commit()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, out.name, index.name, len(ids), sum(lengths)), PARTS.types)], schema=PARTS)

    n = partitions_for(docs.sparkSession, docs.count(), PER_PART)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = own.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(work, ddl(PARTS)), f"{folder}/manifest")


def with_bases(parts: DataFrame) -> DataFrame:
    """parts with base, the ids in all parts before: a prefix sum over one row per file, not per document."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def part_ids(folder: str, name: str, width: int, offsets: list[int]) -> Iterator[np.ndarray]:
    """Each document's ids: from a memory map where the file has a local path, else from ranges of whole documents."""
    fs, root = files_of(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        ids = np.memmap(f"{root}/{name}", f"<u{width}", "r")
        yield from (ids[a:b] for a, b in zip(offsets, offsets[1:]))
        return
    with open_range(folder, name) as handle:
        first = 0
        while first < len(offsets) - 1:
            last = max(first + 1, bisect_right(offsets, offsets[first] + READ_BYTES // width) - 1)
            base = offsets[first]
            ids = np.frombuffer(read_range(handle, base * width, (offsets[last] - base) * width), f"<u{width}")
            yield from (ids[offsets[k] - base : offsets[k + 1] - base] for k in range(first, last))
            first = last


def read_token_files(parts: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index, base in zip(*(batch.column(c).to_pylist() for c in ("data", "index", "base"))):
                with open_range(folder, index) as handle:
                    width, offsets, doc_ids = parse_index(read_range(handle, 0, handle.size()))
                at = offsets.tolist()
                rows = [(d, base + a, len(ids), zlib.crc32(ids.astype("<u4"))) for d, a, ids in zip(doc_ids, at, part_ids(folder, data, width, at))]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + 10_000])], schema=ROWS)

    n = partitions_for(parts.sparkSession, parts.count(), 1)  # a part a task
    return with_bases(parts).select("data", "index", "base").repartition(n).mapInArrow(work, ddl(ROWS))


def token_roundtrip(docs: DataFrame) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder), folder)
