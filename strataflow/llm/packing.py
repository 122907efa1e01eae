"""Packing documents into fixed-length sequences by reciprocal-capacity (harmonic) classes.

Class k holds the pieces of which exactly k fit into a sequence: its pieces are floor(capacity / k) tokens long.  A
document is cut greedily: whole sequences first, then the longest class piece that still fits, until nothing is left;
the rest shrinks about quadratically, so a document has a few pieces.  Each worker (input partition) fills one open bin
per class with exactly k pieces and closes it; no worker needs to know of another, so nothing is shuffled.  What open
bins hold at the end of a partition is laid end to end, cut at each full sequence, and the last stretch is cut into
powers of two, which need no padding.

Defined results: null text is empty; an empty document is its end token alone; repeated rows are packed again; null
doc_id is kept; an empty table gives no pieces.  Only the id and text columns are read, others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import arrow_schema, ddl, text_of
from strataflow.llm.tokens import encoder

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
PIECES = arrow_schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, each floor(capacity / k) for some k.

    >>> cuts(1500), cuts(0), cuts(1)
    ([1024, 341, 128, 7], [], [1])
    """
    out = []
    while length:
        k = max(1, capacity // length)
        if capacity // k > length:
            k += 1
        out.append(capacity // k)
        length -= capacity // k
    return out


class HarmonicPacker:
    """Packs one worker's documents; full bins come out as they fill, the rest from finish().

    A row is (document, start, ids, sequence, offset).  Open bins hold copies of their pieces' ids, less than one
    sequence a class."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list] = {}
        self.cuts: dict[int, list[int]] = {}

    def add(self, document, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        whole, rest = divmod(len(ids), self.capacity)
        if rest not in self.cuts:
            self.cuts[rest] = cuts(rest, self.capacity)
        for size in [self.capacity] * whole + self.cuts[rest]:
            bin_ = self.open.setdefault(size, [])
            bin_.append((document, start, ids[start : start + size]))
            start += size
            if len(bin_) == self.capacity // size:
                out += [(d, s, x, self.next, i * size) for i, (d, s, x) in enumerate(bin_)]
                self.next += 1
                self.open[size] = []
            else:
                bin_[-1] = (*bin_[-1][:2], bin_[-1][2].copy())
        return out

    def finish(self) -> list[tuple]:
        left = [x for size in sorted(self.open, reverse=True) for x in self.open[size]]
        self.open = {}
        whole, rest = divmod(sum(len(x[2]) for x in left), self.capacity)
        room = [self.capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        out, at, number = [], 0, 0
        for document, start, ids in left:
            while len(ids):
                take = min(len(ids), room[number] - at)
                out.append((document, start, ids[:take], self.next, at))
                start, ids, at = start + take, ids[take:], at + take
                if at == room[number]:
                    number, self.next, at = number + 1, self.next + 1, 0
        return out


def harmonic_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the partition's number times 2**40 plus a count within it.
    """

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        out = [(doc_id, start, len(ids), zlib.crc32(ids), total, sequence, offset) for (doc_id, total), start, ids, sequence, offset in pieces]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=PIECES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), HarmonicPacker(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                full = []
                for doc_id, own in zip(batch.column(0)[at : at + 256].to_pylist(), encode.ids(texts[at : at + 256])):
                    full += packer.add((doc_id, len(own) + 1), np.append(own, np.uint32(end_id)))
                if full:
                    yield rows(full)
        if last := packer.finish():
            yield rows(last)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, ddl(PIECES))
