"""Exact deduplication by a partitioned cuckoo-filter index over digests of normalised text.

Each partition of the digest space holds one CuckooIndex: a table of buckets with four slots, a short fingerprint per
slot for the filter and the whole digest beside it for verification.  A filter hit counts only if the bucket's stored
digest is equal.  When an insertion can't find a place after a bounded chain of moves, the table doubles and all stored
digests are inserted anew, so nothing is ever lost.  Digests can be deleted.

Rows are combined before the shuffle: each task sends a digest once, with its smallest id and its count, so a digest that
a third of all rows share arrives once per task.

Defined results: null text counts as empty; a null id is larger than any other when the row to keep is chosen; rows that
repeat an id within a group all carry that keep_id, and kept is true for each row whose id is keep_id; an empty table
gives no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import WS, arrow_schema, ddl, materialize, partitions_for, shared_dir, text_of, without

SLOTS = 4
MOVES = 200
GROUPS = arrow_schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


class CuckooIndex:
    """A cuckoo filter whose slots also hold the digest and a value; capacity grows as needed.

    >>> x = CuckooIndex(1)
    >>> for i in range(100): x[hashlib.sha256(b"%d" % i).digest()] = i
    >>> len(x), x.get(hashlib.sha256(b"7").digest()), x.delete(hashlib.sha256(b"7").digest()), len(x)
    (100, 7, True, 99)
    """

    def __init__(self, buckets: int = 1024):
        self._clear(1 << max(0, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask, self.live = buckets - 1, 0
        self.prints = array("H", bytes(2 * SLOTS * buckets))  # 0: a free slot
        self.stored: list = [None] * (SLOTS * buckets)

    def __len__(self) -> int:
        return self.live

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[:8], "little")
        mark = (h & 0xFFFF) or 1
        first = (h >> 16) & self.mask
        return mark, first, first ^ self._shift(mark)

    def _shift(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 3) & self.mask

    def _find(self, digest: bytes) -> int:
        """The slot that holds digest, or -1: the filter proposes, the stored digest confirms."""
        mark, a, b = self._places(digest)
        for bucket in (a,) if a == b else (a, b):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == mark and self.stored[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes, default=None):
        slot = self._find(digest)
        return default if slot < 0 else self.stored[slot][1]

    def __setitem__(self, digest: bytes, value) -> None:
        slot = self._find(digest)
        if slot >= 0:
            self.stored[slot] = (digest, value)
            return
        left = self._insert((digest, value))
        if left is None:
            self.live += 1
        else:
            self._grow(left)

    def _insert(self, entry: tuple) -> tuple | None:
        """Places an entry; returns the entry that is left over when the chain of moves ends without a place."""
        mark, a, b = self._places(entry[0])
        bucket = a
        for turn in range(MOVES):
            for bucket in (a, b):
                for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.stored[slot] = mark, entry
                        return None
            slot = SLOTS * bucket + (mark + turn) % SLOTS
            (mark, self.prints[slot]), (entry, self.stored[slot]) = (self.prints[slot], mark), (self.stored[slot], entry)
            mark, a, b = self._places(entry[0])
        return entry

    def _grow(self, extra: tuple) -> None:
        """Doubles the table, again if need be, and inserts the stored entries and extra anew."""
        entries = [x for x in self.stored if x is not None] + [extra]
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            if all(self._insert(x) is None for x in entries):
                self.live = len(entries)
                return
            buckets *= 2

    def delete(self, digest: bytes) -> bool:
        slot = self._find(digest)
        if slot < 0:
            return False
        self.prints[slot], self.stored[slot] = 0, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple]:
        return (x for x in self.stored if x is not None)


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WS, " ")


#: Digests per partition of the index, about.
PER_PARTITION = 200_000
#: Digests that a task's own index holds before it hands them on and starts anew.
COMBINE = 200_000


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = [(digest, keep, size) for digest, (keep, size) in index.items()]
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 10_000]), GROUPS.types)], schema=GROUPS)


def _merge(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Merges (digest, keep_id, group_size) rows through an index; a group size below zero deletes its digest.

    most: with that many digests the index is handed on and a new one begins (for the combining before the shuffle).
    """
    index, gone = CuckooIndex(), []
    for batch in batches:
        for digest, keep, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if size < 0:
                gone.append(digest)
                continue
            if (old := index.get(digest)) is not None:
                keep = min((x for x in (old[0], keep) if x is not None), default=None)
                size += old[1]
            index[digest] = (keep, size)
        if most and len(index) >= most:
            yield from _rows(index)
            index = CuckooIndex()
    for digest in gone:
        index.delete(digest)
    yield from _rows(index)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _merge(batches, COMBINE)


def live_index(digests: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(digest, keep_id, group_size) of each live digest, from rows (digest, doc_id); removed: digests to delete."""
    spark = digests.sparkSession
    once = digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(_combine, ddl(GROUPS))
    if removed is not None:
        once = once.unionByName(removed.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(-1).cast("long").alias("group_size")))
    n = partitions_for(spark, digests.count(), PER_PARTITION)
    return once.repartition(n, "digest").mapInArrow(_merge, ddl(GROUPS))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each document.

    removed: a DataFrame whose column digest holds SHA-256 digests (binary) that are deleted from the index: their
    documents have a null keep_id and kept false.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "cuckoo")
    digests = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_of(text_col)).cast("binary"), 256)).alias("digest")), f"{folder}/digests")
    index = materialize(live_index(digests, removed), f"{folder}/index")
    return digests.join(index, "digest", "left").select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", F.lit(0)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull() & F.col("group_size").isNotNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of equal texts the row with the smallest id, one row also where ids repeat.

    Decisions move digests and row keys alone; only the keys of dropped rows meet the texts again.  Null ids are larger
    than any other; all columns are kept as they are; an empty table stays empty."""
    folder = shared_dir(docs.sparkSession, "first")
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), f"{folder}/rows")
    slim = materialize(rows.select("_row", F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_of(text_col)).cast("binary"), 256)).alias("digest")), f"{folder}/digests")
    several = materialize(live_index(slim).filter("group_size > 1"), f"{folder}/several")
    members = slim.join(several, "digest").select("digest", "_row", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("may_stay"))
    stays = members.filter("may_stay").groupBy("digest").agg(F.min("_row").alias("stays"))
    return without(rows, members.join(stays, "digest").filter("_row != stays"), f"{folder}/dropped").select(*docs.columns)
