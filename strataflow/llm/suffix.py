"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

A window is a string of LENGTH bytes.  Each window has an anchor: the place of the smallest hash among its BLOCK-byte
blocks, leftmost if equal.  Equal windows have equal anchors at equal places, so it suffices to sort the suffixes that
begin at anchors instead of all.  A run is the stretch of windows that share one anchor.

1.  Each task stores its texts (store: row groups of about a megabyte) and yields its runs: leading token (hash of the
    anchor's block), second token (hash of the whole run's bytes) and place.
2.  Runs are range-partitioned by leading token, second token and place with sampled splitters, so no token can swell a
    bucket.  A bucket sorts its runs by multikey quicksort and compares neighbours.  Equal tokens: every window of these
    runs repeats.  Equal leading token only: some windows may; the run is a candidate.  A bucket can't judge its first
    and last leading token alone; their rows are compared across boundaries by an aggregation over all buckets.
3.  Candidates fetch their bytes from the store and are range-partitioned by leading token.  A bucket ranks its suffixes
    by their first LENGTH bytes, with keys that span twice as many bytes each time (window_ranks), and compares
    neighbours byte for byte.
4.  A hot token, with more bytes than a bucket should hold, is split by what follows and what precedes the anchor: one
    order by the bytes from the anchor on, one by the bytes before it, backwards, each with sampled splitters that all
    tasks know.  A window d bytes of which lie before the anchor is judged in the first order unless a splitter begins with
    its other LENGTH - d bytes (only then can equal windows lie in several buckets); else in the second order unless a
    splitter begins with its d bytes.  What neither can judge consists of parts of two splitters, so there are few such
    windows; each task counts its own and they are compared across tasks.
5.  The repeated stretches return to their row groups, where each text's stretches are merged and cut out.

Equality of whole runs (2), of leading tokens and of the few windows compared across tasks (4) is that of two independent
64-bit hashes, else that of bytes.

Defined results: null text is empty; texts shorter than a window keep all bytes; repeated rows repeat each other's
bytes; null ids are kept; an empty table gives no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import NewFile, arrow_schema, ddl, materialize, open_range, partitions_for, shared_dir, text_of

LENGTH, BLOCK = 200, 64
#: Bytes of text in a row group of the store, about.
GROUP_BYTES = 1 << 20
#: Longer texts are taken in stretches that overlap by LENGTH - 1.
STRETCH = 1 << 21
_PLACE_BITS = 22
#: Runs, and bytes of candidates, per bucket.
PER_BUCKET, BYTES_PER_BUCKET = 1_000_000, 16 << 20
#: Row groups of the store that a task reads again, about.
GROUPS_PER_TASK = 256
#: A token with more than a bucket's even share of the bytes, divided by this, is split over buckets.
SPLITS = 2
#: Rows sampled for each splitter.
SAMPLES = 32
STORE = arrow_schema([("doc_id", pa.int64()), ("text", pa.binary())])
_PLACE = [("file", pa.string()), ("group", pa.int32()), ("row", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
#: token is null in the one row per row group that stands for the group itself.
RUNS = arrow_schema([("token", pa.int64()), ("second", pa.int64()), *_PLACE])
#: kind: REPEATED, CANDIDATE, SAMPLE (of runs known to repeat, for candidates to compare with) or PENDING.
MARKS = arrow_schema([("kind", pa.int32()), ("n", pa.int64()), *[(f.name, f.type) for f in RUNS]])
REPEATED, CANDIDATE, SAMPLE, PENDING = range(4)
BYTES = arrow_schema([("token", pa.int64()), ("sample", pa.bool_()), *_PLACE, ("data", pa.binary())])
#: n: how often a pending window is in its bucket.
SPANS = arrow_schema([("pending", pa.bool_()), ("n", pa.int64()), ("token", pa.int64()), ("window", pa.int64()), *_PLACE])
#: A part of a hot run with the bucket that judges it, or a stretch or window judged already (bucket null).
DEALT = arrow_schema([("bucket", pa.int64()), *[(f.name, f.type) for f in BYTES], *[(n, t) for n, t in (("pending", pa.bool_()), ("n", pa.int64()), ("window", pa.int64()))]])
KEPT = arrow_schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


# --- hashes, anchors and sorting


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(data: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A hash of each string of length bytes: polynomial, by doubling, then mixed."""
    with np.errstate(over="ignore"):
        power, size, part, done, out = base, 1, data.astype(np.uint64) + np.uint64(1), 0, None
        n = len(data) - length + 1
        while size <= length:
            if length & size:  # append this part's strings to those so far
                out = part[done : done + n] if out is None else out * power + part[done : done + n]
                done += size
            if 2 * size <= length:
                part = part[:-size] * power + part[size:]
            power, size = power * power, 2 * size
        return _finish(out)


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def runs_of(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, leading token) of each run in texts laid end to end; starts: where texts begin.

    The data are at most 2**22 bytes long.  No window crosses from one text to the next.
    """
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),)
    hashes = rolling(data, block, _A)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    anchors = (_window_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - block + 1) & low).astype(np.int64)
    n = len(anchors)
    ends = np.append(starts[1:], len(data))
    long = ends - starts >= length
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - length + 1, -1)
    valid = np.cumsum(change)[:n] > 0
    begins = np.ones(n, bool)
    begins[1:] = (anchors[1:] != anchors[:-1]) | ~valid[:-1]
    begins[starts[long]] = True
    first = np.flatnonzero(begins & valid)
    stops = np.append(np.flatnonzero(begins | ~valid), n)
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    return first, last, hashes[anchors[first]].view(np.int64)


def multikey_sort(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their keys, first key first: a quicksort by one key at a time, in which only rows that are
    still equal are sorted by the next key."""
    order = np.argsort(keys[0])
    open_ = _equal_stretches(keys[0][order])
    for key in keys[1:]:
        if not len(open_):
            break
        rows = order[open_]
        group = np.cumsum(np.append(True, np.diff(open_) != 1) | _changes(keys, rows, key))
        order[open_] = rows[np.lexsort((key[rows], group))]
        keys_so_far = keys[: next(i for i, k in enumerate(keys) if k is key) + 1]
        same = np.ones(len(order) - 1, bool)
        for k in keys_so_far:
            same &= k[order][1:] == k[order][:-1]
        open_ = np.flatnonzero(np.append(False, same) | np.append(same, False))
    return order


def _equal_stretches(values: np.ndarray) -> np.ndarray:
    same = values[1:] == values[:-1]
    return np.flatnonzero(np.append(False, same) | np.append(same, False)) if len(values) > 1 else np.zeros(0, np.int64)


def _changes(keys: list[np.ndarray], rows: np.ndarray, upto: np.ndarray) -> np.ndarray:
    change = np.zeros(len(rows), bool)
    change[0] = True
    for k in keys:
        if k is upto:
            break
        change[1:] |= k[rows][1:] != k[rows][:-1]
    return change


def window_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of each place's next length bytes among all places (the order of the suffixes as far as that), ties equal.

    First by eight bytes, then by keys that pair the ranks of two strings so far; zeros follow the end."""

    def dense(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        own = keys[order]
        out = np.empty(len(keys), np.int64)
        out[order] = np.cumsum(np.append(False, own[1:] != own[:-1]))
        return out

    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n]
    rank, size = dense(word), 8
    while size < length:
        step = min(size, length - size)
        rank, size = dense(rank * n + np.append(rank[step:], np.zeros(min(step, n), np.int64))), size + step
    return rank


def stretches(*values: np.ndarray) -> np.ndarray:
    """Number of the stretch of equal values that each row belongs to, for sorted rows."""
    change = np.zeros(len(values[0]), bool)
    for v in values:
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


# --- step 1: store and runs


def store_and_run(docs: DataFrame, folder: str) -> DataFrame:
    """Writes texts to folder/store; returns rows of RUNS.  docs: doc_id, text (not null)."""

    def runs(group: list[bytes], name: str, number: int) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, name, number, None, None, None), RUNS.types)], schema=RUNS)
        parts, owners, offsets = [], [], []

        def flush() -> pa.RecordBatch:
            at = np.cumsum([0, *map(len, parts)])
            raw = b"".join(parts)
            first, last, token = runs_of(np.frombuffer(raw, np.uint8), at[:-1])
            part = np.searchsorted(at, first, side="right") - 1
            second = np.array([xxh64_intdigest(raw[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())], np.uint64).view(np.int64)
            move = np.array(offsets, np.int64)[part] - at[:-1][part]
            columns = (token, second, None, None, np.array(owners, np.int32)[part], (first + move).astype(np.int32), (last + LENGTH + move).astype(np.int32))
            k = len(first)
            return pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()) if i == 2 else pa.array(np.full(k, number, np.int32)) if i == 3 else pa.array(c) for i, c in enumerate(columns)], schema=RUNS)

        size = 0
        for row, text in enumerate(group):
            for begin in range(0, max(1, len(text) - LENGTH + 1), STRETCH):
                part = text[begin : begin + STRETCH + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                if parts and size + len(part) > STRETCH + LENGTH:
                    yield flush()
                    parts, owners, offsets, size = [], [], [], 0
                parts.append(part)
                owners.append(row)
                offsets.append(begin)
                size += len(part)
        if parts:
            yield flush()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = writer = None
        ids, texts, size, number = [], [], 0, 0

        def close_group() -> Iterator[pa.RecordBatch]:
            nonlocal ids, texts, size, number
            writer.write_table(pa.table([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], schema=STORE))
            yield from runs(texts, out.name, number)
            ids, texts, size, number = [], [], 0, number + 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    out = NewFile(f"{folder}/store", f"texts-{TaskContext.get().partitionId():06d}", ".parquet")
                    writer = pq.ParquetWriter(out.stream, STORE, compression="zstd", use_dictionary=False, write_statistics=False)
                ids.append(doc_id)
                texts.append(text.encode())
                size += len(texts[-1])
                if size >= GROUP_BYTES:
                    yield from close_group()
        if ids:
            yield from close_group()
        if out:
            writer.close()
            out.commit()

    return docs.mapInArrow(work, ddl(RUNS))


# --- step 2: compare runs


def _columns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    found = list(batches)
    return pa.Table.from_batches(found).cast(schema) if found else schema.empty_table()


def _by_boundaries(group: np.ndarray) -> np.ndarray:
    """Which rows of a bucket are in its first or last stretch."""
    return (group == group[0]) | (group == group[-1])


def compare_runs(runs: DataFrame, folder: str) -> DataFrame:
    """Rows of MARKS: what each run is, PENDING for one row per pair of tokens that buckets can't judge alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _columns(batches, RUNS)
        if not table.num_rows:
            return
        token, second = table["token"].to_numpy(), table["second"].to_numpy()
        order = multikey_sort([token, second])
        token, second = token[order], second[order]
        group, pair = stretches(token), stretches(token, second)
        in_pair, in_group = np.bincount(pair), np.bincount(group)
        first_of_pair = np.append(True, pair[1:] != pair[:-1])
        pairs_in_group = np.bincount(group[first_of_pair])
        edge, repeats = _by_boundaries(group), in_pair[pair] > 1
        several = pairs_in_group[group] > 1
        found = [
            (REPEATED, np.flatnonzero(repeats)),
            (CANDIDATE, np.flatnonzero(~repeats & several & ~edge)),
            (SAMPLE, np.flatnonzero(repeats & first_of_pair & several & ~edge)),
            (PENDING, np.flatnonzero(first_of_pair & edge)),
        ]
        rows = np.concatenate([r for _, r in found])
        if len(rows):
            kind = np.concatenate([np.full(len(r), k, np.int32) for k, r in found])
            out = table.take(pa.array(order[rows]))
            yield from pa.Table.from_arrays([pa.array(kind), pa.array(in_pair[pair[rows]].astype(np.int64)), *out.columns], schema=MARKS).combine_chunks().to_batches(max_chunksize=50_000)

    keyed = runs.filter("token is not null")
    n = partitions_for(runs.sparkSession, keyed.count(), PER_BUCKET)
    return keyed.repartitionByRange(n, "token", "second", "file", "group", "row", "start").mapInArrow(work, ddl(MARKS))


def judge_pending(marks: DataFrame) -> DataFrame:
    """Compares buckets' first and last tokens across boundaries: rows of MARKS, none PENDING."""
    pending = marks.filter(F.col("kind") == PENDING)
    pairs = pending.groupBy("token", "second").agg(F.sum("n").alias("all"), F.min(F.struct("file", "group", "row", "start")).alias("one"))
    several = pairs.groupBy("token").agg((F.count(F.lit(1)) > 1).alias("several"))
    known = pending.join(pairs, ["token", "second"]).join(several, "token")
    own = F.col("one") == F.struct("file", "group", "row", "start")
    kinds = F.array_compact(F.array(
        F.when((F.col("n") == 1) & (F.col("all") > 1), REPEATED),
        F.when(F.col("several") & (F.col("all") == 1), CANDIDATE),
        F.when(F.col("several") & (F.col("all") > 1) & own, SAMPLE),
    ))
    return known.select(F.explode(kinds).alias("kind"), *[f.name for f in MARKS][1:])


# --- step 3: compare windows of candidates


def _groups(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict], pa.Table]]:
    """(file, group, rows, the store's row group) of rows sorted by file and group."""

    def rows():
        for batch in batches:
            yield from batch.to_pylist()

    name = handle = store = key = None
    held: list[dict] = []
    for r in rows():
        if (r["file"], r["group"]) != key:
            if held:
                yield *key, held, store.read_row_group(key[1])
            key, held = (r["file"], r["group"]), []
            if r["file"] != name:
                if handle is not None:
                    handle.close()
                name, handle = r["file"], open_range(f"{folder}/store", r["file"])
                store = pq.ParquetFile(handle)
        held.append(r)
    if held:
        yield *key, held, store.read_row_group(key[1])
    if handle is not None:
        handle.close()


def _to_groups(df: DataFrame, groups: int) -> DataFrame:
    n = partitions_for(df.sparkSession, groups, GROUPS_PER_TASK)
    return df.repartition(n, "file", "group").sortWithinPartitions("file", "group")


def fetch(candidates: DataFrame, folder: str, groups: int) -> DataFrame:
    """Rows of BYTES: candidates and samples with the bytes of their windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, table in _groups(folder, batches):
            texts = table["text"]
            out = [(r["token"], r["kind"] == SAMPLE, r["file"], r["group"], r["row"], r["start"], r["end"], texts[r["row"]].as_buffer()[r["start"] : r["end"]].to_pybytes()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), BYTES.types)], schema=BYTES)

    return _to_groups(candidates.select("file", "group", "kind", "token", "row", "start", "end"), groups).mapInArrow(work, ddl(BYTES))


def _spans(table: pa.Table, owner: np.ndarray, window: np.ndarray | None, often: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    base = table.select(["token", "file", "group", "row"]).take(pa.array(owner)).combine_chunks()
    n = len(owner)
    columns = {c: base[c].combine_chunks() if n else base[c] for c in base.column_names}
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, window is not None)), pa.array(often), columns["token"], pa.nulls(n, pa.int64()) if window is None else pa.array(window), columns["file"], columns["group"], columns["row"], pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=SPANS)


def _windows(table: pa.Table, group: np.ndarray, pending: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of SPANS for windows that are equal within a group of table (rows of BYTES); pending: also each distinct window
    once, with its count."""
    sizes = table["end"].to_numpy().astype(np.int64) - table["start"].to_numpy()
    data = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8)
    at = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = at[owner] + inner
    rank = window_ranks(data)[place]
    start = table["start"].to_numpy()[owner] + inner
    row_group = group[owner]
    order = np.lexsort((rank, row_group))
    same = stretches(row_group[order], rank[order])
    sample = table["sample"].to_numpy()[owner]
    often = np.zeros(len(owner), np.int64)
    often[order] = np.bincount(same, 1 + sample[order])[same]  # a sample stands for two runs at least
    rows = np.flatnonzero((often > 1) & ~sample)  # repeated windows in a row make one stretch
    if len(rows):
        fresh = np.append(True, (np.diff(rows) != 1) | (owner[rows][1:] != owner[rows][:-1]))
        first, last = rows[fresh], rows[np.append(np.flatnonzero(fresh)[1:] - 1, len(rows) - 1)]
        yield _spans(table, owner[first], None, often[first], start[first], start[last] + LENGTH)
    if pending:
        once = np.zeros(len(owner), bool)
        once[order] = np.append(True, same[1:] != same[:-1])
        some = np.flatnonzero(once)
        yield _spans(table, owner[some], rolling(data, LENGTH, _B)[place[some]].view(np.int64), often[some], start[some], start[some] + LENGTH)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the windows of each token in a bucket: rows of SPANS, none pending."""
    table = _columns(batches, BYTES).combine_chunks()
    if not table.num_rows:
        return
    table = table.take(pa.array(np.argsort(table["token"].to_numpy(), kind="stable"))).combine_chunks()
    group = stretches(table["token"].to_numpy())
    sizes = table["end"].to_numpy().astype(np.int64) - table["start"].to_numpy()
    begin = 0
    while begin < len(sizes):  # whole tokens, about 2 MB of bytes at a time
        end = min(len(sizes), begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), 2 << 20))))
        end = int(np.searchsorted(group, group[end - 1], side="right"))
        yield from _windows(table.slice(begin, end - begin), group[begin:end])
        begin = end


def _anchors(data: list[bytes]) -> list[int]:
    """Where the anchor of each run lies in its bytes."""
    sizes = np.array([len(x) for x in data], np.int64)
    begin = np.cumsum(sizes) - sizes
    hashes, low = rolling(np.frombuffer(b"".join(data), np.uint8), BLOCK, _A), np.uint64((1 << _PLACE_BITS) - 1)
    return [int(np.argmin(hashes[a : a + LENGTH - BLOCK + 1] & ~low)) for a in begin.tolist()]


def _orders(token: int, data: bytes, anchor: int) -> tuple[bytes, bytes]:
    """Keys of a run in both orders: its token, then the bytes from the anchor on, or those before it, backwards."""
    head = (token + (1 << 63)).to_bytes(8, "big")
    return head + data[anchor : anchor + LENGTH], head + data[:anchor][::-1]


def _reach(key: bytes, splitters: list[bytes]) -> tuple[int, int]:
    """The bucket of a key, and how many bytes after the token it shares with any splitter, -1 if not even the token."""

    def common(other: bytes) -> int:
        low, high = 0, min(len(key), len(other))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if key[:middle] == other[:middle] else (low, middle - 1)
        return low

    at = bisect_right(splitters, key)
    return at, max([common(x) - 8 if common(x) >= 8 else -1 for x in splitters[max(0, at - 1) : at + 1]], default=-1)


def split_hot(content: DataFrame, rows: int, buckets: int, folder: str) -> DataFrame:
    """Rows of DEALT for the runs of hot tokens."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            made = [_orders(*x) for x in zip(batch.column(0).to_pylist(), data, _anchors(data) if data else [])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], pa.binary()) for i in (0, 1)], ["forward", "backward"])

    # SAMPLES rows a splitter and 350 bytes a row, whatever the size of the table
    sampled = content.select("token", "data").sample(min(1.0, SAMPLES * buckets / max(rows, 1)), seed=7).mapInArrow(keys, "forward binary, backward binary").collect()
    splitters = []
    for i in (0, 1):
        found = sorted(bytes(r[i]) for r in sampled)
        splitters.append(sorted({found[k * len(found) // buckets] for k in range(1, buckets)}) if found else [])
    sent = content.sparkSession.sparkContext.broadcast(splitters)

    def part(row: tuple, anchor: int, low: int, high: int) -> tuple:
        """The part of a run whose windows have low to high bytes before the anchor."""
        token, sample, file, group, line, start, _, data = row
        return token, sample, file, group, line, start + anchor - high, start + anchor - low + LENGTH, data[anchor - high : anchor - low + LENGTH]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward, backward = sent.value
        for batch in batches:
            rows, dealt, both = list(zip(*(c.to_pylist() for c in batch.columns))), [], []
            for row, anchor in zip(rows, _anchors(batch.column(7).to_pylist()) if rows else []):
                first, second = _orders(row[0], row[7], anchor)
                (a, shared), (b, before) = _reach(first, forward), _reach(second, backward)
                least, most = max(0, anchor + LENGTH - len(row[7])), anchor
                if (high := min(most, LENGTH - 1 - shared)) >= least:
                    dealt.append((a, *part(row, anchor, least, high)))
                least = max(least, LENGTH - shared)
                if (low := max(least, before + 1)) <= most:
                    dealt.append((buckets + b, *part(row, anchor, low, most)))
                if (high := min(most, before)) >= least:
                    both.append(part(row, anchor, least, high))
            if dealt:
                yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(zip(*dealt), DEALT.types)], *[pa.nulls(len(dealt), t) for t in DEALT.types[9:]]], schema=DEALT)
            if both:
                table = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*both), BYTES.types)], schema=BYTES)
                for span in _windows(table, np.unique(table["token"].to_numpy(), return_inverse=True)[1], pending=True):
                    yield pa.RecordBatch.from_arrays([span.column(c) if c in SPANS.names else pa.nulls(span.num_rows, t) for c, t in zip(DEALT.names, DEALT.types)], schema=DEALT)

    return materialize(content.select(*BYTES.names).mapInArrow(work, ddl(DEALT)), f"{folder}/dealt")


def compare_windows(content: DataFrame, folder: str) -> DataFrame:
    """Rows of SPANS: repeated stretches, and the windows of hot tokens that no bucket can judge (pending).

    Rows of a token stay together unless the token has a large share of all bytes; only such hot tokens are split."""
    spark, length = content.sparkSession, F.col("end") - F.col("start")
    total = int(content.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0])
    n = partitions_for(spark, total, BYTES_PER_BUCKET)
    # fewer than SPLITS * n tokens can have this share of the bytes, so their list may be broadcast
    hot = content.groupBy("token").agg(F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("rows")).filter(F.col("bytes") * (SPLITS * n) > total)
    hot = materialize(hot.select("token", "rows"), f"{folder}/hot")
    rows = hot.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    cold = content.join(F.broadcast(hot), "token", "left_anti") if rows else content
    spans = cold.select(*BYTES.names).repartitionByRange(n, "token").mapInArrow(_judge, ddl(SPANS))
    if not rows:
        return spans
    dealt = split_hot(content.join(F.broadcast(hot), "token", "left_semi"), rows, n, folder)
    judged = dealt.filter("bucket is not null").repartitionByRange(2 * n, "bucket").select(*BYTES.names).mapInArrow(_judge, ddl(SPANS))
    return spans.unionByName(judged).unionByName(dealt.filter("bucket is null").select(*SPANS.names))


def judge_windows(spans: DataFrame) -> DataFrame:
    """Compares pending windows across tasks: (file, group, row, start, end) of those that repeat.

    A task has told of its own repeats already; what is left are windows that are single in theirs but not in all.
    """
    pending = spans.filter("pending")
    counts = pending.groupBy("token", "window").agg(F.sum("n").alias("all")).filter("all > 1")
    return pending.filter("n = 1").join(counts, ["token", "window"]).select("file", "group", "row", "start", "end")


# --- step 4: cut


def cut(stretches_: DataFrame, groups: DataFrame, folder: str, count: int) -> DataFrame:
    """Rows of KEPT for every stored text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows, table in _groups(folder, batches):
            texts, out = table["text"].to_pylist(), []
            spans: dict[int, list] = {}
            for r in rows:
                if r["row"] is not None:
                    spans.setdefault(r["row"], []).append((r["start"], r["end"]))
            for i, (doc_id, text) in enumerate(zip(table["doc_id"].to_pylist(), texts)):
                kept, at, removed, n = hashlib.sha256(), 0, 0, 0
                reach = -1
                for a, b in sorted(spans.get(i, ())):
                    if a > reach:  # not touching the run before
                        n += 1
                        kept.update(text[at:a])
                        removed += b - a
                    else:
                        removed += max(0, b - max(a, reach))
                    reach = max(reach, b)
                    at = reach
                kept.update(text[at:])
                out.append((doc_id, len(text), removed, n, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), KEPT.types)], schema=KEPT)

    place = ["file", "group", "row", "start", "end"]
    return _to_groups(groups.select(*place).unionByName(stretches_.select(*place)), count).mapInArrow(work, ddl(KEPT))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    folder = shared_dir(docs.sparkSession, "suffix")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    runs = materialize(store_and_run(own, folder), f"{folder}/runs")
    marks = materialize(compare_runs(runs, folder), f"{folder}/marks")
    judged = materialize(judge_pending(marks), f"{folder}/judged")
    both = marks.filter(F.col("kind") != PENDING).unionByName(judged)
    groups = runs.filter("token is null")
    count = groups.count()
    content = materialize(fetch(both.filter(F.col("kind").isin(CANDIDATE, SAMPLE)), folder, count), f"{folder}/content")
    spans = materialize(compare_windows(content, folder), f"{folder}/spans")
    place = ["file", "group", "row", "start", "end"]
    repeated = both.filter(F.col("kind") == REPEATED).select(*place).unionByName(spans.filter("not pending").select(*place)).unionByName(judge_windows(spans))
    return cut(repeated, groups, folder, count)
