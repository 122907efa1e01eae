"""Near-duplicates by SimHash over word shingles, linked through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank (the position of a code in the reflected Gray sequence), so neighbours in
the order share many bits.  The index is a tree of fixed fan-out over that order: each node keeps the bits on which all
fingerprints below it agree (mask and pattern).  A search walks down from the upper nodes, adds up the bits in which the
query differs from the patterns and drops a whole group as soon as the sum passes the limit; a group in which even the
open bits can't pass the limit is linked as a whole.

Across workers, fingerprints are dealt out by ranges of Gray rank.  A range is a run of cells (equal leading bits), and a
fingerprint also visits each later range that has a cell within the limit; the number of visits grows with the square
of the cells' depth, not with the data.  Each range yields a spanning forest of its links, never all pairs; components
come from alternating large-star and small-star steps on tables in the shared folder.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; fewer words
than a shingle form one shingle; repeated rows and null ids are kept, component_id ignores null ids and is null where a
component has no other; an empty table gives no rows; columns other than id and text aren't read.

The pipeline's stage (keep_one) has a measure of its own: exact Jaccard similarity of the sets of five-word shingles, 0.8
or more.  The same index over the SimHash of these sets proposes the first pairs.  Most similar sets lie further apart
than its two bits, and a search by that many bits would have to visit every range: for those, bands of hashed minima and
rare shingles propose pairs besides, SimHash within a wide limit, the sets' sizes and their minima thin them out.  Texts
decide on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import among, arrow_schema, ddl, materialize, partitions_for, shared_dir, slices, text_of, without, worker_state

SHINGLE, SEED, LIMIT = 3, 42, 2
#: Near copies by words, for the pipeline: words a shingle; the least Jaccard similarity, as a fraction.
WORDS, ALIKE = 5, (4, 5)
#: Bands of hashed minima propose pairs (at similarity 0.8 all bands miss a pair with probability 4e-7), those of SimHash
#: within WIDE bits are compared (at 0.8 about 10 of 64 bits differ, more than WIDE with probability under 1e-6).
BANDS, ROWS, WIDE = 28, 4, 28
#: Of a pair that is in no copy group together, as many of the BANDS * ROWS minima are equal, or its texts aren't compared
#: (at similarity 0.8 about 90 of 112 are, fewer than EQUAL with probability under 1e-6).
EQUAL = 66
#: Rows and shingles, about, of a block of a cluster: the texts of each two blocks are compared in one task.
GROUP, GROUP_SHINGLES = 1024, 2_000_000
#: Of clusters of more blocks, rows are compared by candidates.
BLOCKS = 32
#: Distinct fingerprints per range, about.
PER_RANGE = 100_000
FANOUT = 8
PRINTS = arrow_schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = arrow_schema([("u", pa.int64()), ("v", pa.int64())])
ROUTED = arrow_schema([("fp", pa.int64()), ("range", pa.int32()), ("own", pa.bool_())])


# --- fingerprints


def fingerprints(texts: list[str], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text: words are runs without [\\x20\\x09-\\x0D], A-Z in lower case, shingles joined by spaces."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()  # of bytes: ASCII case and white space alone
        if not words:
            continue
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        if len(words) > shingle:
            starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        counts = np.zeros(64, np.int64)
        starts, ends = starts.tolist(), ends.tolist()
        for at in range(0, len(starts), 1 << 16):
            h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0]
    return out


def document_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()).view(np.int64))], schema=PRINTS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, ddl(PRINTS))


# --- Gray order and the index


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence; codes with equal leading bits have ranks with equal ones."""
    rank = code.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """A hierarchical index over distinct fingerprints, for searches within limit differing bits."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        self.codes = codes[np.argsort(gray_rank(codes))].astype(np.uint64)
        self.fanout = fanout
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (mask, pattern), from the lowest nodes up
        ones, anys = self.codes, self.codes
        while len(ones) > 1:
            at = np.arange(0, len(ones), fanout)
            ones, anys = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(anys, at)
            mask = ~(ones ^ anys)
            self.levels.append((mask, ones & mask))

    def search(self, queries: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (query's place, first code, code after the last): all codes in between are within limit."""
        for first in range(0, len(queries), 2048):
            q = np.arange(first, min(first + 2048, len(queries)))
            node = np.zeros(len(q), np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[level]
                if level < len(self.levels) - 1:
                    q, node = self._children(q, node, len(mask))
                away = np.bitwise_count((queries[q] ^ pattern[node]) & mask[node]).astype(np.int64)
                whole = away + 64 - np.bitwise_count(mask[node]) <= limit
                if whole.any():
                    span = self.fanout ** (level + 1)
                    yield q[whole], node[whole] * span, np.minimum((node[whole] + 1) * span, len(self.codes))
                some = (away <= limit) & ~whole
                q, node = q[some], node[some]
            if self.levels:
                q, node = self._children(q, node, len(self.codes))
            elif not len(self.codes):
                return
            near = np.bitwise_count(queries[q] ^ self.codes[node]) <= limit
            yield q[near], node[near], node[near] + 1

    def _children(self, q: np.ndarray, node: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
        fits = child < count
        return np.repeat(q, self.fanout)[fits], child[fits]


class Forest:
    """Union-find on arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if (up == x).all():
                return x
            self.root[x] = self.root[up]
            x = up

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.root)))


def link_range(own: np.ndarray, visitors: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links of own fingerprints among each other and with visitors."""
    index = GrayIndex(np.unique(own))
    queries = np.concatenate([index.codes, np.unique(visitors)])
    forest, n = Forest(len(queries)), len(index.codes)
    inner = np.zeros(n + 1, np.int64)  # above zero from each code that a group joins to the code after it
    for q, first, last in index.search(queries, limit):
        forest.join(q, first)
        groups = np.unique(np.stack([first, last - 1])[:, last - first > 1], axis=1)
        np.add.at(inner, groups[0], 1)
        np.add.at(inner, groups[1], -1)
    joined = np.flatnonzero(np.cumsum(inner)[:n] > 0)
    forest.join(joined, joined + 1)
    roots = forest.roots()
    child = np.flatnonzero(roots != np.arange(len(roots)))
    return queries[child], queries[roots[child]]


# --- across workers


def cell_masks(depth: int, limit: int = LIMIT) -> np.ndarray:
    """What to flip in the leading depth bits to reach each cell within limit."""
    return np.array([sum(1 << b for b in c) for k in range(limit + 1) for c in combinations(range(depth), k)], np.uint64)


def route(nodes: DataFrame, ranges: int, limit: int = LIMIT) -> DataFrame:
    """(fp, range, own): each fingerprint in its own range of Gray ranks and as a visitor of later ranges in reach."""
    depth = min(24, max(1, (ranges - 1).bit_length() + 5))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = gray_rank(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - depth)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64))], ["cell"])

    splits: list[int] = []
    if ranges > 1:  # as many numbers as ranges
        wanted = [i / ranges for i in range(1, ranges)]
        splits = sorted(set(nodes.select("fp").mapInArrow(rank, "cell long").agg(F.percentile_approx("cell", wanted, 10_000)).first()[0] or []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, masks = np.array(splits, np.int64), cell_masks(depth, limit)
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                top = fp >> np.uint64(64 - depth)
                reach = np.searchsorted(bounds, gray_rank(top[:, None] ^ masks[None, :]).astype(np.int64), side="right")
                home = reach[:, 0]
                reach = np.sort(np.where(reach > home[:, None], reach, -1), axis=1)
                fresh = reach >= 0
                fresh[:, 1:] &= reach[:, 1:] != reach[:, :-1]
                row, column = np.nonzero(fresh)
                fps = np.concatenate([fp, fp[row]]).view(np.int64)
                to = np.concatenate([home, reach[row, column]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(to), pa.array(np.arange(len(fps)) < len(fp))], schema=ROUTED)

    return nodes.select("fp").mapInArrow(work, ddl(ROUTED))


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Spanning links (u, v) between distinct fingerprints of nodes (column fp) at limit or fewer differing bits."""
    ranges = max(1, -(-nodes.count() // PER_RANGE))

    def work(table: pa.Table) -> pa.Table:
        fp, mine = table["fp"].to_numpy().view(np.uint64), table["own"].to_numpy()
        u, v = link_range(fp[mine], fp[~mine], limit)
        return pa.table([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=LINKS)

    return route(nodes, ranges, limit).groupBy("range").applyInArrow(work, ddl(LINKS))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v): each node of edges that isn't the smallest of its component, with that smallest one.

    Alternates large-star and small-star steps.  A node's smallest neighbour is an aggregate that Spark combines before
    the shuffle, joined back to its neighbours; no node's neighbours meet in one task.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), f"{folder}/edges-0")
    state, step = None, 0
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges
        state, step = now, step + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/edges-{step}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs."""
    folder = shared_dir(docs.sparkSession, "simhash")
    prints = materialize(document_prints(docs, id_col, text_col), f"{folder}/prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/nodes")
    stars = components(links(nodes, limit), folder)
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, f"{folder}/rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), f"{folder}/named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by words, for the pipeline


def shingle_set(text: str, shingle: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's distinct word shingles, in order; words as in fingerprints, no words are one empty shingle."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    return np.array(sorted({xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(max(1, len(words) - shingle + 1))}), np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two shingle sets is ALIKE or more, in whole numbers."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return ALIKE[1] * common >= ALIKE[0] * (len(a) + len(b) - common)


def sketch(shingles: np.ndarray) -> tuple[int, list[int], bytes]:
    """(SimHash, a key per band, a byte of each minimum) of a shingle set.  A band's key hashes ROWS of the set's least
    values, each under a multiplier of its own; sets of similarity s share a band with probability s ** ROWS."""
    from xxhash import xxh64_intdigest

    rng = np.random.default_rng(SEED)
    by, plus = rng.integers(0, 2**63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least, counts = np.full(BANDS * ROWS, 2**64 - 1, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(shingles), 2048):
        h = shingles[at : at + 2048]
        least = np.minimum(least, (h * by + plus).min(axis=1))
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(2 * counts > len(shingles), bitorder="little").view("<i8")[0]
    keys = least.reshape(BANDS, ROWS).astype("<u8")
    return int(fp), [xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(keys)], least.astype(np.uint8).tobytes()


def sketches(rows: DataFrame, text_col: str) -> DataFrame:
    """row, fp, size (of its shingle set), bands and minima of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near copies", dict)  # what the stage before kept in this worker goes
        for batch in batches:
            for a, b in slices(batch, "text"):
                sets = [shingle_set(x) for x in batch.column(1)[a:b].to_pylist()]
                made = [sketch(x) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([x[0] for x in made], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([x[1] for x in made], pa.list_(pa.int64())), pa.array([x[2] for x in made], pa.binary())], ["row", "fp", "size", "bands", "minima"])

    return rows.select(F.col("_row").alias("row"), text_of(text_col).alias("text")).mapInArrow(work, "row long, fp long, size long, bands array<long>, minima binary")


def indexed_pairs(drawn: DataFrame, folder: str) -> DataFrame:
    """(u, v), u > v: each row and the least one of its fingerprint, and the least rows of fingerprints that the Gray index
    links.  As many as rows at most, with links of all fingerprints in reach of one another."""
    nodes = materialize(drawn.groupBy("fp").agg(F.min("row").alias("first")), f"{folder}/prints")
    equal = drawn.select("row", "fp").join(nodes, "fp").filter("row != first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    a, b = (nodes.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("u", "a"), ("v", "b")))
    near = links(nodes).join(a, "u").join(b, "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return materialize(equal.unionByName(near), f"{folder}/indexed")


def likely(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """Those (u, v) of pairs of which EQUAL minima are equal."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=LINKS).filter(pa.array((a == b).sum(axis=1) >= EQUAL))

    own = drawn.select("row", "minima")
    both = pairs.join(own.select(F.col("row").alias("u"), F.col("minima").alias("a")), "u").join(own.select(F.col("row").alias("v"), F.col("minima").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(work, ddl(LINKS))


def verified(pairs: DataFrame, rows: DataFrame, text_col: str, path: str) -> DataFrame:
    """Those (u, v) of pairs whose rows' texts are alike; only texts of such rows move."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(row: int, text: str) -> np.ndarray:
            if row not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[row] = shingle_set(text)
            return known[row]

        for batch in batches:
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            same = pa.array([alike(of(i, x), of(j, y)) for i, j, x, y in zip(u, v, a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=LINKS).filter(same)

    needed = pairs.select(F.col("u").alias("_row")).unionByName(pairs.select(F.col("v").alias("_row"))).distinct()
    texts = among(rows, needed, path).select("_row", text_of(text_col).alias("text"))
    both = pairs.join(texts.select(F.col("_row").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("_row").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(work, ddl(LINKS))


def rare_shingles(rows: DataFrame, text_col: str, folder: str) -> DataFrame:
    """(key, row): the rarest fifth of each row's shingles and one more (rarest among rows, ties by hash), those that occur in
    several rows.  Two sets of similarity 0.8 or more have one of these in common: they share four fifths of either."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingle_set(text).view(np.int64)
                for at in range(0, len(found), 50_000):
                    some = found[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row)), pa.array(some)], ["row", "key"])

    every = materialize(rows.select("_row", text_of(text_col).alias("text")).mapInArrow(work, "row long, key long"), f"{folder}/shingles")
    counted = every.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    own = Window.partitionBy("row")
    ranked = counted.withColumn("place", F.row_number().over(own.orderBy("n", "key"))).withColumn("size", F.count(F.lit(1)).over(own))
    most = F.col("size") - F.ceil(F.col("size") * ALIKE[0] / ALIKE[1]) + 1
    return ranked.filter((F.col("place") <= most) & (F.col("n") > 1)).select("key", "row")


def other_pairs(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of one group's members (key, row, fp, size, root, minima) of different roots that may be alike.

    A group of more than GROUP rows is dealt into blocks; each two of them meet in a task of their own."""

    def work(table: pa.Table) -> pa.Table:
        row, fp, size, root, block = (table[c].to_numpy() for c in ("row", "fp", "size", "root", "block"))
        low, high = table["i"][0].as_py(), table["j"][0].as_py()
        minima = np.frombuffer(b"".join(table["minima"].to_pylist()), np.uint8).reshape(len(row), -1)
        u, v = [], []
        right = np.flatnonzero(block == high)
        for i in np.flatnonzero(block == low).tolist():
            j = right[right > i] if low == high else right
            far = ALIKE[1] * np.minimum(size[i], size[j]) < ALIKE[0] * np.maximum(size[i], size[j])
            j = j[(root[j] != root[i]) & ~far & (np.bitwise_count((fp[j] ^ fp[i]).view(np.uint64)) <= WIDE)]
            j = j[(minima[j] == minima[i]).sum(axis=1) >= EQUAL]
            u.append(np.maximum(row[i], row[j]))
            v.append(np.minimum(row[i], row[j]))
        return pa.table([pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (u, v)], schema=LINKS)

    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    own = members.join(sizes, "key").withColumn("block", F.pmod(F.hash("row"), F.col("blocks")))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    dealt = own.withColumn("to", F.explode(to)).select("key", "to.i", "to.j", "block", "row", "fp", "size", "root", "minima")
    return dealt.groupBy("key", "i", "j").applyInArrow(work, ddl(LINKS)).distinct()


def alike_pairs(sets: list[np.ndarray], roots: list[int], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i > j, of sets of different roots that are alike: each set's common shingles with all others are
    counted along the lists of places in which its shingles occur.  first: if above 0, i from there on, j before it."""
    sizes = np.array([len(x) for x in sets])
    owner, root = np.repeat(np.arange(len(sets)), sizes), np.array(roots)
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(name, kind="stable")
    places, count = owner[order], np.bincount(name)
    begin, ends = np.cumsum(count) - count, np.cumsum(sizes)
    left, right = [], []
    for i in range(max(1, first), len(sets)):
        upto = first or i
        own = name[ends[i] - sizes[i] : ends[i]]
        own = own[count[own] > 1]
        n = count[own]
        if not len(own):
            continue
        at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(places[at], minlength=len(sets))[:upto]
        j = np.flatnonzero((ALIKE[1] * common >= ALIKE[0] * (sizes[i] + sizes[:upto] - common)) & (root[:upto] != root[i]))
        left.append(np.full(len(j), i))
        right.append(j)
    return tuple(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (left, right))


def compare_clusters(members: DataFrame, rows: DataFrame, text_col: str, path: str) -> DataFrame:
    """Links (u, v) that span the components of alike rows within each cluster.  members: cluster, blocks (of the cluster),
    row, root.

    A cluster's rows are dealt into blocks, and each two blocks meet, so a row's text moves as often as there are blocks.  Two
    blocks give a spanning forest of their links, fewer than rows, never all pairs."""

    def judge(held: list[tuple]) -> pa.RecordBatch:
        low, high = held[0][1:3]
        held.sort(key=lambda x: x[3])
        made = alike_pairs([shingle_set(x[6]) for x in held], [x[5] for x in held], sum(x[3] == low for x in held) if low != high else 0)
        row, forest = np.array([x[4] for x in held], np.int64), Forest(len(held))
        forest.join(*made)
        roots = forest.roots()
        child = np.flatnonzero(roots != np.arange(len(roots)))
        u, v = row[child], row[roots[child]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], schema=LINKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != x[:3]:
                    if len(held) > 1:
                        yield judge(held)
                    held = []
                held.append(x)
        if len(held) > 1:
            yield judge(held)

    needed = members.select(F.col("row").alias("_row")).distinct()
    texts = among(rows, needed, path).select(F.col("_row").alias("row"), text_of(text_col).alias("text"))
    own = members.withColumn("block", F.pmod(F.hash("row"), F.col("blocks")))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    dealt = own.withColumn("to", F.explode(to)).select("cluster", "to.i", "to.j", "block", "row", "root").join(texts, "row")
    n = partitions_for(rows.sparkSession, members.count(), GROUP)
    dealt = dealt.select("cluster", "i", "j", "block", "row", "root", "text").repartition(n, "cluster", "i", "j")
    return dealt.sortWithinPartitions("cluster", "i", "j").mapInArrow(work, ddl(LINKS))


def near_copies(rows: DataFrame, text_col: str, folder: str) -> DataFrame:
    """(u, v): each row (by _row) that isn't the least of its component of alike rows, with that least one.

    Each row is compared with few others first, the least one of its fingerprint, those that the Gray index links and the
    least of all bands' least rows, so a large group of copies costs a comparison a member and not one a pair.  Rows of bands
    that then lie in different components form clusters.  The texts of two blocks of a cluster meet in one task that counts
    common shingles; in clusters of too many blocks (a passage that many texts share), rows are compared with those with which
    they have a rare shingle in common.
    """
    drawn = materialize(sketches(rows, text_col), f"{folder}/sketches")
    indexed = indexed_pairs(drawn, folder)
    members = drawn.select("row", F.explode("bands").alias("key"))
    least = members.groupBy("key").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Merged, never broadcast: the same shuffle in proportion at any size, and the skew join splits a hot band's rows.
    least = materialize(least.select("key", "least"), f"{folder}/least")
    met = materialize(members.join(least.hint("merge"), "key"), f"{folder}/met")
    first = materialize(met.filter("row != least").select("row", "least").distinct(), f"{folder}/band-pairs")
    other = drawn.select(F.col("row").alias("least"), F.col("fp").alias("least_fp"), F.col("size").alias("least_size"))
    near = first.join(drawn.select("row", "fp", "size"), "row").join(other, "least")
    near = near.filter((F.bit_count(F.col("fp").bitwiseXOR(F.col("least_fp"))) <= WIDE) & (ALIKE[1] * F.least("size", "least_size") >= ALIKE[0] * F.greatest("size", "least_size")))
    banded = likely(near.groupBy(F.col("row").alias("u")).agg(F.min("least").alias("v")), drawn)
    pairs = materialize(indexed.unionByName(banded).distinct(), f"{folder}/pairs")
    stars = components(materialize(verified(pairs, rows, text_col, f"{folder}/compared"), f"{folder}/found"), f"{folder}/first")
    roots = stars.select(F.col("u").alias("row"), F.col("v").alias("root"))

    def mixed(found: DataFrame, name: str) -> DataFrame:
        """found (key, row) with root, and the least row of each key (hub), of the keys whose rows have several roots."""
        rooted = materialize(found.join(roots, "row", "left").select("key", "row", F.coalesce("root", "row").alias("root")), f"{folder}/{name}")
        keys = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("row").alias("hub")).filter("a < b").select("key", "hub")
        return rooted.join(keys, "key")

    left = materialize(mixed(met.select("key", "row"), "left").select("row", "root", "hub").distinct(), f"{folder}/unsure")
    clusters = components(left.select(F.col("row").alias("u"), F.col("hub").alias("v")), f"{folder}/clusters").select(F.col("u").alias("row"), F.col("v").alias("cluster"))
    named = left.select("row", "root").distinct().join(clusters, "row", "left").join(drawn.select("row", "size"), "row").select(F.coalesce("cluster", "row").alias("cluster"), "row", "root", "size")
    named = materialize(named, f"{folder}/named")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("size") / GROUP_SHINGLES)).cast("int")
    sizes = named.groupBy("cluster").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    sized = named.join(sizes, "cluster").select("cluster", "blocks", "row", "root")
    large = materialize(sized.filter(F.col("blocks") > BLOCKS).select("row"), f"{folder}/in-large")
    found = [compare_clusters(sized.filter(F.col("blocks") <= BLOCKS), rows, text_col, f"{folder}/clustered")]
    if large.head(1):
        rare = mixed(rare_shingles(rows.join(large, rows["_row"] == large["row"], "left_semi"), text_col, folder), "rare")
        pairs = materialize(other_pairs(rare.drop("hub").join(drawn.select("row", "fp", "size", "minima"), "row")), f"{folder}/others")
        found.append(verified(pairs, rows, text_col, f"{folder}/compared-others"))
    found = materialize(reduce(DataFrame.unionByName, found), f"{folder}/more")
    return components(stars.unionByName(found), f"{folder}/second") if found.head(1) else stars


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: exactly one of each component of alike rows, that with the smallest id, null ids last.

    Rows are told apart by a key of their own, so repeated and null ids don't matter.  Null text is empty; empty texts and
    texts without words are alike; all columns are kept as they are; an empty table stays empty.
    """
    folder = shared_dir(docs.sparkSession, "near-copies")
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), f"{folder}/rows")
    stars = near_copies(rows, text_col, folder)
    nodes = stars.select(F.col("u").alias("_row"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("_row"), F.col("v").alias("root")).distinct())
    ids = nodes.join(rows.select("_row", F.col(id_col).alias("id")), "_row")
    first = ids.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row"))["_row"].alias("first"))
    return without(rows, ids.join(first, "root").filter("_row != first"), f"{folder}/dropped").select(*docs.columns)
