"""SentencePiece encoding with seeded merge-dropout, and decoding.

Byte-pair merges run from an agenda, best piece first, leftmost first among equals.  A candidate merge that comes up is
skipped if a hash keyed by seed, document id, place in the text and piece falls below the dropout rate, so each candidate
of each occurrence of a word is decided on its own; a skipped candidate is gone for good, so other merges take its place.  Without dropout the ids are those of the sentencepiece library.
Whatever is skipped, the pieces spell the text: characters without a piece become byte pieces, and so does a literal word
mark, so decoding gives back every text exactly.

No piece of the vocabulary has a word mark after another character (checked when it is loaded), so segments that begin
at word marks are independent.  The segments of many texts run their agendas in step: a round takes each segment's best
candidate, draws for it, and merges or drops it.  Nothing is kept from one batch to the next.

Defined results: null text is empty; empty text has no ids and decodes to itself; repeated rows with one id give equal
ids; a null id has draws of its own; an empty table gives no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import arrow_schema, ddl, slices, text_of, tokenizer_path, worker_state
from strataflow.llm.tables import ABSENT, PairTable

VOCABULARY = "piece_bpe_32k.model"
SEED, RATE = 17, 0.1
MARK = "▁"
_M64 = (1 << 64) - 1
OUT = arrow_schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_()), ("ids", pa.list_(pa.int32()))])
#: Segments of more characters keep their agenda in a heap, one by one; shorter ones run in step.
SHORT = 64
#: Segments that run in step at a time.
STEP = 8192
_NEVER = ABSENT
_PLACE, _RANK = 0xD1B54A32D192ED03, 0x9E3779B97F4A7C15
#: Stands for a literal word mark among code points.
_LITERAL = 0x110000


def mix(x: int) -> int:
    """A 64-bit finaliser."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


def mix_all(x: np.ndarray) -> np.ndarray:
    """mix of each."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Codec:
    """Encodes with dropout and decodes, over one public vocabulary."""

    def __init__(self, name: str = VOCABULARY, seed: int = SEED, rate: float = RATE):
        from sentencepiece import SentencePieceProcessor
        from xxhash import xxh64_intdigest

        self.library, self.hash = SentencePieceProcessor(model_file=tokenizer_path(name)), xxh64_intdigest
        sp, self.seed, self.below = self.library, seed, int(rate * (1 << 64))
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        whole = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in whole}
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in self.ids):
            raise ValueError("segments of this vocabulary aren't independent")
        order = sorted(whole, key=lambda i: (-sp.get_score(i), i))
        self.order = {self.pieces[i]: n for n, i in enumerate(order)}
        self.raw = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() if p in self.ids else b"" for i, p in enumerate(self.pieces)]
        # symbols: the pieces, characters that are none but part of one, and last any other character
        lone = sorted({c for x in self.ids for c in x} - self.ids.keys())
        self.symbol = {x: n for n, x in enumerate([*self.ids, *lone])}
        self.other = len(self.symbol)
        self.id_of = np.array([*self.ids.values(), *[-1] * (len(lone) + 1)], np.int64)
        self.merged = np.array([self.symbol[self.pieces[i]] for i in order], np.int64)  # symbol by rank
        self.of_char = np.full(_LITERAL + 1, self.other, np.int32)
        for x, n in self.symbol.items():
            if len(x) == 1:
                self.of_char[ord(x)] = n
        get = self.symbol.get
        pairs = {(a, b): self.order[x] for x in self.ids for k in range(1, len(x)) if (a := get(x[:k])) is not None and (b := get(x[k:])) is not None}
        self.rank = PairTable(pairs, self.other + 1)
        self.spelt: dict[int, list[int]] = {}

    def _skipped(self, key: int, place: int, rank: int) -> bool:
        """Whether the merge that would make the piece of this rank at this place (characters before it) is dropped."""
        return mix(key + place * _PLACE + rank * _RANK & _M64) < self.below

    def agenda(self, text: str, key: int | None) -> list[str]:
        """The pieces (and single characters without one) that spell one segment; key: None for no dropout."""
        symbols: list[str | None] = list(text)
        n, order = len(symbols), self.order
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, text[i : i + 2]) for i in range(n - 1) if (r := order.get(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            rank, i, piece = heappop(agenda)
            j = after[i] if symbols[i] is not None else n
            if j >= n or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue  # one of its sides has merged elsewhere
            if key is not None and self._skipped(key, i, rank):
                continue
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := order.get(x := piece + symbols[k])) is not None:
                    heappush(agenda, (r, i, x))
            if (h := before[i]) >= 0 and (r := order.get(x := symbols[h] + piece)) is not None:
                heappush(agenda, (r, h, x))
        return [x for x in symbols if x is not None]

    def _in_step(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, draw: bool) -> tuple[np.ndarray, np.ndarray]:
        """Runs the agendas of segments, one a row, filled up with other: (symbols, whether one begins there)."""
        n, width = symbols.shape
        column = np.arange(width)
        inside = column < sizes[:, None]
        rank = np.full((n, width), _NEVER, np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, -1), _NEVER)
        after, before = (np.tile((column + d).astype(np.int16), (n, 1)) for d in (1, -1))
        flat, ranks, nexts, lasts, begins = symbols.ravel(), rank.ravel(), after.ravel(), before.ravel(), inside.ravel()
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(axis=1)
            base = rows * width
            best = ranks[base + at]
            live = best < _NEVER
            rows, at, base, best = rows[live], at[live], base[live], best[live]
            if draw:
                drop = mix_all(keys[rows] + at.astype(np.uint64) * np.uint64(_PLACE) + best.astype(np.uint64) * np.uint64(_RANK)) < np.uint64(self.below)
                ranks[(base + at)[drop]] = _NEVER
                at, base, best, size = at[~drop], base[~drop], best[~drop], sizes[rows[~drop]]
            else:
                size = sizes[rows]
            here = base + at
            there = base + nexts[here]
            follow = nexts[there].astype(np.int64)
            made = self.merged[best]
            flat[here], begins[there], ranks[there], ranks[here] = made, False, _NEVER, _NEVER
            nexts[here] = follow
            some = np.flatnonzero(follow < size)
            right = base[some] + follow[some]
            lasts[right] = at[some]
            ranks[here[some]] = self.rank(made[some], flat[right])
            previous = lasts[here].astype(np.int64)
            some = np.flatnonzero(previous >= 0)
            left = base[some] + previous[some]
            ranks[left] = self.rank(flat[left], made[some])
        return symbols, begins.reshape(n, width)

    def encode_all(self, texts: list[str], draws: list[int] | None) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers, its candidates drawn for under its own number;
        draws: None for no dropout."""
        points = np.frombuffer("".join(MARK + x for x in texts if x).encode("utf-32-le"), "<u4").astype(np.int64)
        n = len(points)
        size = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
        begin = np.cumsum(size) - size  # of each text
        if not n:
            return [np.zeros(0, "<u4") for _ in texts]
        heads = begin[size > 0]
        literal = points == ord(MARK)
        literal[heads] = False
        points[points == 32] = ord(MARK)
        points[literal] = _LITERAL
        mark = points == ord(MARK)
        fresh = mark.copy()
        fresh[1:] &= ~mark[:-1]
        fresh |= literal
        fresh[1:] |= literal[:-1]
        fresh[heads] = True
        start = np.flatnonzero(fresh)
        length = np.diff(np.append(start, n))
        symbols, begins = self.of_char[points].astype(np.int64), np.ones(n, bool)
        keys = np.zeros(len(start), np.uint64)
        if draws is not None:
            owner = np.searchsorted(heads, start, side="right") - 1
            own = np.array([mix(self.seed + mix(d & _M64) & _M64) for d, x in zip(draws, texts) if x], np.uint64)
            keys = own[owner] + (start - heads[owner]).astype(np.uint64) * np.uint64(_PLACE)
        order = np.argsort(length, kind="stable")
        order = order[np.searchsorted(length[order], 2) :]
        few = int(np.searchsorted(length[order], SHORT, side="right"))
        for a in range(0, few, STEP):
            rows = order[a : min(a + STEP, few)]
            sizes = length[rows]
            inside = np.arange(sizes[-1]) < sizes[:, None]
            cells = (start[rows][:, None] + np.arange(sizes[-1]))[inside]
            table = np.full(inside.shape, self.other, np.int64)
            table[inside] = symbols[cells]
            table, first = self._in_step(table, sizes, keys[rows], draws is not None)
            symbols[cells], begins[cells] = table[inside], first[inside]
        for i in order[few:].tolist():
            at, text = int(start[i]), "".join(map(chr, points[start[i] : start[i] + length[i]].tolist()))
            begins[at : at + len(text)] = False
            for x in self.agenda(text, int(keys[i]) if draws is not None else None):
                symbols[at], begins[at] = self.symbol.get(x, self.other), True
                at += len(x)
        where = np.flatnonzero(begins)
        ids = self.id_of[symbols[where]]
        odd = np.flatnonzero(ids < 0)
        spelt = [self._spell(x) for x in points[where[odd]].tolist()]
        count = np.ones(len(ids), np.int64)
        count[odd] = [len(x) for x in spelt]
        out = np.repeat(ids, count).astype("<u4")
        if spelt:
            out[np.repeat(ids < 0, count)] = np.concatenate(spelt)
        upto = np.append(0, np.cumsum(count))
        bounds = upto[np.searchsorted(where, np.append(begin, n))].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def _spell(self, point: int) -> list[int]:
        """The byte pieces of a character."""
        if point not in self.spelt:
            self.spelt[point] = [self.bytes[b] for b in (MARK if point == _LITERAL else chr(point)).encode()]
        return self.spelt[point]

    def encode(self, text: str, draws: int | None = 0) -> np.ndarray:
        """Ids of one text; draws: its document's number, None for no dropout."""
        return self.encode_all([text], None if draws is None else [draws])[0]

    def decode(self, ids) -> str:
        """The text whose ids these are: the first word mark stands for no space."""
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, lossless, ids of each row; decoding is done on every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_state(("dropout", vocabulary, seed, rate), lambda: Codec(vocabulary, seed, rate))
        for batch in batches:
            for a, b in slices(batch, "text"):
                doc_ids, texts = (batch.column(i)[a:b].to_pylist() for i in (0, 1))
                made = codec.encode_all(texts, [codec.hash(b"%d" % i if i is not None else b"", seed) for i in doc_ids])
                back = [codec.decode(ids.tolist()) for ids in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([len(x) for x in made], pa.int64()),
                        pa.array([zlib.crc32(x) for x in made], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]),
                        pa.array([x == y for x, y in zip(back, texts)], pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made).astype(np.int32))),
                    ],
                    schema=OUT,
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, ddl(OUT))
