"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language.  A word's probability is the sum over all
its segmentations into pieces, by a forward algorithm; a text's is the product over its words.  Words are runs of
letters in lower case with the vocabulary's word mark in front, of any length; a letter that no piece covers counts as one
unknown piece.  Probabilities come from expectation maximisation over the words of a bounded sample of labelled documents
(forward-backward, so the expected counts are marginalised as well).

The score is the winner's share after tempering by the square root of the word count: 1/languages to 1.

Defined results: null text or a text without a letter: und, score 0; no labelled document at all: und, 0 for every row;
ties go to the language first in order; repeated rows and null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import slices, tokenizer_path, worker_state
from strataflow.llm.tables import ABSENT, PairTable

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents per language to fit on, in expectation; they are chosen by a hash of their id.
SAMPLE = 400
ROUNDS = 3
#: Added to a piece's expected count, and the count of an unknown letter.
FLOOR, UNKNOWN = 0.01, 1e-4
UND = "und"
MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")  # letters and numerals that aren't digits; the latter are cut out after it
#: The forward pass of longer words is rescaled as it goes; a shorter one's probability can't underflow.
SHORT = 24
#: Cells (words by places) of one forward pass.
CELLS = 1 << 18
#: Bytes of words that a worker keeps, about.
KEPT_BYTES = 48 << 20


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    probabilities: np.ndarray  # pieces by languages; the last row is the unknown letter's
    prior: np.ndarray

    def __post_init__(self):
        self.key = uuid.uuid4().hex
        self.longest = max(map(len, self.pieces), default=1)
        # a tree of all beginnings of pieces; node 0 is the empty one
        chars = sorted({c for p in self.pieces for c in p})
        self.char = np.full(0x110000, len(chars), np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(len(chars))
        nodes = {x: n for n, x in enumerate(sorted({p[:i] for p in self.pieces for i in range(len(p) + 1)} | {""}))}
        self.piece_of = np.full(len(nodes), -1, np.int64)
        self.piece_of[[nodes[p] for p in self.pieces]] = list(self.pieces.values())
        self.child = PairTable({(nodes[x[:-1]], int(self.char[ord(x[-1])])): n for x, n in nodes.items() if x}, len(chars) + 1)

    def log_word(self, word: str) -> list[float]:
        return self.log_words([word])[0].tolist()

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(start, end, piece) of each piece that occurs in a word, by end, and the cells a word takes.  A place is the
        word's number times these cells plus the place in the word."""
        unknown = len(self.probabilities) - 1
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width, n = int(sizes.max(initial=0)) + 1, len(words)
        chars = self.char[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")].astype(np.int64)
        word = np.repeat(np.arange(n), sizes)
        at = np.arange(len(chars))  # of the letter that comes next
        first = at - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left, node, begin = sizes[word] - first, np.zeros(len(chars), np.int64), first
        starts, ends, pieces, length = [], [], [], 0
        while len(at):  # all beginnings go one letter further
            node, length = self.child(node, chars[at]).astype(np.int64), length + 1
            on = node < ABSENT
            piece = np.full(len(at), -1, np.int64)
            piece[on] = self.piece_of[node[on]]
            if length == 1:
                piece[piece < 0] = unknown
            hit = piece >= 0
            starts.append(word[hit] * width + begin[hit])
            ends.append(begin[hit] + length)
            pieces.append(piece[hit])
            on &= left > length
            at, word, begin, left, node = at[on] + 1, word[on], begin[on], left[on], node[on]
        start, end, piece = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (starts, ends, pieces))
        order = np.argsort(end * n + start // width)
        start, end, piece = start[order], end[order], piece[order]
        return start, start - start % width + end, piece, width

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        out = np.empty((len(words), len(self.languages)))
        for some in batches_of(words):
            if len(words[some[0]]) > SHORT:
                for i in some:
                    out[i] = self._log_long(words[i])
                continue
            own = [words[i] for i in some]
            start, end, piece, width = self.arcs(own)
            forward = np.zeros((len(own) * width, len(self.languages)))
            forward[::width] = 1.0
            for a, b in by_place(end, width):
                first = np.flatnonzero(np.append(True, end[a + 1 : b] != end[a : b - 1]))
                forward[end[a:b][first]] = np.add.reduceat(forward[start[a:b]] * self.probabilities[piece[a:b]], first, axis=0)
            last = np.arange(len(own)) * width + np.fromiter(map(len, own), np.int64, len(own))
            out[some] = np.log(forward[last])
        return out

    def _log_long(self, word: str) -> np.ndarray:
        """The same for one word: each place's sums are kept relative to the place before, so nothing underflows."""
        unknown, get = len(self.probabilities) - 1, self.pieces.get
        recent, total = [np.ones(len(self.languages))], np.zeros(len(self.languages))  # sums of the last places
        for end in range(1, len(word) + 1):
            arcs = [(k, p) for k in range(1, len(recent) + 1) if (p := get(word[end - k : end])) is not None]
            if not arcs or arcs[0][0] != 1:
                arcs.insert(0, (1, unknown))
            now = sum(recent[-k] * self.probabilities[p] for k, p in arcs)
            recent = [x / now for x in recent[-self.longest + 1 :]] + [np.ones_like(now)] if self.longest > 1 else [np.ones_like(now)]
            total += np.log(now)
        return total


def batches_of(words: list[str]) -> Iterator[list[int]]:
    """Numbers of words of similar length, CELLS cells at most together; longer words than SHORT apart from others."""
    some: list[int] = []
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if some and ((len(some) + 1) * (len(words[i]) + 1) > CELLS or len(words[some[0]]) <= SHORT < len(words[i])):
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def by_place(end: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ranges of arcs that end at the same place within their words, first places first."""
    bounds = np.searchsorted(end % width, np.arange(1, width + 1))
    return [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if a < b]


def words_of(text: str) -> list[str]:
    """Marked words in lower case."""
    out = []
    for w in _WORD.findall(text.lower()):
        if w.isalpha():
            out.append(MARK + w)
        else:
            out += [MARK + x for x in "".join(c if c.isalpha() else " " for c in w).split()]
    return out


def vocabulary_pieces(name: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces that are letters in lower case, with or without the word mark; single letters included."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=tokenizer_path(name))
    every = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [x for x in every if (y := x.removeprefix(MARK)).isalpha() and y == y.lower() or x == MARK]


def fit(counts: dict[str, dict[str, int]], documents: dict[str, int], pieces: list[str] | None = None, rounds: int = ROUNDS) -> Model:
    """Fits piece probabilities per language. counts: marked words' counts by language; documents: for the prior."""
    pieces = vocabulary_pieces() if pieces is None else pieces
    languages = sorted(counts)
    index = {p: i for i, p in enumerate(pieces)}
    n = len(pieces)
    table = np.full((n + 1, len(languages)), 1.0 / (n + 1))
    for column, language in enumerate(languages):
        # pieces start in proportion to how long they are: without this, whole words are never found
        p = np.array([4.0 ** len(x) for x in pieces] + [1e-6])
        p /= p.sum()
        one = Model([language], index, p[:, None], np.ones(1))
        words = list(counts[language])
        lattices = []
        for some in batches_of(words):
            own = [words[i] for i in some]
            *arcs, width = one.arcs(own)
            lattices.append((*arcs, by_place(arcs[1], width), width, np.fromiter(map(len, own), np.int64, len(own)), np.array([counts[language][w] for w in own], float)))
        for _ in range(rounds):
            expected = np.zeros(n + 1)
            for start, end, piece, places, width, sizes, times in lattices:
                value, last = p[piece], np.arange(len(sizes)) * width + sizes
                forward, backward = np.zeros((2, len(sizes) * width))
                forward[::width] = 1.0
                for a, b in places:
                    first = np.flatnonzero(np.append(True, end[a + 1 : b] != end[a : b - 1]))
                    forward[end[a:b][first]] = np.add.reduceat(forward[start[a:b]] * value[a:b], first)
                known = forward[last] > 1e-290  # a word of hundreds of unknown letters tells nothing
                backward[last[known]] = times[known] / forward[last[known]]
                flow = np.zeros(len(start))
                for a, b in reversed(places):
                    flow[a:b] = backward[end[a:b]] * value[a:b]
                    np.add.at(backward, start[a:b], flow[a:b])
                expected += np.bincount(piece, forward[start] * flow, n + 1)
            p = expected + FLOOR
            p[n] = expected[n] + UNKNOWN
            p /= p.sum()
        table[:, column] = p
    total = sum(documents.get(x, 0) + 1 for x in languages)
    return Model(languages, index, table, np.log([(documents.get(x, 0) + 1) / total for x in languages]))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fits a model on about sample documents per language, chosen by hash of their id; None if nothing is labelled.

    What reaches the driver is the word counts of that sample, whatever the size of the table.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    documents = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row a language
    if not documents:
        return None
    spread = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in documents.items() for x in (k, min(1.0, sample / n))]), F.col(lang_col)), F.lit(0.0))
    chosen = known.filter(spread < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])

    words = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in words.toLocalIterator():
        counts.setdefault(lang, {})[word] = n
    for of in counts:
        counts[of] = dict(sorted(counts[of].items()))
    return fit(counts, documents) if counts else None


class Scorer:
    """Scores texts, with the parts and words seen so far and their log probabilities in caches of about most bytes."""

    def __init__(self, model: Model, most: int = KEPT_BYTES):
        self.model, self.most = model, most
        self.entry = 300 + 16 * (len(model.languages) + 1)  # bytes of a part, its word and their rows, about
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}  # row 0 is that of parts without a letter
        self.table = np.zeros((1 << 14, len(self.model.languages) + 1))
        self.used = 1

    def _rows(self, n: int) -> int:
        """Makes room for n rows more; the first of them."""
        first, self.used = self.used, self.used + n
        while self.used > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        return first

    def _learn(self, parts: set[str]) -> None:
        made = {x: words_of(x) for x in parts}
        new = list({w for ws in made.values() for w in ws}.difference(self.words))
        first = self._rows(len(new))
        self.table[first : first + len(new), :-1] = self.model.log_words(new)
        self.table[first : first + len(new), -1] = 1
        self.words.update(zip(new, range(first, first + len(new))))
        for x, ws in made.items():
            if len(ws) == 1:
                self.parts[x] = self.words[ws[0]]
            elif not ws:
                self.parts[x] = 0
            else:
                row = self._rows(1)
                self.table[row] = self.table[[self.words[w] for w in ws]].sum(axis=0)
                self.parts[x] = row

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        split = [x.split() if x else [] for x in texts]
        wanted = {x for parts in split for x in parts}
        missing = wanted.difference(self.parts)
        if (len(self.parts) + len(missing)) * self.entry > self.most:
            self._reset()
            missing = wanted
        self._learn(missing)
        out = []
        for parts in split:
            sums = self.table[np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))].sum(axis=0)
            if not sums[-1]:
                out.append((UND, 0.0))
                continue
            total = sums[:-1] + self.model.prior
            best = int(np.argmax(total))
            share = np.exp((total - total[best]) / math.sqrt(sums[-1]))
            out.append((self.model.languages[best], float(min(1.0, 1.0 / share.sum()))))
        if any(len(x) > 256 for x in missing):
            self._reset()  # very long words aren't kept
        return out


def label(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_col replaced by the predicted language, and the score as _score; other columns stay as they are."""
    if model is None:
        return docs.withColumn(lang_col, F.lit(UND)).withColumn("_score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a row per piece of the vocabulary, a column per language
    columns = [*docs.columns, "_score"]
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("langid", sent.value.key), lambda: Scorer(sent.value))
        for batch in batches:
            found = [x for a, b in slices(batch, text_col) for x in scorer.scores(batch.column(place)[a:b].to_pylist())]
            new = {lang_col: pa.array([x[0] for x in found], pa.string()), "_score": pa.array([x[1] for x in found], pa.float64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(docs_at[c]) for c in columns], columns)

    docs_at = {c: i for i, c in enumerate(docs.columns)}
    known = docs if lang_col in docs_at else docs.withColumn(lang_col, F.lit(None).cast("string"))
    return docs.mapInArrow(work, known.withColumn(lang_col, F.lit("")).withColumn("_score", F.lit(0.0)).schema)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit("").alias("lang_pred"))
    return label(own, model, "text", "lang_pred").select("doc_id", "lang_pred", F.col("_score").alias("score"))


def held_out():
    """Whether crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
