"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability in a language is the sum, over all ways to cut it into pieces,
of the product of the pieces' probabilities, found by the forward algorithm; a
text's is the product over its words. The probabilities are learned by
expectation maximisation on a bounded sample of labelled rows: at most
``sample_docs`` documents a language, chosen by the hash of their id. What is
learned is one number for each piece and language.

A word is a run of non-spaces with a space before it, in UTF-8. Words of any length
are summed whole, and all pieces of the vocabulary are used. Forward sums are made
for many distinct words at once in numpy, those of words longer than
``LINEAR_BYTES`` on logarithms; a worker process keeps those it has made, up to
``MOST_WORDS``.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is
every text if nothing could be learned; equal scores go to the language that
sorts first; only text and lang of the rows given to ``fit`` are used; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Up to this length a word's sums stay in the range of a double.
LINEAR_BYTES = 48
MOST_WORDS = 300_000
#: Longer words are not kept.
KEPT_BYTES = 256
#: Sums are kept in range by this factor a byte.
SCALE = 1024.0
BATCH = 8192
#: Bytes of a batch of long words.
BATCH_BYTES = 1 << 17
#: Places whose arcs' probabilities are gathered at a time.
BLOCK = 64

_WORD_CHARS = re.compile(r"[^\W\d_]+")
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary's pieces as a tree of their bytes. Node 0 is the empty piece."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranked = [(int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines)]
        self.pieces = [p for _, p in sorted(ranked)]
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[int] = []  # parent and byte of each further node
        for p in self.pieces:
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    edges.append(nodes[p[: n - 1]] << 8 | p[n - 1])
        self.piece = np.full(len(nodes), -1, dtype=np.int32)  #: of each node, -1 where no piece ends
        self.piece[[nodes[p] for p in self.pieces]] = np.arange(len(self.pieces))
        self.keys = np.array(edges, dtype=np.int64)
        bits = 2 + len(edges).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(edges), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def __len__(self) -> int:
        return len(self.pieces)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node that follows each node by a byte, -1 where no piece goes on so."""
        keys = nodes.astype(np.int64) << 8 | byte
        slot = self._slot(keys)
        found = self.slots[slot]
        going = np.flatnonzero(found >= 0)
        going = going[self.keys[found[going]] != keys[going]]
        while len(going):
            slot[going] = (slot[going] + 1) & (len(self.slots) - 1)
            found[going] = self.slots[slot[going]]
            going = going[found[going] >= 0]
            going = going[self.keys[found[going]] != keys[going]]
        return np.where(found >= 0, found + 1, -1)

    def prior(self) -> np.ndarray:
        """Piece probabilities before anything is learned, by rank in the vocabulary."""
        p = 1.0 / (np.arange(len(self)) + 100.0)
        return p / p.sum()


_vocabularies: dict[str, Pieces] = {}


def vocabulary(name: str) -> Pieces:
    if name not in _vocabularies:
        _vocabularies[name] = Pieces(public_tokenizers.path(name))
    return _vocabularies[name]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for run in _WORD_CHARS.finditer(text) for c in run[0])


def words_of(text: str) -> list[bytes]:
    """The text's words with a space before each."""
    return [b" " + w for w in text.encode().split()]


def batches_of(words: list[bytes]) -> Iterator[slice]:
    """Batches of words that are in order of length: BATCH short ones, or long ones of about BATCH_BYTES."""
    at = 0
    while at < len(words):
        short = len(words[at]) <= LINEAR_BYTES
        stop, n = at, 0
        while stop < len(words) and stop - at < BATCH and (len(words[stop]) <= LINEAR_BYTES) == short and (short or n < BATCH_BYTES):
            n += len(words[stop])
            stop += 1
        yield slice(at, stop)
        at = stop


class Lattice:
    """All segmentations of a batch of words, as arcs: a piece from one place of a word to another.

    Place 0 of a word is its begin. Places of all words are numbered through.
    """

    def __init__(self, words: list[bytes], pieces: Pieces) -> None:
        self.lengths = np.array([len(w) for w in words])
        self.n, self.width = len(words), int(self.lengths.max())
        self.logs = self.width > LINEAR_BYTES
        chars = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(self.n), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        at = np.arange(len(chars))  # where each open piece began
        left = (first + self.lengths)[word] - at
        node = np.zeros(len(chars), dtype=np.int64)
        begins, ends, found = [], [], []
        n = 0
        while len(at):
            node = pieces.step(node, chars[at + n])
            n += 1
            alive = node >= 0
            at, node, left = at[alive], node[alive], left[alive]
            piece = pieces.piece[node]
            hit = np.flatnonzero(piece >= 0)
            begins.append(at[hit])
            ends.append(at[hit] + n)
            found.append(piece[hit])
            more = left > n
            at, node, left = at[more], node[more], left[more]
        begin, end, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(found)
        word = word[begin]
        self.size = len(chars) + self.n  # a word has one more place than bytes
        self.begin, self.end, self.piece = begin + word, end + word, piece
        self.bytes = end - begin
        self.first = first + np.arange(self.n)
        self.last = self.first + self.lengths
        self.up = self._steps(end - first[word], self.end)
        self.down = self._steps(-(begin - first[word]), self.begin)

    @staticmethod
    def _steps(place: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arcs by the place in their word that they lead to, those of one target side by side.

        The arcs in that order; where each target's begin, and their end; the targets;
        and where each place's targets begin, and their end.
        """
        order = np.lexsort((target, place))
        place, target = place[order], target[order]
        starts = np.flatnonzero(np.diff(target, prepend=-1))  # a target has one place only
        places = np.flatnonzero(np.diff(place[starts], prepend=place[:1] - 1))
        return order, np.append(starts, len(order)), target[starts], np.append(places, len(starts))

    def _carried(self, values: np.ndarray, steps, come_from: np.ndarray, p: np.ndarray) -> np.ndarray:
        """``values`` by place, with all arcs followed in the order of ``steps``, that is each target once."""
        order, starts, targets, places = steps
        bounds, goals, piece, places = starts.tolist(), targets.tolist(), self.piece[order], places.tolist()
        come_from, scale, log_p = come_from[order], SCALE ** self.bytes[order] if not self.logs else None, np.log(p) if self.logs else None
        for block in range(0, len(places) - 1, BLOCK):
            block_places = places[block : block + BLOCK + 1]
            base, end = bounds[block_places[0]], bounds[block_places[-1]]
            weights = log_p[piece[base:end]] if self.logs else p[piece[base:end]] * scale[base:end, None]
            for at, stop in itertools.pairwise(block_places):
                first, last = bounds[at], bounds[stop]
                came, weight = values[come_from[first:last]], weights[first - base : last - base]
                if not self.logs:
                    values[targets[at:stop]] = np.add.reduceat(came * weight, starts[at:stop] - first, axis=0)
                elif stop - at > 1:
                    values[targets[at:stop]] = np.logaddexp.reduceat(came + weight, starts[at:stop] - first, axis=0)
                else:  # one place of one word
                    values[goals[at]] = np.logaddexp.reduce(came + weight, axis=0)
        return values

    def forward(self, p: np.ndarray) -> np.ndarray:
        """By place and language, all ways to get there: scaled by SCALE for each byte, or as logarithms."""
        alpha = np.full((self.size, p.shape[1]), -np.inf if self.logs else 0.0)
        alpha[self.first] = 0.0 if self.logs else 1.0
        return self._carried(alpha, self.up, self.begin, p)

    def log_probabilities(self, p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability in each language."""
        totals = self.forward(p)[self.last]
        return totals if self.logs else np.log(totals) - (self.lengths * np.log(SCALE))[:, None]

    def expected(self, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, for words that occur ``weights`` times."""
        alpha = self.forward(p)
        beta = np.full_like(alpha, -np.inf if self.logs else 0.0)
        with np.errstate(divide="ignore"):
            beta[self.last] = np.log(weights) - alpha[self.last] if self.logs else weights / alpha[self.last]
        beta = self._carried(beta, self.down, self.end, p)
        if self.logs:
            flow = np.exp(alpha[self.begin] + beta[self.end] + np.log(p[self.piece]))
        else:
            flow = alpha[self.begin] * beta[self.end] * p[self.piece] * (SCALE**self.bytes)[:, None]
        return np.stack([np.bincount(self.piece, weights=flow[:, k], minlength=len(p)) for k in range(p.shape[1])], axis=1)


@dataclass
class LanguageModel:
    """Piece probabilities by language."""

    languages: list[str]
    p: np.ndarray
    vocabulary: str = VOCABULARY
    known: dict[bytes, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)
    long: bool = False  #: whether words that are too long to be kept are among them

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "scores": None}

    def learn(self, words: list[bytes]) -> None:
        """Keep the scores of words not met before."""
        words.sort(key=len)
        pieces = vocabulary(self.vocabulary)
        made = [Lattice(words[part], pieces).log_probabilities(self.p) for part in batches_of(words)]
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.scores = np.concatenate([*([] if self.scores is None else [self.scores]), *made])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how probable it is among the languages."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        if len(self.known) > MOST_WORDS or self.long:
            self.known, self.scores, self.long = {}, None, False
        words = [words_of(x) if has_letter(x) else [] for x in texts]
        new = set().union(*words).difference(self.known)
        self.long = any(len(w) > KEPT_BYTES for w in new)
        if new:
            self.learn(list(new))
        counts = np.array([len(w) for w in words])
        sums = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            which = np.fromiter((i for w in words for i in map(self.known.__getitem__, w)), dtype=np.int64, count=int(counts.sum()))
            starts = (np.cumsum(counts) - counts)[some]
            sums[some] = np.add.reduceat(self.scores[which], starts, axis=0)
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if n else "und" for b, n in zip(best, counts, strict=True)], np.where(counts > 0, share, 0.0)


def sampled(labelled: DataFrame, sample_docs: int) -> tuple[DataFrame, list[str]]:
    """About ``sample_docs`` rows of each language at most, by hash of the id, and the languages."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()  # a row a language
    whole = 1 << 20
    shares = {r["lang"]: min(1.0, sample_docs / r["n"]) for r in sizes}
    if not shares:
        return labelled, []
    cells = [x for lang, share in shares.items() for x in (F.lit(lang), F.lit(int(share * whole)))]
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < F.element_at(F.create_map(*cells), F.col("lang"))
    return labelled.where(chosen), list(shares)


def count_words(labelled: DataFrame) -> DataFrame:
    """lang, word and how often, over the rows given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                counts.update((lang, w) for w in words_of(text))
            yield pa.record_batch(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    return labelled.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample_docs: int = 3000, rounds: int = 3, smoothing: float = 2000.0, name: str = VOCABULARY) -> LanguageModel:
    """Learn piece probabilities from doc_id, text and lang of ``labelled``; rows without lang are left out.

    Each round adds up, over all tasks, how often each piece is expected in each
    language; ``smoothing`` uses are shared out as the languages' mean has them.
    """
    sample, languages = sampled(labelled.where("lang is not null"), sample_docs)
    size = len(vocabulary(name))
    p = np.repeat(vocabulary(name).prior()[:, None], len(languages), axis=1)
    if not languages:
        return LanguageModel([], p, name)
    table = cut(count_words(sample), "words")
    for _ in range(rounds):
        shared = table.spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, now = vocabulary(name), shared.value
            counts = np.zeros(now.shape)
            for batch in batches:
                words = batch.column(1).to_pylist()
                at = np.array([languages.index(x) for x in batch.column(0).to_pylist()])
                weights = np.zeros((len(words), len(languages)))
                weights[np.arange(len(words)), at] = batch.column(2).to_numpy()
                order = np.argsort([len(w) for w in words], kind="stable")
                words, weights = [words[k] for k in order], weights[order]
                for part in batches_of(words):
                    counts += Lattice(words[part], pieces).expected(now, weights[part])
            piece, language = np.nonzero(counts)
            yield pa.record_batch([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(counts[piece, language])], names=["piece", "language", "n"])

        rows = table.df.mapInArrow(run, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((size, len(languages)))  # a number for each piece and language
        counts[rows["piece"], rows["language"]] = rows["n"]
        mean = (counts / np.maximum(counts.sum(axis=0), 1)).mean(axis=1) * 0.9 + vocabulary(name).prior() * 0.1
        mean /= mean.sum()
        p = counts + smoothing * mean[:, None]
        p /= p.sum(axis=0)
    table.drop()
    return LanguageModel(languages, p, name)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for at in range(0, len(texts), 500):
                langs, scores = shared.value.predict(texts[at : at + 500])
                yield pa.record_batch([batch.column(0)[at : at + 500], pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
