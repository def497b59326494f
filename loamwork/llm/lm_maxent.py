"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

A token is a lower-cased word or the end of a text. The ``MOST_FREQUENT`` most
frequent tokens of the training texts that occur ``LEAST_COUNT`` times have
numbers of their own; all other words, known or not, share ``RARE_BUCKETS`` numbers
by hash. The numbered ones are put into classes by what stands next to them: their
counts beside the ``NEIGHBOURS`` most frequent tokens, grouped by k-means; the rare
words are the last class. A token's probability is

    P(class | context) * P(word | class, context)

Every class is told apart whole: a softmax over ``SLOTS`` slots, in which frequent
words stand alone and the others in groups of up to ``SLOTS`` words, and a softmax
within the group. So each number's probability depends on the context at all
levels. Only within one bucket of rare words does it follow the words' counts, with
half a count for each of them and for the unknown word.

Softmaxes are over sums of weight rows, one row for each context feature, found by
hash: the tokens one, two and three before (skips) and the last two together (an
n-gram). The tables of rows grow with the training tokens, a row for every
``TOKENS_A_ROW``, up to ``MOST_ROWS``, which bounds what a task holds.

Training is by distributed gradient updates. In each round every task takes the
model by broadcast, makes AdaGrad steps in minibatches over its share of training
texts (every ``ROUNDS``-th token, another set each round, so that all rounds
together visit every token once) and returns what it changed; changes to a row are
averaged by the number of tokens behind them. A round has ``TASKS_A_CORE`` tasks a
core, so what they return does not grow with the number of files. The counts of all
words stay a distributed table that grows with the corpus; rare words meet it in a
join on their hash.

Defined cases: a null or empty text is the end token alone; rows that repeat a
doc_id are learned from and scored each for itself, so the result has as many
rows; without training texts all counts are 0 and any token is the unknown one;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, cut
from .wordhash import Chunk, chunks

MOST_FREQUENT = 30_000
#: A token that occurs less often in the training texts is rare however few there are.
LEAST_COUNT = 4
NEIGHBOURS = 64
CLASSES = 64
#: Slots of a class and places of a group.
SLOTS = 32
#: Numbers of a class, at most.
CLASS_WORDS = SLOTS * SLOTS
RARE_BUCKETS = 1 << 10
#: Rows of a weight table; row numbers are of 16 bits.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 1280, 1 << 14, 1 << 16
CONTEXT = 3
ROUNDS = 3
MINIBATCH = 16384
RATE = 0.15
TASKS_A_CORE = 2
#: Their number follows from the data, not from the cores: the root of the training tokens over this, and for small
#: corpora the fourth root over a 64th of it. More tokens make more trainers, and more for each to learn from.
TRAINER_TOKENS = 1 << 20
#: Sums of weights beyond it count as so much, and the share that stands for none.
MOST_SUM, NEVER = np.float32(80), 1e-38
#: Tokens, or rows of a table, whose sums are made at a time: few enough to stay in a processor's cache.
AT_ONCE = 2048
#: Rows of a table that travel as one record.
BLOCK_ROWS = 128
#: Counts that a task gathers before it hands them on.
MOST_HELD = 1 << 21

#: What stands for the end of a text among word hashes (fixed value).
END_HASH = np.uint64(0x454E44)
_TOKENS = "doc_id {kind}, training boolean, n_tokens long, tokens binary, rare array<long>, rare_n array<int>"


def token_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, texts one after the other with their ends, and where each text ends."""
    words = chunk.hashes()
    ends = chunk.bounds[1:] + np.arange(1, chunk.n_texts + 1)
    out = np.full(len(words) + chunk.n_texts, END_HASH, dtype=np.uint64)
    keep = np.ones(len(out), dtype=bool)
    keep[ends - 1] = False
    out[keep] = words
    return out, ends


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by hash, added up."""
    hashes, where = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    sums = np.zeros(len(hashes), dtype=np.int64)
    np.add.at(sums, where, np.concatenate([n for _, n in parts]))
    return hashes, sums


def count_tokens(docs: DataFrame) -> DataFrame:
    """hash and n of every token of the training texts; ``docs`` has text and training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                held.append(np.unique(token_hashes(chunk)[0], return_counts=True))
                if sum(len(h) for h, _ in held) > MOST_HELD:
                    held = [merged(held)]
                    if len(held[0][0]) > MOST_HELD // 2:
                        yield pa.record_batch([pa.array(held[0][0].astype(np.int64)), pa.array(held[0][1])], names=["hash", "n"])
                        held = []
        if held:
            hashes, n = merged(held)
            yield pa.record_batch([pa.array(hashes.astype(np.int64)), pa.array(n)], names=["hash", "n"])

    return docs.where("training").select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARE_BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Vocabulary:
    """The numbered tokens by frequency; ``end`` is the number of the end token, whether counted or not."""

    hash: np.ndarray  #: sorted
    number: np.ndarray  #: of each hash
    count: np.ndarray  #: by number
    tokens: int  #: N
    distinct: int  #: V
    end: int
    rare_mass: np.ndarray  #: by bucket: counts of rare words with half a count for each and for the unknown one

    @property
    def size(self) -> int:
        return len(self.count)

    @property
    def filler(self) -> int:
        """The number of what stands before a text."""
        return self.size + RARE_BUCKETS

    @property
    def base_mass(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each token; a rare one's is ``size`` and its bucket."""
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.number[at], self.size + bucket_of(hashes))


def vocabulary(counts: DataFrame, most: int = MOST_FREQUENT) -> Vocabulary:
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    table = cut(counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.col("n").desc(), "hash").limit(most), "frequent")
    top = sorted(table.df.collect(), key=lambda r: (-r["n"], r["hash"]))  # ``most`` rows
    table.drop()
    hashes = [r["hash"] for r in top]
    count = [r["n"] for r in top]
    end = int(END_HASH)
    if end not in hashes:  # where there is little or nothing to learn from
        kept = counts.where(F.col("hash") == end).first()
        hashes.append(end)
        count.append(kept["n"] if kept else 0)
    hash_ = np.array(hashes, dtype=np.int64).astype(np.uint64)
    order = np.argsort(hash_)
    count = np.array(count, dtype=np.int64)
    bucket = F.shiftrightunsigned("hash", 64 - RARE_BUCKETS.bit_length() + 1)
    mass = np.full(RARE_BUCKETS, 0.5)
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():  # a row a bucket
        mass[r["bucket"]] += r["mass"]
    np.subtract.at(mass, bucket_of(hash_[count > 0]), count[count > 0] + 0.5)
    return Vocabulary(hash_[order], order, count, tokens, distinct, hashes.index(end), mass)


def tokenised(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Each text's token numbers as u16 bytes, and the hashes of its rare words with how often they occur in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(1), lower=True):
                hashes, ends = token_hashes(chunk)
                numbers = known.numbers(hashes)
                sizes = np.diff(ends, prepend=0)
                rare = np.flatnonzero(numbers >= known.size)
                text = np.repeat(np.arange(chunk.n_texts), sizes)[rare]
                order = np.lexsort((hashes[rare], text))
                h, text = hashes[rare][order], text[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else [])
                lists = np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=chunk.n_texts))]).astype(np.int32)
                raw = numbers.astype("<u2").tobytes()
                rows = slice(chunk.first, chunk.first + chunk.n_texts)
                yield pa.record_batch(
                    [
                        batch.column(0)[rows],
                        batch.column(2)[rows],
                        pa.array(sizes),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(h[first].astype(np.int64))),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(np.diff(first, append=len(h)).astype(np.int32))),
                    ],
                    names=["doc_id", "training", "n_tokens", "tokens", "rare", "rare_n"],
                )

    return docs.select("doc_id", "text", "training").mapInArrow(run, _TOKENS.format(kind=kind))


def set_apart(texts: list[bytes], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of some texts, set apart by CONTEXT fillers, and their sizes."""
    gap = np.full(CONTEXT, filler, dtype=np.int64)
    return np.concatenate([x for raw in texts for x in (gap, np.frombuffer(raw, dtype="<u2").astype(np.int64))]), np.array([len(raw) // 2 for raw in texts])


def token_batches(column: pa.Array, filler: int, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, token numbers of some texts, and their sizes."""
    held: list[bytes] = []
    first, n = 0, 0
    for row, raw in enumerate(column.to_pylist()):
        held.append(raw)
        n += len(raw) // 2
        if n >= most:
            yield first, *set_apart(held, filler)
            held, first, n = [], row + 1, 0
    if held:
        yield first, *set_apart(held, filler)


def trainer_batches(batches: Iterator[pa.RecordBatch], filler: int, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Trainer, token numbers of some of its texts, and their sizes; the same however rows came in batches."""
    held: list[bytes] = []
    trainer, n = None, 0
    for batch in batches:
        for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (own != trainer or n >= most):
                yield trainer, *set_apart(held, filler)
                held, n = [], 0
            trainer = own
            held.append(raw)
            n += len(raw) // 2
    if held:
        yield trainer, *set_apart(held, filler)


def places(sizes: np.ndarray) -> np.ndarray:
    """Where the tokens proper stand among the fillers of ``token_batches``."""
    return np.arange(sizes.sum()) + np.repeat(np.arange(1, len(sizes) + 1) * CONTEXT, sizes)


def visited(sizes: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The places whose tokens a round learns from; each is in one of the rounds."""
    return places(sizes)[turn::rounds]


def blocks_of(table: int, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    for b in range(0, len(rows), BLOCK_ROWS):
        part = rows[b : b + BLOCK_ROWS]
        if part.any():
            yield table, b, part.tobytes()


def summed(parts: DataFrame, widths: list[int], dtype: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tables added up over all tasks, as table, first row and rows. Blocks of one number meet in one task, which holds no more than its sums."""

    total = "f8" if dtype == "f4" else dtype  # so that the order in which parts come does not show

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for table, row, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(raw, dtype=dtype).astype(total)
                if (table, row) in held:
                    held[table, row] += values
                else:
                    held[table, row] = values
        if held:
            yield _records((t, r, x.tobytes()) for (t, r), x in held.items())

    n = parts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sums = cut(parts.repartition(int(n), "table", "row").mapInArrow(run, _BLOCKS), "sums")
    for r in sums.df.toLocalIterator():  # the tables have a fixed size, and come a part at a time
        yield r["table"], r["row"], np.frombuffer(bytes(r["part"]), dtype=total).reshape(-1, widths[r["table"]])
    sums.drop()


_BLOCKS = "table int, row int, part binary"


def _records(rows) -> pa.RecordBatch:
    table, row, part = zip(*rows, strict=True)
    return pa.record_batch([pa.array(table, pa.int32()), pa.array(row, pa.int32()), pa.array(part, pa.binary())], names=["table", "row", "part"])


def in_few_tasks(tokens: DataFrame) -> DataFrame:
    """Training tokens in TASKS_A_CORE partitions a core, or as many as there are."""
    few = TASKS_A_CORE * tokens.sparkSession.sparkContext.defaultParallelism
    return tokens.where("training").select("tokens").coalesce(few)


def neighbour_counts(tokens: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each numbered token stands right after and right before each of the NEIGHBOURS most frequent."""
    size, filler = words.size, words.filler

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((size, 2 * NEIGHBOURS), dtype=np.int32)
        flat = counts.reshape(-1)
        for batch in batches:
            for _, t, _ in token_batches(batch.column(0), filler):
                for side, (token, beside) in enumerate(((t[1:], t[:-1]), (t[:-1], t[1:]))):
                    some = (beside < NEIGHBOURS) & (token < size)
                    np.add.at(flat, token[some] * (2 * NEIGHBOURS) + side * NEIGHBOURS + beside[some], 1)
        rows = list(blocks_of(0, counts))
        if rows:
            yield _records(rows)

    out = np.zeros((size, 2 * NEIGHBOURS), dtype=np.int32)
    for _, row, values in summed(in_few_tasks(tokens).mapInArrow(run, _BLOCKS), [2 * NEIGHBOURS], "i4"):
        out[row : row + len(values)] = values
    return out


def classes_of(counts: np.ndarray, words: Vocabulary, classes: int = CLASSES) -> np.ndarray:
    """The class of each numbered token. Class 0 is the end, the last the rare words, which get no token here."""
    mean = counts.sum(axis=0) / max(counts.sum(), 1)
    x = counts + 5.0 * mean
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1e-12))
    k = min(classes - 2, len(x))
    centres = x[:k].copy()
    weight = np.sqrt(words.count + 1.0)
    near = np.zeros(len(x), dtype=np.int64)
    for _ in range(12):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x * weight[:, None])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    # what is too much for a class, its least frequent words, goes to the class with most room
    size = np.bincount(near, minlength=classes - 2)
    for c in np.flatnonzero(size > CLASS_WORDS):
        for i in np.flatnonzero(near == c)[CLASS_WORDS:]:
            near[i] = size.argmin()
            size[near[i]] += 1
    out = near + 1
    out[words.end] = 0
    return out


@dataclass
class MaxentModel:
    """Where each number stands in the tree of class, slot and group, and for each level biases and weight rows."""

    words: Vocabulary
    klass: np.ndarray  #: of each number, those of rare buckets last
    slot: np.ndarray
    group: np.ndarray  #: class and slot in one, -1 for a word that has its slot alone
    place: np.ndarray
    rest: np.ndarray  #: log of what a bucket's counts are divided by
    biases: list[np.ndarray]  #: log shares of classes, of slots by class, of places by group
    tables: list[np.ndarray]

    @classmethod
    def start(cls, words: Vocabulary, klass: np.ndarray, classes: int = CLASSES) -> MaxentModel:
        """Before training: all follows from counts."""
        klass = np.concatenate([klass, np.full(RARE_BUCKETS, classes - 1)])
        mass = np.concatenate([words.count + 0.5 * (words.count == 0), words.rare_mass])
        slot, place = np.zeros(len(klass), dtype=np.int64), np.zeros(len(klass), dtype=np.int64)
        alone = np.ones(len(klass), dtype=bool)
        for c in range(classes):
            own = np.flatnonzero(klass == c)
            own = own[np.argsort(-mass[own], kind="stable")]
            groups = max(0, -(-(len(own) - SLOTS) // (SLOTS - 1)))
            single = min(len(own), SLOTS - groups)
            rest = np.arange(len(own) - single)
            slot[own] = np.concatenate([np.arange(single), single + rest // SLOTS])
            place[own[single:]], alone[own[single:]] = rest % SLOTS, False
        cell = klass * SLOTS + slot
        by_cell = np.bincount(cell, weights=mass, minlength=classes * SLOTS)
        by_place = np.bincount(cell * SLOTS + place, weights=mass, minlength=classes * SLOTS * SLOTS)
        shares = [x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30) for x in (np.bincount(klass, weights=mass, minlength=classes)[None], by_cell.reshape(classes, SLOTS), by_place.reshape(-1, SLOTS))]
        rows = 1 << int(np.log2(min(max(words.tokens // TOKENS_A_ROW, LEAST_ROWS), MOST_ROWS)))
        return cls(
            words, klass, slot, np.where(alone, -1, cell), place, np.concatenate([np.zeros(words.size), -np.log(words.rare_mass)]),
            [np.log(np.where(x > 0, x, NEVER)).astype(np.float32) for x in shares], [np.zeros((rows, x.shape[1]), dtype=np.float32) for x in shares],
        )

    def features(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the context features of the tokens standing ``at``: one, two, three before, and the last two."""
        one, two, three = (tokens[at - k].astype(np.uint64) for k in (1, 2, 3))
        pair = (one * np.uint64(65_599) + two + np.uint64(1)) * _SALT[1]
        return np.stack([(one + np.uint64(1)) * _SALT[0], (two + np.uint64(1)) * _SALT[1] ^ _SALT[2], (three + np.uint64(1)) * _SALT[2] ^ _SALT[0], pair ^ (pair >> np.uint64(31))])

    def levels(self, features: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: its number, which of the tokens have a choice there, what they depend on, their rows by feature, and what is right."""
        klass, group = self.klass[target], self.group[target]
        some = np.flatnonzero(klass > 0)  # the end is a class alone
        grouped = np.flatnonzero(group >= 0)
        yield 0, np.arange(len(target)), np.zeros(len(target), dtype=np.int64), self._rows(features), klass
        yield 1, some, klass[some], self._rows(features.take(some, axis=1) ^ _spread(klass[some] + 1)), self.slot[target[some]]
        yield 2, grouped, group[grouped], self._rows(features.take(grouped, axis=1) ^ _spread(group[grouped] + CLASSES + 1)), self.place[target[grouped]]

    def _rows(self, features: np.ndarray) -> np.ndarray:
        rows = len(self.tables[0])
        return (features * _SALT[0] >> np.uint64(64 - rows.bit_length() + 1)).astype(np.uint16)

    def exponentials(self, level: int, given: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """exp of bias and weight rows added up, kept within MOST_SUM, and its total for each token.

        ``AT_ONCE`` tokens come at a time, named by the slice; the next overwrite them.
        """
        table, biases = self.tables[level], self.biases[level]
        n, width = rows.shape[1], table.shape[1]
        at_once = min(n, AT_ONCE)
        sums, row = np.empty((at_once, width), dtype=np.float32), np.empty((at_once, width), dtype=np.float32)
        most, least, ones = _bounds(width)
        for a in range(0, n, AT_ONCE):
            part = slice(a, min(a + AT_ONCE, n))
            z, r = sums[: part.stop - a], row[: part.stop - a]
            table.take(rows[0, part], axis=0, out=z, mode="clip")  # row numbers are within the table; "raise" would copy
            for of_feature in rows[1:]:
                z += table.take(of_feature[part], axis=0, out=r, mode="clip")
            z += biases.take(given[part], axis=0, out=r, mode="clip") if len(biases) > 1 else biases
            np.minimum(z, most[: len(z)], out=z)
            np.maximum(z, least[: len(z)], out=z)
            np.exp(z, out=z)
            yield part, z, z @ ones

    def log_probabilities(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of each token's probability in its context, but for the count of a rare word."""
        target = tokens[at]
        out = self.rest[target]
        for level, some, given, rows, right in self.levels(self.features(tokens, at), target):
            for part, z, total in self.exponentials(level, given, rows):
                out[some[part]] += np.log(z[np.arange(len(z)), right[part]] / total)
        return out


@functools.cache
def _bounds(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MOST_SUM, its negative (as whole blocks, which numpy compares faster than with one number), and ones."""
    most = np.full((AT_ONCE, width), MOST_SUM, dtype=np.float32)
    return most, -most, np.ones(width, dtype=np.float32)


#: Odd multipliers that spread features over rows (fixed values).
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _spread(given: np.ndarray) -> np.ndarray:
    h = given.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def as_items(table: np.ndarray) -> np.ndarray:
    """Each row as one item, which numpy copies whole."""
    return table.view(f"V{table.itemsize * table.shape[1]}")[:, 0]


def grouped_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, singly: int = 16) -> np.ndarray:
    """Rows of ``values`` summed by group. Group i is so many rows from ``starts[i]`` in ``order``; those of over ``singly`` rows come first, then the largest.

    The k-th rows are added for all groups at once. A group of more than ``singly``
    rows is summed in pieces of so many, and their sums by the same way.
    """
    large = int(np.searchsorted(-counts, -singly))
    if large:
        n_pieces = -(-counts[:large] // singly)
        first = np.cumsum(n_pieces) - n_pieces
        nth = np.arange(n_pieces.sum()) - np.repeat(first, n_pieces)
        begins = np.repeat(starts[:large], n_pieces) + nth * singly
        sizes = np.minimum(np.repeat(counts[:large], n_pieces) - nth * singly, singly)
        full_first = np.argsort(sizes < singly, kind="stable")  # all but the last of a group are full
        short = full_first[np.searchsorted(sizes[full_first] < singly, True) :]
        full_first[len(full_first) - len(short) :] = short[np.argsort(-sizes[short], kind="stable")]
        place = np.empty_like(full_first)
        place[full_first] = np.arange(len(full_first))
        pieces = grouped_sums(values, order, begins[full_first], sizes[full_first], singly)
        by_count = np.argsort(-n_pieces, kind="stable")
    out = np.empty((len(starts), values.shape[1]), dtype=values.dtype)
    if large:
        out[by_count] = grouped_sums(pieces, place, first[by_count], n_pieces[by_count], singly)
    rest, starts, counts = out[large:], starts[large:], counts[large:]
    if not len(rest):
        return out
    values.take(order[starts], axis=0, out=rest, mode="clip")
    row = np.empty_like(rest)
    for k in range(1, singly):
        more = int(np.searchsorted(-counts, -k))  # groups of over k rows
        if not more:
            break
        rest[:more] += values.take(order[starts[:more] + k], axis=0, out=row[:more], mode="clip")
    return out


class Trainer:
    """AdaGrad over one trainer's share of the training texts."""

    def __init__(self, model: MaxentModel, rate: float) -> None:
        self.before, self.rate = model.tables, rate
        self.model = replace(model, tables=[t.copy() for t in model.tables])
        self.squares = [np.full(len(t), 1e-2, dtype=np.float32) for t in model.tables]
        self.seen = [np.zeros((len(t), 1), dtype=np.float32) for t in model.tables]
        self.gradients = [np.empty((MINIBATCH, t.shape[1]), dtype=np.float32) for t in model.tables]

    def _step(self, level: int, given: np.ndarray, rows: np.ndarray, right: np.ndarray) -> None:
        n = len(right)
        gradient = self.gradients[level][:n]
        for part, z, total in self.model.exponentials(level, given, rows):
            np.multiply(z, (1 / total)[:, None], out=gradient[part])
        gradient.reshape(-1)[np.arange(n) * gradient.shape[1] + right] -= 1
        flat = rows.reshape(-1)
        order = np.argsort(flat, kind="stable")  # a radix sort, as rows have 16 bits
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        counts = np.diff(starts, append=len(flat))
        by_count = np.argsort(255 - np.minimum(counts, 255).astype(np.uint8), kind="stable")  # a radix sort too
        order %= n
        table, squares, seen = self.model.tables[level], self.squares[level], self.seen[level]
        for a in range(0, len(starts), AT_ONCE):
            some = by_count[a : a + AT_ONCE]
            touched = flat[starts[some]]
            sums = grouped_sums(gradient, order, starts[some], counts[some])
            new = squares[touched] + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
            squares[touched] = new
            seen[touched, 0] += counts[some]
            sums *= (-self.rate / np.sqrt(new))[:, None]
            sums += table.take(touched, axis=0)
            as_items(table)[touched] = as_items(sums)

    def train(self, tokens: np.ndarray, at: np.ndarray) -> None:
        for a in range(0, len(at), MINIBATCH):
            part = at[a : a + MINIBATCH]
            for level, some, given, rows, right in self.model.levels(self.model.features(tokens, part), tokens[part]):
                if len(some):
                    self._step(level, given, rows, right)

    def changes(self) -> Iterator[tuple[int, int, bytes]]:
        for level, table in enumerate(self.model.tables):
            seen = self.seen[level]
            yield from blocks_of(level, np.concatenate([(table - self.before[level]) * seen, seen], axis=1))


def for_trainers(tokens: DataFrame, n_tokens: int) -> DataFrame:
    """trainer and tokens of the training texts, in an order that only the texts and their ids decide."""
    trainers = max(1, math.isqrt(n_tokens // TRAINER_TOKENS), math.isqrt(math.isqrt(64 * n_tokens // TRAINER_TOKENS)))
    place = F.xxhash64("doc_id")
    dealt = tokens.where("training").select(F.pmod(F.xxhash64(place), F.lit(trainers)).alias("trainer"), place.alias("place"), "doc_id", "tokens")
    return dealt.repartition("trainer").sortWithinPartitions("trainer", "place", "doc_id", "tokens").select("trainer", "tokens")


def train(tokens: DataFrame, model: MaxentModel, rounds: int = ROUNDS, rate: float = RATE) -> MaxentModel:
    """Gradient rounds over all training texts of ``tokens``. The tables of ``model`` are changed.

    A trainer is not a task: a task may have several, one after the other, so neither
    cores nor partitions change what is learned.
    """
    for turn in range(rounds):
        shared = tokens.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            now, trainer = None, None
            for own, t, sizes in trainer_batches(batches, shared.value.words.filler):
                if own != now:
                    if trainer and (rows := list(trainer.changes())):
                        yield _records(rows)
                    now, trainer = own, Trainer(shared.value, rate / (1 + turn))
                trainer.train(t, visited(sizes, turn, rounds))
            if trainer and (rows := list(trainer.changes())):
                yield _records(rows)

        for level, row, values in summed(for_trainers(tokens, model.words.tokens).mapInArrow(run, _BLOCKS), [t.shape[1] + 1 for t in model.tables], "f4"):
            model.tables[level][row : row + len(values)] += values[:, :-1] / np.maximum(values[:, -1:], 1)
        shared.destroy()
    return model


def scored(tokens: DataFrame, model: MaxentModel) -> DataFrame:
    """doc_id, held_out, n_tokens, how many numbered tokens are known, base and model log10 but for the counts of rare words."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        mass = math.log10(m.words.base_mass)
        base = np.concatenate([np.log10(m.words.count + 0.5) - mass, np.full(RARE_BUCKETS, -mass)])
        known = np.concatenate([m.words.count > 0, np.zeros(RARE_BUCKETS, dtype=bool)]).astype(np.int64)
        for batch in batches:
            for first, t, sizes in token_batches(batch.column(3), m.words.filler):
                at = places(sizes)
                log = np.concatenate([m.log_probabilities(t, at[a : a + 8192]) for a in range(0, len(at), 8192)])
                starts = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x, starts) for x in (known[t[at]], base[t[at]], log / math.log(10))]
                rows = slice(first, first + len(sizes))
                yield pa.record_batch(
                    [*(batch.column(x)[rows] for x in range(3)), pa.array(sizes), *map(pa.array, sums)],
                    names=["key", "doc_id", "held_out", "n_tokens", "known", "base", "model"],
                )

    columns = tokens.select("key", "doc_id", (~F.col("training")).alias("held_out"), "tokens")
    return columns.mapInArrow(run, f"key long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double")


def rare_sums(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """For each text with rare words: how many of them are known, and the log10 of their counts."""
    each = tokens.select("key", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("key", F.col("r.rare").alias("h"), F.col("r.rare_n").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0)) + 0.5
    return (
        each.join(counts, F.col("h") == F.col("hash"), "left")
        .groupBy("key")
        .agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(count)).alias("rare_log"))
        .withColumnRenamed("key", "rare_key")
    )


def learn(docs: DataFrame, **options) -> tuple[MaxentModel, Cut, Cut]:
    """The model trained on the rows of ``docs`` (doc_id, text, training), its tokens and its counts as tables."""
    counts = cut(count_tokens(docs), "counts")
    words = vocabulary(counts.df)
    tokens = cut(tokenised(docs, words).withColumn("key", F.monotonically_increasing_id()), "tokens")
    klass = classes_of(neighbour_counts(tokens.df, words), words)
    return train(tokens.df, MaxentModel.start(words, klass), **options), tokens, counts


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learn from the rows where the column ``training`` holds, and score all rows.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), training.alias("training"))
    model, tokens, counts = learn(docs, **options)
    rare = rare_sums(tokens.df, counts.df)
    found = scored(tokens.df, model)
    log = F.coalesce("rare_log", F.lit(0.0))
    return found.join(rare, F.col("key") == F.col("rare_key"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("model") + log).alias("score"),
    )
