"""Phrases that keep together, by PCY/DHP hashing: counts of buckets and Apriori pruning before exact counts.

The text is passed once for each length of phrase. While a pass counts the phrases
of its length exactly, it counts the phrases of the next length by hash buckets; a
phrase can be frequent only if its bucket is. Buckets that reach the least count are
a bitmap of fixed size, and so are the buckets of phrases known to be frequent, both
broadcast to the next pass. That counts a phrase only if its bucket is set and both
phrases one word shorter within it are set (Apriori). Bitmaps only leave out phrases
that can't be frequent: what passes is counted by its words themselves, so neither
collisions nor full bitmaps change a count.

Words of a batch are numbered by an Arrow dictionary, and phrases by pairs of such
numbers, so counts within a batch are exact too.

Defined cases: null text is empty, null lang is ``und``; other columns and ids are
not read and rows that repeat count each time; a lang without candidates has no rows,
nor has an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, cut
from .wordhash import mix, string_buffers

#: Buckets of a bitmap: a power of two, 2 MB as bits.
BUCKETS = 1 << 24
#: Bytes of text that are counted at once; a longer text is one part.
PART_BYTES = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: What ends a piece, and what else ends a word.
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[0x20, 0x09]] = True

COUNTS = "lang string, phrase string, bucket long, n long"
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])


class Words:
    """The words of some texts: number and piece of each, and the distinct ones."""

    def __init__(self, column: pa.Array) -> None:
        offsets, data = string_buffers(column)
        first = int(offsets[0])
        data = _LOWER[data[first : int(offsets[-1])]]
        offsets = offsets - first
        gap = _ENDS_WORD[data]
        begins = ~gap
        begins[1:] &= gap[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        begins[inner] |= ~gap[inner]
        starts = np.flatnonzero(begins)
        # a piece is told by the marks and the ends of texts before it
        marks = np.flatnonzero(_ENDS_PIECE[data])
        self.piece = np.searchsorted(marks, starts) + np.searchsorted(offsets, starts, side="right")
        kept = ~gap
        places = np.cumsum(kept, dtype=np.int64)
        bounds = np.append(places[starts] - 1, places[-1] if len(places) else 0).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[kept].tobytes()))
        coded = words.dictionary_encode()
        self.code, self.distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def hashes(self) -> np.ndarray:
        """Of the distinct words."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.to_pylist()), dtype=np.uint64, count=len(self.distinct))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b * np.uint64(0x9E3779B97F4A7C15))


def _spread(h: np.ndarray, lang: str, length: int, buckets: int) -> np.ndarray:
    """The bucket of each phrase of a lang, from the hash of its words."""
    return (mix(h ^ np.uint64(xxhash.xxh3_64_intdigest(f"{length} {lang}"))) & np.uint64(buckets - 1)).astype(np.int64)


def _is_set(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 6] >> (bucket & 63).astype(np.uint64)) & np.uint64(1) == 1


def _part(words: Words, lang: str, length: int, frequent: np.ndarray | None, own: np.ndarray | None, buckets: int, next_too: bool) -> Iterator[pa.Table]:
    """Exact counts of phrases of ``length`` that may be frequent, and bucket counts of phrases one word longer.

    frequent: buckets of frequent phrases one word shorter; own: buckets that reached
    the least count. Single words, which have neither, are all counted.
    """
    one = words.hashes()[words.code]
    at = np.arange(len(one))
    within = lambda at, size: words.piece[at] == words.piece[at + size - 1]  # noqa: E731  the run stays in its piece
    h = one
    for size in range(2, length):
        h = _joined(h[:-1], one[size - 1 :])
    if length > 1:
        passed = _is_set(frequent, _spread(h, lang, length - 1, buckets))
        at = np.flatnonzero(passed[:-1] & passed[1:])
        at = at[within(at, length)]
        h = _joined(h[at], one[at + length - 1])
        kept = _is_set(own, _spread(h, lang, length, buckets))
        at, h = at[kept], h[kept]
    number = words.code[at]
    for i in range(1, length):
        _, number = np.unique(number * len(words.distinct) + words.code[at + i], return_inverse=True)
    _, first, n = np.unique(number, return_index=True, return_counts=True)
    columns = [words.distinct.take(pa.array(words.code[at[first] + i])) for i in range(length)]
    phrases = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string())
    yield pa.table([pa.array([lang] * len(n), pa.string()), phrases, pa.nulls(len(n), pa.int64()), pa.array(n)], schema=_SCHEMA)
    if length == 1:
        yield pa.table([[lang], [""], pa.nulls(1, pa.int64()), [len(one)]], schema=_SCHEMA)  # no word is empty
    if next_too:
        passed = np.zeros(len(one) + 1, dtype=bool)
        passed[at] = True
        go = passed[at + 1] & (at + length < len(one))
        at, h = at[go], h[go]
        go = within(at, length + 1)
        at, h = at[go], h[go]
        bucket, n = np.unique(_spread(_joined(h, one[at + length]), lang, length + 1, buckets), return_counts=True)
        yield pa.table([pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.string()), pa.array(bucket), pa.array(n)], schema=_SCHEMA)


def _parts(batch: pa.RecordBatch, part_bytes: int) -> Iterator[tuple[str, pa.Array]]:
    """The texts of each lang, about ``part_bytes`` at a time."""
    langs = batch.column("lang")
    for lang in pc.unique(langs).to_pylist():
        texts = batch.column("text").filter(pc.equal(langs, lang)).cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // part_bytes
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield lang, texts.slice(a, b - a)


def _gathered(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``part_bytes`` at least, so that what repeats is counted together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= part_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counter(length: int, frequent: Broadcast | None, own: Broadcast | None, buckets: int, part_bytes: int, next_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, part_bytes):
            for lang, texts in _parts(batch, part_bytes):
                words = Words(texts)
                for table in _part(words, lang, length, frequent and frequent.value, own and own.value, buckets, next_too):
                    yield from table.to_batches()

    return run


def _buckets_of(length: int, buckets: int):
    """lang and bucket of frequent phrases, from their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                words = Words(batch.column("phrase").filter(pc.equal(batch.column("lang"), lang)))
                hashed = words.hashes()[words.code].reshape(-1, length)
                h = reduce(_joined, [hashed[:, i] for i in range(length)])
                yield pa.record_batch([pa.array(_spread(h, lang, length, buckets))], ["bucket"])

    return run


def bitmap(set_ones: DataFrame, buckets: int) -> np.ndarray:
    """The numbers in ``bucket`` as set bits. At most a 64th of ``buckets`` rows reach the driver."""
    bit = F.expr("shiftleft(1L, cast(bucket & 63 as int))")
    numbers = set_ones.select(F.shiftright("bucket", 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(max(1, buckets >> 6), dtype=np.uint64)
    found[numbers["at"].to_numpy()] = numbers["bits"].to_numpy().view(np.uint64)
    return found


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, buckets: int = BUCKETS, part_bytes: int = PART_BYTES) -> list[Cut]:
    """lang, phrase, n of phrases met ``least`` times, a table for each length; the first also has each lang's count of words as phrase ''."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tables: list[Cut] = []
    frequent = own = None
    for length in range(1, longest + 1):
        counted = texts.mapInArrow(_counter(length, frequent, own, buckets, part_bytes, length < longest), COUNTS).groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        passed = cut(counted.where((F.col("n") >= least) | (F.col("phrase") == "")), f"phrases-{length}")
        for old in (frequent, own):
            if old:
                old.destroy()
        exact = passed.df.where("phrase is not null").select("lang", "phrase", "n")
        if length < longest:
            known = exact.where("phrase <> ''").select("lang", "phrase").mapInArrow(_buckets_of(length, buckets), "bucket long")
            frequent = spark.sparkContext.broadcast(bitmap(known, buckets))
            own = spark.sparkContext.broadcast(bitmap(passed.df.where("phrase is null").select("bucket"), buckets))
        tables.append(passed)
        passed.df = exact
    return tables


def scored(tables: list[Cut], scale: int = 2_000_000) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of all candidates, by their weakest cut."""
    known = reduce(DataFrame.unionByName, [t.df for t in tables])
    totals = known.where("phrase = ''").groupBy("lang").agg(F.sum("n").alias("total"))
    known = known.where("phrase <> ''")
    words = F.split("phrase", " ")
    phrases = known.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).where(F.size("words") > 1)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", F.size("words").alias("words"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr(f"cast({scale} * cast(a as decimal(20,0)) as decimal(30,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = both.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return weakest.join(totals, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def without_parts(candidates: DataFrame, share: int = 80) -> DataFrame:
    """Candidates but those within a longer one that is met at least ``share`` per cent as often."""
    words = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", "a", words.alias("w"), "words")
    sized = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    parts = sized.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    around = parts.select("lang", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = candidates.join(around, ["lang", "phrase"], "left")
    times = lambda c, n: F.col(c).cast("decimal(20,0)") * F.lit(n)
    return kept.where(F.col("around").isNull() | (times("around", 100) < times("a", share))).drop("around")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2_000, **how: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's best phrases. ``how``: buckets, part_bytes."""
    tables = frequent_phrases(docs, least, longest, **how)
    candidates = cut(scored(tables), "candidates")
    for table in tables:
        table.drop()
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = without_parts(candidates.df, share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
