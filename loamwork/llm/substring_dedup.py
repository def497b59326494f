"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 11 ten-word runs in any window of 20 words the
one with the least hash. Equal windows have equal anchors, so a window that
occurs twice has an anchor that does, and documents are joined on anchors alone,
about one for every six words. Where an anchor is shared, it is extended both
ways: each window that has it as its anchor, reaching up to ten words to either
side, is compared with the windows of the other documents around the same anchor
by a 96-bit hash of all its words. Windows next to each other that repeat make
up the maximal repeats.

Only the first document with a window matters for the others, so no pairs are
made. The first one is a minimum, combined before the shuffle; each document
names an anchor or window once; the joins that bring the minimum back are ones
that Spark's skew join can split. A passage in a third of all documents is thus
linear work spread over all tasks. Texts move only where a document shares an
anchor, and again where it has a window to lose to another; all others stay where
they are read.

Defined cases: a null text has no words; a text shorter than a window keeps all
its words; windows that repeat within their own document go without any join;
rows that repeat a doc_id are one document as far as order goes, so neither
removes words of the other; a row with null doc_id has no place in the order and
loses only what repeats within it; an empty table gives an empty result; other
columns are not carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, joined_by_id
from .wordhash import Chunk, chunks, mix, run_hashes

WINDOW = 20
ANCHOR = 10


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


class Windows:
    """The windows of a chunk: text, start, hash in two parts, and anchor."""

    def __init__(self, chunk: Chunk, window: int, anchor: int) -> None:
        words, of = chunk.hashes(), chunk.text_of_word()
        n = len(words) - window + 1
        inside = np.flatnonzero(of[:n] == of[window - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
        self.text, self.word = of[inside], inside
        self.start = inside - chunk.bounds[self.text]
        if len(inside):
            self.hash = run_hashes(words, window)[inside]
            self.check = run_hashes(chunk.hashes(1), window, 1)[inside]
            self.anchor = sliding_least(run_hashes(words, anchor), window - anchor + 1)[inside]
        else:
            self.hash = self.anchor = np.zeros(0, dtype=np.uint64)
            self.check = np.zeros(0, dtype=np.uint64)

    def repeats_within(self) -> np.ndarray:
        """Whether the same text has the same window earlier."""
        key = mix(self.hash ^ mix(self.text.astype(np.uint64) + np.uint64(1))) ^ self.check
        again = np.ones(len(key), dtype=bool)
        again[np.unique(key, return_index=True)[1]] = False
        return again


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    """Values, in order of their text, as one list for each of n texts."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def anchors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id and the list of its distinct anchors, for documents that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                w = Windows(chunk, window, anchor)
                new = np.ones(len(w.text), dtype=bool)
                new[1:] = (w.anchor[1:] != w.anchor[:-1]) | (w.text[1:] != w.text[:-1])
                text, value = w.text[new], w.anchor[new]
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                new = np.ones(len(text), dtype=bool)
                new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
                lists = _lists(value[new].astype(np.int64), text[new], chunk.n_texts)
                yield pa.record_batch([batch.column(0)[chunk.first : chunk.first + chunk.n_texts], lists], names=["doc_id", "anchors"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, f"doc_id {kind}, anchors array<long>").where(F.size("anchors") > 0)


def shared_seeds(found: DataFrame) -> DataFrame:
    """doc_id and the list of those of its anchors that more than one row has."""
    each = found.select("doc_id", F.explode("anchors").alias("anchor"))
    often = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    return each.join(often, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("seeds"))


def extended(docs: DataFrame, seeds: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """hash, check, doc_id, start of each distinct window around a shared anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(2)
            for chunk in chunks(batch.column(1)):
                w = Windows(chunk, window, anchor)
                rows = seeds[chunk.first : chunk.first + chunk.n_texts]
                seed = rows.flatten().to_numpy().astype(np.uint64)
                of = np.repeat(np.arange(chunk.n_texts), rows.value_lengths().to_numpy())
                wanted = np.isin(_with_text(w.anchor, w.text), _with_text(seed, of))
                at = np.flatnonzero(wanted & ~w.repeats_within())
                ids = batch.column(0)[chunk.first : chunk.first + chunk.n_texts].take(pa.array(w.text[at]))
                yield pa.record_batch(
                    [pa.array(w.hash[at].astype(np.int64)), pa.array(w.check[at].astype(np.int64)), ids, pa.array(w.start[at].astype(np.int32))],
                    names=["hash", "check", "doc_id", "start"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    seeded = joined_by_id(docs.select("doc_id", "text"), seeds.select("doc_id"), "doc_id", "left_semi")
    return seeded.join(seeds, "doc_id").select("doc_id", "text", "seeds").mapInArrow(run, f"hash long, check long, doc_id {kind}, start int")


def _with_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(values ^ mix(text.astype(np.uint64) + np.uint64(1)))


def repeated_starts(found: DataFrame) -> DataFrame:
    """doc_id and the starts of its windows that a document before it has."""
    first = found.groupBy("hash", "check").agg(F.min("doc_id").alias("first"))
    return (
        found.join(first, ["hash", "check"]).where(F.col("doc_id") > F.col("first")).groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    )


def without_repeats(docs: DataFrame, starts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the maximal repeats removed, as pairs of first and last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                rows = slice(chunk.first, chunk.first + chunk.n_texts)
                w = Windows(chunk, window, anchor)
                earlier = batch.column(2)[rows].fill_null([])
                of = np.repeat(np.arange(chunk.n_texts), earlier.value_lengths().to_numpy())
                begin = np.concatenate([chunk.bounds[of] + earlier.flatten().to_numpy(), w.word[w.repeats_within()]])
                n = int(chunk.bounds[-1])
                edges = np.bincount(begin, minlength=n + 1) - np.bincount(np.minimum(begin + window, n), minlength=n + 1)
                gone = np.cumsum(edges[:n]) > 0
                text = chunk.text_of_word()
                opens = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1] & (text[1:] == text[:-1])])[:n]) if n else np.zeros(0, np.int64)
                closes = np.flatnonzero(gone & ~np.concatenate([gone[1:] & (text[1:] == text[:-1]), [False]])[:n]) if n else np.zeros(0, np.int64)
                spans = np.stack([opens, closes], axis=1) - chunk.bounds[text[opens]][:, None]
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(spans) + 1, 2, dtype=np.int32)), pa.array(spans.reshape(-1).astype(np.int32)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(text[opens], minlength=chunk.n_texts))]).astype(np.int32)
                kept = []
                raw = chunk.data.tobytes()
                for i, (a, b) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)):
                    words = raw[chunk.offsets[i] : chunk.offsets[i + 1]].split()
                    kept.append(b" ".join(itertools.compress(words, (~gone[a:b]).tolist()) if gone[a:b].any() else words))
                yield pa.record_batch(
                    [
                        batch.column(0)[rows],
                        pa.array(chunk.counts.astype(np.int64)),
                        pa.array(np.bincount(text[gone], minlength=chunk.n_texts).astype(np.int64)),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), pairs),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "repeats"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, ids, places = docs.select("doc_id", "text"), starts.select("doc_id"), starts.withColumnRenamed("doc_id", "__doc_id")
    some = joined_by_id(docs, ids, "doc_id", "left_semi").join(places, F.col("doc_id") == F.col("__doc_id")).select("doc_id", "text", "starts")
    rest = joined_by_id(docs, ids, "doc_id", "left_anti").withColumn("starts", F.lit(None).cast("array<int>"))
    return some.union(rest).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string, repeats array<array<int>>")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that a window covers whose words also start earlier, in a smaller doc_id or before in the same text.

    The steps end in tables in the shared folder, each dropped once the next one stands.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = cut(anchors(docs, window, anchor), "anchors")
    seeds = cut(shared_seeds(found.df), "seeds")
    found.drop()
    windows = cut(extended(docs, seeds.df, window, anchor), "windows")
    seeds.drop()
    starts = cut(repeated_starts(windows.df), "starts")
    windows.drop()
    return without_repeats(docs, starts.df, window, anchor)
