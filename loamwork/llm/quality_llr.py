"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs of every text fall into a fixed number of buckets. One
pass counts the buckets over the whole raw corpus and over its trusted part,
which gives two multinomials; a text's score is the mean of log P(bucket |
trusted) - log P(bucket | raw) over its n-grams. The trusted part is all documents
that are labelled good, however many. The threshold
is read off their own scores: their mean less ``sigmas`` standard deviations, so
that a text which reads like trusted ones stays wherever it comes from. Every
document is counted and every document is judged; the model is two vectors of
``buckets`` numbers however large the corpus.

Defined cases: a null or empty text has no words, fails the base rules and has
score 0; without any trusted text the ratio is 0 everywhere and only the base
rules decide; a label without a document, and one whose quality or doc_id is
null, is ignored; rows that repeat a doc_id are judged alike; extra columns pass
through ``quality_filter`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, cut, lean, small_batches, texts_of, with_filter
from .wordhash import Chunk, chunks, mix, run_hashes

BUCKETS = 1 << 17
NGRAMS = (1, 2)
SIGMAS = 6.0
PRIOR = 4.0

#: The characters that count as symbols (fixed values of the rules).
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def with_trust(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``docs`` with __trusted: whether the row is labelled good.

    Up to ``most_broadcast`` ids are broadcast, so no text moves. Beyond that a filter
    of bits is, and only the rows that it lets through are joined by a shuffle.
    """
    small_batches(docs.sparkSession)
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    table = cut(good, "trusted").df
    ids, n = table.select(F.col("doc_id").alias("__trusted_id")), table.count()

    def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(ids, rows[id_col] == F.col("__trusted_id"), "left").withColumn("__trusted", F.col("__trusted_id").isNotNull()).drop("__trusted_id")

    if n <= most_broadcast:
        return marked(docs, F.broadcast(ids))
    filtered = with_filter(docs, table, id_col, n)
    rest = filtered.where("not __maybe").drop("__maybe").withColumn("__trusted", F.lit(False))
    return marked(filtered.where("__maybe").drop("__maybe"), ids).unionByName(rest)


def gram_buckets(chunk: Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram of the chunk."""
    words, of = chunk.hashes(), chunk.text_of_word()
    at, which = [], []
    for n in NGRAMS:
        h = run_hashes(words, n)
        inside = of[: len(h)] == of[n - 1 :] if len(h) else np.zeros(0, dtype=bool)
        at.append(of[: len(h)][inside])
        which.append((mix(h[inside] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(at), np.concatenate(which)


def count_grams(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket, raw count, trusted count over all of ``docs``, which has __trusted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            for chunk in chunks(batch.column(0)):
                at, which = gram_buckets(chunk, buckets)
                totals[0] += np.bincount(which, minlength=buckets)
                totals[1] += np.bincount(which[trusted[chunk.first + at]], minlength=buckets)
        seen = np.flatnonzero(totals[0])
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(totals[0][seen]), pa.array(totals[1][seen])], names=["bucket", "raw", "trusted"])

    return (
        docs.select(F.col(text_col).cast("string"), "__trusted")
        .mapInArrow(lean(count), "bucket int, raw long, trusted long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    )


@dataclass
class RatioModel:
    """Counts by bucket, and the threshold below which a text is dropped."""

    raw: np.ndarray
    trusted: np.ndarray
    prior: float = PRIOR
    threshold: float = float("-inf")

    def scores(self, chunk: Chunk, trusted: np.ndarray) -> np.ndarray:
        """Mean log ratio over each text's n-grams, its own counts taken out first.

        Without that a text's rare n-grams would speak for it if it is labelled
        and against it if not. ``trusted`` says which texts are labelled so.
        """
        buckets, n = len(self.raw), chunk.n_texts
        at, which = gram_buckets(chunk, buckets)
        pair, own = np.unique(at * buckets + which, return_counts=True)
        at, which = pair // buckets, pair % buckets
        share = self.trusted.sum() / max(self.raw.sum(), 1)
        raw = np.maximum(self.raw[which] - own, 0)
        good = np.maximum(self.trusted[which] - own * trusted[at], 0)
        terms = own * np.log((good + self.prior) / (raw * share + self.prior))
        return np.bincount(at, weights=terms, minlength=n) / np.maximum(np.bincount(at, weights=own, minlength=n), 1)


def fit(docs: DataFrame, buckets: int = BUCKETS, sigmas: float = SIGMAS, prior: float = PRIOR, text_col: str = "text") -> RatioModel:
    """Both multinomials over all of ``docs``, which has __trusted, and the threshold over its trusted texts.

    A bucket's ratio is shrunk to 0 by ``prior`` pseudo-counts on both sides, so
    rare n-grams weigh little.
    """
    counts = count_grams(docs, buckets, text_col).toPandas()  # at most ``buckets`` rows
    raw, trusted = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], trusted[counts["bucket"]] = counts["raw"], counts["trusted"]
    model = RatioModel(raw, trusted, prior)
    if trusted.sum():
        held = score(docs.where("__trusted"), model, text_col).where("not base_failed")
        mean, spread = held.agg(F.avg("score"), F.stddev_pop("score")).first()
        if mean is not None:
            model.threshold = mean - sigmas * spread
    return model


def base_rules(chunk: Chunk, texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of a chunk."""
    data, n = chunk.data, chunk.n_texts
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(points[chunk.ends] - points[chunk.starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    dup_lines = np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            dup_lines[i] = len(lines) - len(set(lines))
    repeated = np.zeros(n, dtype=np.int64)
    h, of = run_hashes(chunk.hashes(), 3), chunk.text_of_word()
    if len(h):
        first = np.flatnonzero(of[: len(h)] == of[2:])
        _, back, times = np.unique(mix(h[first] ^ mix(of[first].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        covered = np.zeros(len(of), dtype=bool)
        twice = first[times[back] > 1]
        for k in range(3):
            covered[twice + k] = True
        repeated = np.bincount(of[covered], minlength=n)
    return {
        "n_words": chunk.counts,
        "word_chars": in_words[chunk.bounds[1:]] - in_words[chunk.bounds[:-1]],
        "n_symbols": symbols[chunk.offsets[1:]] - symbols[chunk.offsets[:-1]],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeated,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(model: RatioModel, text: pa.Array, trusted: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """First row, counts, base_failed, score and kept for some texts at a time."""
    for chunk in chunks(text):
        rows = slice(chunk.first, chunk.first + chunk.n_texts)
        found = base_rules(chunk, texts_of(text[rows]))
        found["base_failed"] = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
        found["score"] = model.scores(chunk, trusted[rows])
        found["kept"] = ~found["base_failed"] & (found["score"] >= model.threshold)
        yield chunk.first, found


def score(docs: DataFrame, model: RatioModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the counts of the base rules, base_failed, score and kept for every row of ``docs``, which has __trusted.

    The model, two numbers a bucket, reaches the tasks as one broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trusted = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, found in _judge(shared.value, batch.column(1), trusted):
                ids = batch.column(0)[first : first + len(found["kept"])]
                counts = [pa.array(found[x].astype(np.int64)) for x in _COUNTS]
                yield pa.record_batch([ids, *counts, *(pa.array(found[x]) for x in ("base_failed", "score", "kept"))], names=["doc_id", *_COUNTS, "base_failed", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{x} long" for x in _COUNTS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"), "__trusted").mapInArrow(
        lean(run), f"doc_id {kind}, {counts}, base_failed boolean, score double, kept boolean"
    )


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fit on ``docs`` and its labels, then judge every row of ``docs``."""
    marked = with_trust(docs, labels, id_col)
    return score(marked, fit(marked, text_col=text_col, **options), text_col, id_col)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and no others."""
    marked = with_trust(docs, labels, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(marked, text_col=text_col, **options))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trusted = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            rows = batch.select(range(batch.num_columns - 1))
            for first, found in _judge(shared.value, batch.column(text_at), trusted):
                kept = found["kept"]
                yield rows.slice(first, len(kept)).filter(pa.array(kept))

    return marked.mapInArrow(lean(run), docs.schema)
