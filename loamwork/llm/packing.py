"""Best-fit packing by large-item matching.

Token counts are whole numbers up to the capacity, so the packing is planned on
their histogram, which has no more entries than the capacity however many
documents there are. Pieces above a third of the capacity are matched greedily,
the largest with the largest that still fits, two to a sequence at most; the
rest go, largest first, each into the smallest gap that holds it. The plan is a
list of runs: so many pieces of one length, from such a rank on, go to such
sequences at such an offset. Every piece then finds its run by its length and its
rank among the pieces of that length; ranks are made in hashed groups of about
``GROUP_ROWS`` with group offsets, so a length that very many pieces share is no hot
task.

Only documents longer than the capacity are cut, so that all pieces but perhaps
the first are full. Defined cases: a null or empty text is the end id alone;
rows that repeat a doc_id are packed each for itself; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release
from .tokens import encode_documents

GROUP_ROWS = 20_000


@dataclass(frozen=True)
class Run:
    length: int
    rank: int  #: of its first piece among the pieces of this length
    pieces: int
    sequence: int  #: the first
    each: int  #: pieces a sequence
    offset: int  #: of the first piece in its sequence


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place every piece of the histogram {length: pieces}."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    rank = np.zeros(capacity + 1, dtype=np.int64)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, sequences)
    runs: list[Run] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(length, int(rank[length]), int(n), sequence, each, offset))
        rank[length] += n
        left[length] -= n

    least_large = capacity // 3 + 1
    for a in range(capacity, least_large - 1, -1):
        while left[a]:
            fits = [b for b in range(min(capacity - a, a), least_large - 1, -1) if left[b] > (b == a)]
            b = fits[0] if fits else 0
            n = int(left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b]))
            place(a, n, sequences, 1, 0)
            if b:
                place(b, n, sequences, 1, a)
            gaps[capacity - a - b].append((sequences, n))
            sequences += n
    for s in range(least_large - 1, 0, -1):
        while left[s]:
            g = next((g for g in range(s, capacity + 1) if gaps[g]), 0)
            if not g:
                each = capacity // s
                fresh = -(-int(left[s]) // each)
                gaps[capacity].append((sequences, fresh))
                sequences += fresh
                g = capacity
            first, n = gaps[g].pop()
            each = g // s
            full = min(n, int(left[s]) // each)
            if not full:  # the last few of this length share one sequence
                each, full = int(left[s]), 1
            place(s, full * each, first, each, capacity - g)
            gaps[g - each * s].append((first, full))
            if n > full:
                gaps[g].append((first + full, n - full))
    return runs


def pieces(
    docs: DataFrame, tokenizer: str, end: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with ``with_ids`` its ids as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            for first, ids, sizes in encode_documents(tokenizer, batch.column(1), end):
                counts = -(-sizes // capacity)
                ends = np.cumsum(counts)
                doc = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(doc)) - np.repeat(ends - counts, counts)
                # the first piece takes what the full ones leave
                head = (sizes - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                raw = ids.astype("<u4")
                parts = [raw[x : x + n].tobytes() for x, n in zip(at, length, strict=True)]
                out = {
                    "doc_id": batch.column(0).take(pa.array(first + doc)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                }
                yield pa.record_batch(out | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def ranked(items: DataFrame, order: list[str], groups: int) -> DataFrame:
    """``items`` with __rank, from 0 for each length: place in a hashed group plus the groups before."""
    items = items.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = items.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("length", "__group").orderBy(*order))
    return (
        items.withColumn("__within", within)
        .join(offsets.drop("__n"), ["length", "__group"])
        .withColumn("__rank", F.col("__before") + F.col("__within") - 1)
        .drop("__before", "__within", "__group")
    )


def pack(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``items``, which has a long column length of 1 to ``capacity``, with sequence_id and offset.

    ``items`` is read twice and should be a table; ``order`` names columns that
    tell its rows apart.
    """
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    groups = max(1, max(histogram.values(), default=0) // GROUP_ROWS)
    runs = sorted(plan(histogram, capacity), key=lambda r: (r.length, r.rank))
    fields = {k: np.array([getattr(r, k) for r in runs], dtype=np.int64) for k in ("length", "rank", "sequence", "each", "offset")}
    columns = [x for x in items.columns if x != "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fields["length"] << 48 | fields["rank"]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "__rank"))
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            place = rank - fields["rank"][at]
            sequence = fields["sequence"][at] + place // fields["each"][at]
            offset = fields["offset"][at] + place % fields["each"][at] * length
            yield pa.record_batch([*(batch.column(x) for x in columns), batch.column("length"), pa.array(sequence), pa.array(offset)], names=[*columns, "length", "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for x in [*columns, "length"] for f in [items.schema[x]])
    return ranked(items, order, groups).select(*columns, "length", "__rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int = 1024, **options) -> DataFrame:
    """Cut, plan and place: the pieces of all documents with their sequences."""
    table = cut(pieces(docs, tokenizer, end, capacity, **options), "pieces").df
    return pack(table, capacity, ["doc_id", "piece"])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids as bytes, from pieces that carry theirs; no more than a capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda ids, part: F.concat(ids, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
