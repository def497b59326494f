"""Token-id output: documents in ascending id order as patched blocks on disk.

Texts are range-partitioned and sorted by doc_id, so each task writes one shard,
and shards follow each other in id order. A shard is rows of a Parquet table,
one for each segment: its documents' ids and lengths, how many ids of the shard
stand before it, and the segment's bytes (see ``pfor``). Parquet is the carrier
because any store that Spark can write will do. A document's place in the whole
is its segment's place in its shard plus the ids of the shards before, of which
there is one number for each write task.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id stand next to each other, ordered by text; null ids come first; a
document longer than a segment is one segment; an empty table gives an empty
file set; other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pfor
from .tokens import encode_documents

SEGMENT_IDS = 1 << 18

_SCHEMA = "shard int, segment int, before long, doc_ids array<{kind}>, lengths array<long>, payload binary"


def encoded(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The rows of the file set, not yet written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        names: list = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        waiting = 0

        def row() -> pa.RecordBatch:
            return pa.record_batch(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, sum(map(len, names))], pa.int32()), pa.concat_arrays(names)),
                    pa.array([np.concatenate(lengths)], pa.list_(pa.int64())),
                    pa.array([pfor.encode(np.concatenate(parts))], pa.binary()),
                ],
                names=["shard", "segment", "before", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            for first, ids, sizes in encode_documents(tokenizer, batch.column(1), end):
                names.append(batch.column(0)[first : first + len(sizes)])
                lengths.append(sizes)
                parts.append(ids)
                waiting += len(ids)
                if waiting >= segment_ids:
                    yield row()
                    before, segment, waiting = before + waiting, segment + 1, 0
                    names, lengths, parts = [], [], []
        if parts:
            yield row()

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(run, _SCHEMA.format(kind=kind))


def write(docs: DataFrame, path: str, tokenizer: str, end: int, **options) -> None:
    encoded(docs, tokenizer, end, **options).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian u32 bytes) of every document, from the files."""
    segments = spark.read.parquet(path)
    sizes = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = segments.groupBy("shard").agg(F.sum(sizes).alias("n")).orderBy("shard").collect()  # one row a write task
    bases, so_far = {}, 0
    for r in totals:
        bases[r["shard"]] = so_far
        so_far += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                lengths = batch.column(3)[i].values.to_numpy()
                data = pfor.decode(batch.column(4)[i].as_py()).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                ids = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.record_batch(
                    [batch.column(2)[i].values, pa.array(bases[shard] + before + starts), pa.array(lengths), pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    return segments.select("shard", "before", "doc_ids", "lengths", "payload").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids binary, ids_crc32 long"
    )
