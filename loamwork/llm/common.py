"""Helpers the corpus operators share: word pattern, shared folder, stage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Ids that are broadcast at most; of more ids a filter is.
MOST_BROADCAST = 1 << 19
#: Bits of that filter for each id, and at most: 64 MB however many ids there are.
FILTER_BITS, MOST_FILTER_BITS = 32, 1 << 29
#: Bits in one row of the filter, as Spark's own functions for bitmaps have it.
ROW_BITS = 1 << 15

#: Rows of an Arrow batch where the session has Spark's own 10,000, which is much memory if texts are long.
BATCH_ROWS = 1_000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_or_empty(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """From now on batches of BATCH_ROWS rows, unless the session has set a number of its own."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def joined_by_id(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """The rows of ``docs`` whose id is (left_semi) or is not (left_anti) among the doc_id of ``ids``, a table; null is an id.

    Up to ``MOST_BROADCAST`` ids are broadcast, so that no text moves. Beyond that a
    filter of bits is, and only rows that it lets through are joined by a shuffle.
    """
    wanted, n = ids.select(F.col("doc_id").alias("__wanted_id")), ids.count()
    if n <= MOST_BROADCAST:
        return docs.join(F.broadcast(wanted), docs[id_col].eqNullSafe(F.col("__wanted_id")), how)
    marked = with_filter(docs, ids, id_col, n)
    maybe = marked.where("__maybe").drop("__maybe")
    found = maybe.join(wanted, maybe[id_col].eqNullSafe(F.col("__wanted_id")), how)
    return found if how == "left_semi" else marked.where("not __maybe").drop("__maybe").union(found)


def with_filter(docs: DataFrame, ids: DataFrame, id_col: str, n: int) -> DataFrame:
    """``docs`` with __maybe: false only where the row's id is surely none of the ``n`` ``ids``.

    A bit of a bitmap is set for the hash of each id, as in a Bloom filter of one hash.
    """
    bits = min(max(1 << (n * FILTER_BITS - 1).bit_length(), ROW_BITS), MOST_FILTER_BITS)

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(bits))

    def row_of(at: Column) -> Column:
        return F.shiftright(at, 15)

    at = place(F.col("doc_id"))
    rows = ids.select(row_of(at).alias("__row"), (at % ROW_BITS).alias("at")).groupBy("__row").agg(F.bitmap_construct_agg("at").alias("__bits"))
    here = place(docs[id_col])
    joined = docs.withColumn("__at", here).join(F.broadcast(rows), row_of(F.col("__at")) == F.col("__row"), "left")
    byte = F.conv(F.hex(F.substring("__bits", ((F.col("__at") % ROW_BITS) / 8 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (F.col("__at") % 8 + 1).cast("int"))) > 0
    return joined.withColumn("__maybe", F.coalesce(is_set, F.lit(False))).drop("__at", "__row", "__bits")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='loamwork-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/loamwork/{tag}-{uuid.uuid4().hex}"


class _Cleanup:
    """While a table is written, what Spark shuffled for it goes as soon as it is done.

    The first of several writes at a time sets this for the session, the last puts back what was there.
    """

    def __init__(self) -> None:
        self.lock, self.writes, self.before = threading.Lock(), {}, {}

    @contextlib.contextmanager
    def of(self, spark: SparkSession) -> Iterator[None]:
        key = spark._jsparkSession.sessionUUID()
        with self.lock:
            if not self.writes.get(key):
                self.before[key] = spark.conf.get(_CLEANUP, None)
                spark.conf.set(_CLEANUP, "true")
            self.writes[key] = self.writes.get(key, 0) + 1
        try:
            yield
        finally:
            with self.lock:
                self.writes[key] -= 1
                if not self.writes[key]:
                    del self.writes[key]
                    before = self.before.pop(key)
                    spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_cleanup = _Cleanup()


def cut(df: DataFrame, tag: str) -> Cut:
    """Write ``df`` as a table in the shared folder and go on from the file.

    The lineage ends there, so a lost executor costs no more than a reread,
    and the shuffle files behind the table are released at once.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, tag)
    with _cleanup.of(spark):
        df.write.option("compression", "zstd").parquet(path)
    return Cut(spark, path, df.schema)


class Cut:
    """A table written by :func:`cut`: ``df`` reads it, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: What tasks keep in their worker from one to the next.
_kept: list[dict] = []


def kept_in_worker() -> dict:
    """A new dictionary for what is worth keeping from task to task. Tasks of another kind empty it."""
    _kept.append({})
    return _kept[-1]


def release(everything: bool = False) -> None:
    """Give back to the system what this worker has freed, with ``everything`` what it keeps for later tasks too: Spark keeps workers from step to step, and they keep what an earlier one took."""
    for held in _kept if everything else ():
        held.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in a worker that keeps nothing of earlier tasks and nothing of this one."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(everything=True)
        yield from run(batches)
        release(everything=True)

    return alone


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The column as Python strings, null as the empty string."""
    return [x or "" for x in column.to_pylist()]
