"""Hard negatives by a norm-bucketed search: exact best inner products within score windows.

Candidates are sorted by norm, greatest first, and cut into buckets of bounded size.
Anchors are the stated queries; they come in blocks of bounded size. A block meets a
bucket only if some anchor of it may still gain there: by Cauchy-Schwarz no row of
the bucket scores more than the anchor's norm times the bucket's greatest, so the
bucket is left out where that is below both the lower limit of each of the anchor's
windows and its k-th score so far. Buckets are met in waves that double, the
greatest norms first, so that the k-th scores of one wave prune the next and a later
wave adds few rows. Blocks and buckets that meet are one group each: a product of
two matrices in numpy, whatever the size of the table.

Defined cases: rows without an id, with a null label, a null vector or a null or
non-finite component take no part; of rows that repeat an id the one with the least
label, then the least vector stays; of vectors with different lengths the shorter is
taken to go on with zeros; an empty vector scores 0; an anchor alone with its label
has no positive and no rows; an empty table gives an empty result; other columns are
not read. Inner products that could pass 2**62 are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, cut

#: Rows of a bucket and of a block, at most (blocks: about).
BUCKET_ROWS = 2_048
BLOCK_ROWS = 2_048
#: Buckets of the first wave; each later wave has as many as all before it.
FIRST_WAVE = 16
#: Anchors whose scores are held at once.
ROWS_AT_ONCE = 256

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor long, slot int, other long, score long"


def quantised(df: DataFrame, vec_id: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label, q (whole numbers) of the rows that take part, one for each id."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = df.where(F.col(vec_id).isNotNull() & label.isNotNull() & v.isNotNull() & good).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), q.alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def norm_of(q: Column) -> Column:
    """The Euclidean norm, a little more than less."""
    return F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) * (1 + 1e-12)


def norm_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Cut:
    """The rows sorted by norm and cut into buckets: a table with bucket, norm, vec_id, label, q.

    Ties in norm go by vec_id, so a third of all rows with one norm are many buckets.
    """
    sized = rows.withColumn("norm", norm_of(F.col("q")))
    parts = max(1, -(-rows.count() // (16 * bucket_rows)))
    order = (F.col("norm").desc(), F.col("vec_id"))
    place = F.monotonically_increasing_id()  # partition << 33 | place in it
    in_order = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", place)
    local = F.col("place").bitwiseAND((1 << 33) - 1)
    bucket = F.shiftright("place", 33) * F.lit(1 << 33) + F.floor(local / bucket_rows)
    return cut(in_order.select(bucket.cast("long").alias("bucket"), "norm", "vec_id", "label", "q"), "norm-buckets")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row for each vector, with zeros at the end of short ones."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = pc.list_flatten(column).to_numpy().astype(np.int64)
    full = np.zeros((len(sizes), width), dtype=np.int64)
    full[np.arange(width)[None, :] < sizes[:, None]] = flat
    return full


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    raise ValueError("inner products of these vectors may pass 2**62")


def best_of(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best fitting scores of each row; ties go by the smaller id."""
    if fits.shape[1] > k and (fits.sum(axis=1) > k).any():
        kept = np.where(fits, scores, _LEAST)
        fits = fits & (scores >= np.partition(kept, -k, axis=1)[:, -k][:, None])
    row, col = np.nonzero(fits)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _search(anchors: pa.Table, bucket: pa.Table, k: int, same: bool) -> Iterator[pa.Table]:
    width = max(int(pc.max(pc.list_value_length(side["q"])).as_py()) for side in (anchors, bucket))
    ids, labels, q = bucket["vec_id"].to_numpy(), bucket["label"].to_numpy(), _matrix(bucket["q"], width)
    reach = float(bucket["norm"].to_numpy().max())
    mine, own, norms = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["norm"].to_numpy()
    a = _matrix(anchors["q"], width)
    low, high = anchors["low"].to_pylist(), anchors["high"].to_pylist()
    slots = max(map(len, low), default=0)
    floor_ = np.full((len(mine), slots), _MOST)
    ceil_ = np.full((len(mine), slots), _LEAST)
    for i, (lo, hi) in enumerate(zip(low, high, strict=True)):
        floor_[i, : len(lo)], ceil_[i, : len(hi)] = lo, hi
    may = np.flatnonzero((floor_ <= (norms * reach + 1)[:, None]).any(axis=1)) if slots else np.zeros(0, dtype=int)
    for start in range(0, len(may), ROWS_AT_ONCE):
        rows = may[start : start + ROWS_AT_ONCE]
        scores = _products(a[rows], q)
        fits = (labels[None, :] == own[rows][:, None]) == same
        fits &= ids[None, :] != mine[rows][:, None]
        for slot in range(slots):
            inside = fits & (scores >= floor_[rows, slot][:, None]) & (scores <= ceil_[rows, slot][:, None])
            row, col = best_of(scores, inside, ids, k)
            if len(row):
                yield pa.table([pa.array(mine[rows][row]), pa.array(np.full(len(row), slot, dtype=np.int32)), pa.array(ids[col]), pa.array(scores[row, col])], ["anchor", "slot", "other", "score"])


def _group(k: int, same: bool):
    empty = pa.table({"anchor": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    def run(anchors: pa.Table, bucket: pa.Table) -> pa.Table:
        if not len(anchors) or not len(bucket):
            return empty
        return pa.concat_tables([empty, *_search(anchors, bucket, k, same)])

    return run


def best_in_windows(anchors: DataFrame, candidates: DataFrame, k: int, same: bool, block_rows: int = BLOCK_ROWS, first_wave: int = FIRST_WAVE) -> Cut:
    """The k best candidates of each window of each anchor: anchor, slot, other, score, place (from 1).

    ``anchors``: vec_id, label, q, norm, low and high (arrays, an entry for each
    window); ``candidates``: as :func:`norm_buckets` cuts them. Only candidates of the
    anchor's label (``same``) or only those of other labels fit; never the anchor.
    """
    blocks = max(1, -(-anchors.count() // block_rows))
    blocked = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    own = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "other")
    stats = candidates.groupBy("bucket").agg(F.max("norm").alias("reach"))
    # places of buckets by norm: a row for each BUCKET_ROWS rows
    placed = cut(stats.withColumn("place", F.row_number().over(Window.orderBy(F.col("reach").desc(), "bucket")) - 1), "bucket-norms")
    total, done, size = placed.df.count(), 0, first_wave
    found: Cut | None = None
    while done < total:
        waiting = blocked
        if found is not None:  # windows now begin at their k-th score
            full = found.df.where(F.col("place") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth")).withColumnRenamed("anchor", "of")
            raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("kth", i.cast("int")), x)))
            waiting = blocked.join(full, F.col("vec_id") == F.col("of"), "left").withColumn("low", raised).drop("of", "kth")
        waiting = cut(waiting.where(F.size("low") > 0), "anchors")
        # the least norm that a bucket needs for some anchor of the block to gain
        least = F.array_min("low").cast("double")
        need = F.min(F.when(least <= 1, F.lit(0.0)).when(F.col("norm") > 0, (least - 1) / F.col("norm")))
        needs = waiting.df.groupBy("block").agg(need.alias("need")).where("need is not null")
        wave = placed.df.where((F.col("place") >= done) & (F.col("place") < done + size))
        offered = wave.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = offered.join(needs, "block").where("reach >= need").select("block", "bucket")
        left = waiting.df.join(pairs, "block").groupBy("block", "bucket")
        right = candidates.join(pairs, "bucket").groupBy("block", "bucket")
        new = left.cogroup(right).applyInArrow(_group(k, same), FOUND)
        both = new if found is None else found.df.drop("place").unionByName(new)
        after = cut(both.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k), "found")
        waiting.drop()
        if found is not None:
            found.drop()
        found, done, size = after, done + size, done + size
    placed.drop()
    return found or cut(candidates.sparkSession.createDataFrame([], FOUND + ", place int"), "found")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS, first_wave: int = FIRST_WAVE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` as :func:`quantised` gives them. An anchor's positives are its best
    rows of the same label; the negatives of a positive are the best rows of another
    label whose score is ``low`` to ``high`` per cent of the positive's.
    """
    buckets = norm_buckets(vectors, bucket_rows)
    anchors = buckets.df.where(is_anchor).drop("bucket")
    whole = anchors.withColumn("low", F.array(F.lit(_LEAST))).withColumn("high", F.array(F.lit(_MOST)))
    near = best_in_windows(whole, buckets.df, positives, True, block_rows, first_wave)
    slots = near.df.select("anchor", (F.col("place") - 1).alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    # 100 n >= low p and 100 n <= high p, in whole numbers
    lower = -F.expr(f"cast(floor(cast(-{low} * cast(positive_score as decimal(20,0)) as decimal(24,0)) / 100) as bigint)")
    upper = F.expr(f"cast(floor(cast({high} * cast(positive_score as decimal(20,0)) as decimal(24,0)) / 100) as bigint)")
    windows = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", lower.alias("low"), upper.alias("high")))).alias("w"))
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor")).select("vec_id", "label", "q", "norm", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    far = best_in_windows(asked, buckets.df, negatives, False, block_rows, first_wave)
    result = cut(
        slots.join(far.df.withColumnRenamed("score", "negative_score"), ["anchor", "slot"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("other").alias("negative_id"), "positive_score", "negative_score"
        ),
        "hard-negatives",
    )
    for table in (buckets, near, far):
        table.drop()
    return result.df
