"""Nearest neighbours by cosine: a locality-sensitive index, with exact scores for what it finds.

Vectors fall to one side or the other of random planes; the sides, as bits, are a
key, and near vectors often share one. Several tables of planes make it likely that
they share at least one, and a query also looks under the keys that differ from its
own in the bits it is least sure of. The planes follow from a seed, so any task makes
the same ones, and no vector is left out of the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import Stage

#: Rows of a cell to either side at most, about 16 MB of vectors of 64; cells that one key's rows make at least, if they have so many rows.
BLOCK_ROWS, LEAST_CELLS, LEAST_ROWS = 1 << 16, 16, 1_024
#: Scores computed at once, pairs scored again at once, and how far the product's scores may be from theirs.
PIECE, CANDIDATES, ROUNDING = 1 << 21, 1 << 15, 1e-12


def planes(seed: int, tables: int, bits: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, width)).astype(np.float32)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)


def index_keys(df: DataFrame, vector: str, width: int, tables: int, bits: int, probes: int = 0, seed: int = 0) -> DataFrame:
    """A row for each table and key of each row: the columns of ``df``, table, key.

    With ``probes``, also that many keys a table that differ in one bit, those whose
    plane the vector is nearest to. Null vectors and those of another width have none.
    """
    names = df.columns
    own = df.where(F.array_size(vector) == width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = planes(seed, tables, bits, width)
        weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        for batch in batches:
            v = _vectors(batch.column(vector), width)
            for t in range(tables):
                side = v @ made[t].T
                key = ((side > 0) * weights).sum(axis=1)
                near = np.argsort(np.abs(side), axis=1)[:, :probes]
                keys = np.concatenate([key[:, None], key[:, None] ^ weights[near]], axis=1)
                rows = np.repeat(np.arange(len(v)), keys.shape[1])
                columns = [batch.column(c).take(pa.array(rows)) for c in names]
                yield pa.record_batch([*columns, pa.array(np.full(len(rows), t, dtype=np.int32)), pa.array(keys.ravel())], [*names, "table", "key"])

    schema = T.StructType([*own.schema.fields, T.StructField("table", T.IntegerType()), T.StructField("key", T.LongType())])
    return own.mapInArrow(run, schema)


def _nearest_rows(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, neighbour and score of the k best rows y for each query x, as a product of matrices in pieces.

    The product only says who may be among the k; their scores are then computed pair by pair, so that
    a pair has the same score wherever it is met, and equal vectors tie.
    """
    order = np.argsort(others, kind="stable")
    y, others = y[order].astype(np.float64), others[order]
    x = x.astype(np.float64)
    x_norm, y_norm = (np.sqrt((v * v).sum(axis=1)) for v in (x, y))
    x, ids, x_norm = x[x_norm > 0], ids[x_norm > 0], x_norm[x_norm > 0]
    y, others, y_norm = y[y_norm > 0], others[y_norm > 0], y_norm[y_norm > 0]
    found = [(ids[:0], others[:0], x_norm[:0])]
    step = max(1, PIECE // max(len(y), 1))
    for at in range(0, len(x) if len(y) else 0, step):
        part, own, norm = x[at : at + step], ids[at : at + step], x_norm[at : at + step]
        near = (part / norm[:, None]) @ y.T
        near /= y_norm
        first, last = np.searchsorted(others, own), np.searchsorted(others, own, "right")
        for i in np.flatnonzero(last > first):  # never itself
            near[i, first[i] : last[i]] = -np.inf
        worst = np.partition(near, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(part), -np.inf)
        rows, cols = np.nonzero((near >= worst[:, None] - ROUNDING) & (near > -np.inf))
        score = np.zeros(len(rows))
        for b in range(0, len(rows), CANDIDATES):
            r, c = rows[b : b + CANDIDATES], cols[b : b + CANDIDATES]
            score[b : b + CANDIDATES] = (part[r] * y[c]).sum(axis=1) / (norm[r] * y_norm[c])
        order = np.lexsort((others[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((own[rows[best]], others[cols[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _best_in_cells(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, width: int, block_rows: int) -> DataFrame:
    """query, neighbour, score, place: of the pairs (query, v) and (neighbour, v) that agree in ``keys`` the k best of each query.

    The rows of a key form a grid of cells, of at most about ``block_rows`` rows to either side;
    what leaves a cell is k rows for each of its queries, never its pairs.
    """
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    parts = lambda name, least: F.greatest(F.ceil(F.col(name) / block_rows), least).cast("int")
    few = F.least(F.lit(0 if keys else LEAST_CELLS), F.ceil(F.col("n_rows") / LEAST_ROWS))  # so that one key's rows are work for many tasks
    counts = (n(queries, "n_queries").join(n(rows, "n_rows"), keys) if keys else n(queries, "n_queries").crossJoin(n(rows, "n_rows"))).select(
        *keys, parts("n_queries", F.lit(1)).alias("q_parts"), parts("n_rows", F.greatest(few, F.lit(1))).alias("r_parts")
    )
    grid = Stage(counts, "cells")
    dealt = lambda i, of: F.pmod(F.xxhash64(i), F.col(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    counted = lambda df: df.join(grid.df, keys) if keys else df.crossJoin(F.broadcast(grid.df))
    lefts = counted(queries).select(*keys, "query", "v", dealt("query", "q_parts").alias("q_part"), spread("r_parts").alias("r_part"))
    rights = counted(rows).select(*keys, "neighbour", "v", dealt("neighbour", "r_parts").alias("r_part"), spread("q_parts").alias("q_part"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (_vectors(t["v"].combine_chunks(), width) if len(t) else np.zeros((0, width), dtype=np.float32) for t in (a, b))
        return pa.table(dict(zip(("query", "neighbour", "score"), _nearest_rows(x, a["query"].to_numpy().astype(np.int64), y, b["neighbour"].to_numpy().astype(np.int64), k), strict=True)))

    cell = [*keys, "q_part", "r_part"]
    met = lefts.groupBy(*cell).cogroup(rights.groupBy(*cell)).applyInArrow(run, "query long, neighbour long, score double")
    # a pair that several keys have found has one score, so it has one rank and is told apart among the last few rows only
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "neighbour")
    return met.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k).dropDuplicates(["query", "neighbour"])


def _sides(queries: DataFrame, base: DataFrame, id_col: str, vector: str, width: int) -> list[DataFrame]:
    own = lambda df, i: df.where(F.col(id_col).isNotNull() & (F.array_size(vector) == width)).select(F.col(id_col).alias(i), F.col(vector).alias("v"))
    return [own(queries, "query"), own(base, "neighbour")]


def nearest_join(
    queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int, width: int, tables: int = 8, bits: int = 10, probes: int = 4, seed: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query, neighbour, score, place: for each query the k nearest rows that the index finds, by exact cosine; never itself.

    Vectors meet under (table, key) and are scored there; only the k best of a query leave a key,
    so what is shuffled follows the rows (``tables`` times the base, and 1 + ``probes`` times that
    many queries), not the candidates. ``bits`` should follow the size of ``base``, about its
    logarithm less seven, so that a key holds some hundred rows.
    """
    q, r = _sides(queries, base, id_col, vector, width)
    wanted, held = index_keys(q, "v", width, tables, bits, probes, seed), index_keys(r, "v", width, tables, bits, 0, seed)
    return _best_in_cells(wanted, held, ["table", "key"], k, width, block_rows)


def exact_nearest(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query, neighbour, score, place by brute force, to measure an index with: blocks of queries against blocks of rows, as products of matrices."""
    return _best_in_cells(*_sides(queries, base, id_col, vector, width), [], k, width, block_rows)
