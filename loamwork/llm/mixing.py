"""Mixing sources to target weights.

Tokens are summed per source, targets give each source its rate of
repetition, and a document is emitted floor(rate) times plus one more time if
the hash of its id falls below the fraction. All of it is DataFrame functions;
only one narrow row per source is ever gathered, to rank the sources and to
find the level at which their targets stop. Rates come back to the documents by
broadcast up to ``MOST_SOURCES`` sources, so that no text moves and a hot source is
no hot task; beyond that by a join.

Defined cases: a null text has size 0; null is a source like any other and
ranks last; a source whose sizes sum to 0 has target 0 and rate 0; rows that
repeat a doc_id are emitted alike; an empty table gives an empty result; other
columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_or_empty

#: Sources whose rates are broadcast, at most.
MOST_SOURCES = 1 << 16


def n_words(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def uniform(id_col: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the id's hash, the same in every run."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target, rate for the (source, size) rows given.

    The targets share the total by weight, none above ``most`` times its
    source's size; what a stopped source leaves is shared again by weight. So
    target = min(most * size, level * weight). Ordered by most * size / weight
    the stopped sources come first, and the level follows from sums over them.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    sums = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("ratio", F.lit(most) * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("size_to", F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn(
            "level_here",
            (F.col("total") - F.lit(most) * F.coalesce(F.col("size_to"), F.lit(0))) / F.col("weight_from"),
        )
        # the first source that the level reached so far does not stop gives the level for all
        .withColumn("level", F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "source", "level_here"))).over(everything)["level_here"])
    )
    capped = F.lit(most) * F.col("source_size")
    target = F.least(capped.cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return sums.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("rate"),
    )


def with_rates(rows: DataFrame, targets: DataFrame, source_col: str) -> DataFrame:
    """``rows`` with __source_size, __target and __rate of their source; ``targets`` is a table."""
    rates = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    rates = F.broadcast(rates) if targets.count() <= MOST_SOURCES else rates
    return rows.join(rates, rows[source_col].eqNullSafe(F.col("__source")))


def _copies(id_col: str, seed: int) -> Column:
    rate = F.col("__rate")
    return (F.floor(rate) + (uniform(id_col, seed) < rate - F.floor(rate)).cast("int")).cast("int")


def mixed_copies(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most: int = 3,
    seed: int = 0,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row. Sizes are taken once, into a narrow table."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sizes").df
    targets = cut(source_targets(rows, weights, most), "targets").df
    return with_rates(rows, targets, "source").select(
        *rows.columns, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), _copies("doc_id", seed).alias("copies")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 0
) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    sizes = docs.select(F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    targets = cut(source_targets(sizes, weights, most), "targets").df
    taken = with_rates(docs, targets, source_col).withColumn("__copies", _copies(id_col, seed)).where("__copies > 0")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).drop("__copy")
