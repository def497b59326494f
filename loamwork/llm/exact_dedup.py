"""Exact dedup: groups by 128-bit content hash, bytes compared within a group.

Built of DataFrame functions only. Texts are equal when they are identical
after every character of ``[\\x20\\x09-\\x0D]`` is deleted. One pass makes a narrow
table of ids and hashes, and grouping goes over that. Whole texts move only where
a hash is met more than once: those are grouped by (hash, normalised text), so rows
stand together only if all their bytes agree, and copies combine before the shuffle
whatever their number. What follows carries hashes and counts alone. The ids whose
texts are looked at, and those that go, are broadcast up to ``MOST_BROADCAST`` of
them; beyond that a filter of their hashes is, of bounded size, and only texts it lets
through move.

Defined cases: a null text counts as empty, and empty texts equal each other; ids
are of any type that has an order; rows that repeat a doc_id with the same text are
one document, stay or go together and count singly in ``group_size``; of rows that
repeat a doc_id with other texts all stay if one stays; a row with null doc_id ranks
after all others, and such rows stay if one of them stays; an empty table gives an
empty result. Other columns pass through ``exact_dedup`` untouched and cannot clash
with the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, joined_by_id, text_or_empty


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACE, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and of the normalised text the 128-bit hash and SHA-256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    return rows.select("doc_id", content_hash(F.col("norm")).alias("hash"), F.sha2("norm", 256).alias("text_sha256"))


def ids_met_twice(prints: DataFrame) -> DataFrame:
    """doc_id of all rows of ``prints`` whose hash another row has as well."""
    often = prints.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    return prints.join(often, "hash", "left_semi").select("doc_id").distinct()


def duplicate_classes(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """class_hash, class_sha256, group_size and keep_id of each class of equal texts among the rows with these ids, a table.

    Two texts that share the hash but differ in a byte are two classes here.
    """
    text = text_or_empty(text_col)
    members = joined_by_id(docs, ids, id_col, "left_semi").select(
        normalised(text_col).alias("norm"), F.struct((-F.length(text)).alias("length"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id")).alias("rank")
    )
    return (
        members.withColumn("hash", content_hash(F.col("norm")))
        .groupBy("hash", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("rank").alias("best"))
        .select(F.col("hash").alias("class_hash"), F.sha2("norm", 256).alias("class_sha256"), "group_size", F.col("best.id").alias("keep_id"))
    )


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    A row finds its class by hash and SHA-256, a narrow join whose hot keys
    Spark's skew join splits; a row without a class is alone.
    """
    rows = cut(fingerprints(docs, id_col, text_col), "hashes").df
    ids = cut(ids_met_twice(rows), "ids")
    classes = cut(duplicate_classes(docs, ids.df, id_col, text_col), "classes").df
    ids.drop()
    found = rows.join(classes, (F.col("hash") == F.col("class_hash")) & (F.col("text_sha256") == F.col("class_sha256")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others."""
    marked = mark_duplicates(docs, id_col, text_col)
    gone = cut(marked.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id"), "gone").df
    return joined_by_id(docs, gone, id_col, "left_anti")
