"""Recursive queries over tables: only what a round adds is joined in the next one.

Each round is a table of its own, so neither lineage nor plan grows with the rounds, and
a lost executor costs a reread. What is known already is taken out by an anti join, so
loops end the recursion instead of running through it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Stage, staged

#: Rounds whose tables are read side by side before they are written as one.
ROUNDS_APART = 16


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: Sequence[str], most_rounds: int | None = None) -> DataFrame:
    """``seed`` and all that ``step`` derives from it, in columns ``keys`` and __round, the round that first found a row.

    ``step`` takes the rows that the last round added, with columns ``keys``, and returns
    rows with these columns; nulls equal nulls. It ends when a round adds nothing, or after ``most_rounds``.
    """
    new = staged(seed.select(*keys).distinct().withColumn("__round", F.lit(0)), "round")
    known: list[Stage] = [new]
    done = 0
    while (most_rounds is None or done < most_rounds) and not new.df.isEmpty():
        done += 1
        derived = step(new.df.select(*keys)).select(*keys).distinct()
        so_far = _read(known).select(*[F.col(k).alias(f"__known_{i}") for i, k in enumerate(keys)])
        same = [F.col(k).eqNullSafe(F.col(f"__known_{i}")) for i, k in enumerate(keys)]
        new = staged(derived.join(so_far, same, "left_anti").withColumn("__round", F.lit(done)), "round")
        known.append(new)
        if len(known) > ROUNDS_APART:
            together = staged(_read(known[:-1]), "rounds")
            for table in known[:-1]:
                table.drop()
            known = [together, new]
    return _read(known)


def _read(tables: Sequence[Stage]) -> DataFrame:
    return tables[0].spark.read.schema(tables[0].df.schema).parquet(*[t.path for t in tables])


def reachable(edges: DataFrame, starts: DataFrame, source: str, target: str, most_rounds: int | None = None) -> DataFrame:
    """node and steps: what can be reached from any row of ``starts`` (its one column), in the fewest steps.

    Edges lead from ``source`` to ``target``; those with a null lead nowhere, and edges
    that repeat or lead back change nothing. Nodes that are joined are distinct, so a
    node with very many edges is a hot key on one side only, which Spark splits.
    """
    start = starts.columns[0]
    links = staged(edges.select(F.col(source).alias("__from"), F.col(target).alias("__to")).where("__from is not null and __to is not null").distinct(), "edges")
    step = lambda new: new.join(links.df, F.col("node") == F.col("__from")).select(F.col("__to").alias("node"))
    found = fixpoint(starts.select(F.col(start).alias("node")).where("node is not null"), step, ["node"], most_rounds)
    links.drop()
    return found.select("node", F.col("__round").cast("long").alias("steps"))
