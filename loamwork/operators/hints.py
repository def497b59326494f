"""Join strategies, chosen by name where AQE should not decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Strategy names and Spark's hints for them (fixed values).
HINTS = {"broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge"}


def join_by(left: DataFrame, right: DataFrame, on: Sequence[str], strategy: str, how: str = "inner") -> DataFrame:
    """An equi-join by ``broadcast``, ``hash`` or ``merge``. The right side is the one broadcast or hashed."""
    return left.join(right.hint(HINTS[strategy]), list(on), how)
