"""SimHash near-dedup by the generalised pigeonhole principle.

Every text has a 64-bit fingerprint over its word shingles. The 64 bits are
dealt into parts, correlated bits together, and part i gets a threshold t_i of
its own, -1 (unused) upwards, with sum(t_i) = distance - parts + 1: two
fingerprints within the distance are then within t_i of each other in some part
i. Dynamic programming picks the thresholds, and the number of parts, that need
the fewest probes and candidates, as estimated from bucket counts and bit
statistics over all fingerprints. A probe looks up all values within t_i of its
own part and each candidate is verified on the whole fingerprint inside the join.

Equal fingerprints are one node throughout, so copies are never expanded. A
bucket with more than ``bucket_cap`` distinct fingerprints makes no pairs: its
members, and whoever probes it, go to a second way that is exact too. There
each fingerprint names all values within half the distance of it; any two that
name one value are linked, each value is named by few, and a star at its least
member links them without pairs. Components follow by alternating stars.

Defined cases: a null or empty text has no words and fingerprint 0, linked like
any other; a text shorter than a shingle is one shingle; rows that repeat a
doc_id count as one document; a null doc_id never names a component unless no
other id is in it; an empty table gives an empty result; extra columns pass
through ``near_dedup`` untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of
from .components import components

BITS = 64
SEED = 42
BUCKET_CAP = 64
#: Cost of handing one probe or index row to the join, in candidates verified.
ROW_COST = 4.0


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, A-Z lower-cased, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = list(itertools.accumulate(len(x) + 1 for x in parts))
    starts = [0, *ends[: len(parts) - words]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(x.encode(), words)) for x in texts_of(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).astype(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 13):
                bits = np.unpackbits(values[at : at + (1 << 13)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                both += np.rint(bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
            n += len(values)
        cells = np.append(both.ravel(), n)
        yield pa.record_batch([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "n"])

    rows = prints.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(BITS * BITS + 1)
    cells[rows["cell"]] = rows["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of like size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(sorted(left), key=lambda b: max((corr[b, c] for c in left), default=0))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


@dataclass(frozen=True)
class Part:
    number: int
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)


def allocate(costs: Sequence[Sequence[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 upwards with the given sum and the least cost.

    ``costs[i][t + 1]`` is the cost of threshold t for part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (sum_so_far, chosen) in best.items():
            for t, c in enumerate(cost, start=-1):
                if (at := spent + t) not in after or sum_so_far + c < after[at][0]:
                    after[at] = (sum_so_far + c, [*chosen, t])
        best = after
    return best[total]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(bits: Sequence[int], most: int) -> list[int]:
    """All masks of at most ``most`` of the bits."""
    return [_signed(sum(1 << b for b in some)) for k in range(most + 1) for some in itertools.combinations(bits, k)]


def _masked(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_signed(mask)))


def plan_parts(prints: DataFrame, distance: int) -> list[Part]:
    """The parts and thresholds for distinct fingerprints ``prints``.

    Within a part of ``w`` bits, C(0) candidates agree exactly; they are counted
    over all fingerprints. Those within t are estimated as C(0) times the
    elementary symmetric sums of the bits' odds of differing.
    """
    n, both = bit_statistics(prints)
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-12)
    layouts = {m: group_bits(n, both, m) for m in range(max(1, distance // 2 + 1), distance + 2)}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), _masked(sum(1 << b for b in bits)).alias("key")) for m, groups in layouts.items() for i, bits in enumerate(groups)]
    counted = (
        prints.select(F.inline(F.array(*keys)))
        .groupBy("m", "i", "key")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .groupBy("m", "i")
        .agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
        .collect()  # one row for each part
    )
    exact = {(r["m"], r["i"]): r["pairs"] for r in counted}
    chosen: tuple[float, list[Part]] | None = None
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            sums = [1.0]  # elementary symmetric sums of the odds, by degree
            for b in bits:
                sums = [x + (sums[k - 1] * odds[b] if k else 0) for k, x in enumerate([*sums, 0.0][: distance + 1])]
            cost = [0.0]
            for t in range(distance + 1):
                probes = sum(1 for _ in itertools.chain.from_iterable(itertools.combinations(bits, k) for k in range(t + 1)))
                cost.append(ROW_COST * n * (1 + probes) + exact.get((m, i), 0.0) * sum(sums[: t + 1]))
            costs.append(cost)
        cost, thresholds = allocate(costs, distance - m + 1)
        if chosen is None or cost < chosen[0]:
            chosen = cost, [Part(i, tuple(bits), t) for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    return chosen[1]


def bucket_keys(prints: DataFrame, parts: Sequence[Part]) -> tuple[DataFrame, DataFrame]:
    """``prints`` with part and key, once for its own buckets and once for all it probes."""
    own = prints.select("*", F.inline(F.array(*[F.struct(F.lit(p.number).alias("part"), _masked(p.mask).alias("key")) for p in parts])))
    probe = own
    for p in parts:
        if p.threshold > 0:
            near = F.explode(F.array(*[F.lit(x) for x in flips(p.bits, p.threshold)[1:]])).alias("__flip")
            key = _masked(p.mask).bitwiseXOR(F.col("__flip"))
            probe = probe.union(prints.select("*", near).select(*prints.columns, F.lit(p.number).alias("part"), key.alias("key")))
    return own, probe


def links(prints: DataFrame, distance: int = 2, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints are within ``distance``.

    ``distance`` is even, so that any two fingerprints within half of it of one
    value are linked. All links between cool buckets' members are here; for hot
    buckets enough of them to make the same components.
    """
    if distance % 2 or distance < 0:
        raise ValueError("the distance must be even")
    index, probe = bucket_keys(prints, plan_parts(prints, distance))
    hot = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_cap).select("part", "key")
    cool = index.join(hot, ["part", "key"], "left_anti").withColumnRenamed("fp", "other")
    pairs = (
        probe.join(cool, ["part", "key"])
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowded = probe.join(hot, ["part", "key"], "left_semi").select("fp").distinct()
    masks = F.explode(F.array(*[F.lit(x) for x in flips(range(BITS), distance // 2)])).alias("flip")
    stars = (
        crowded.select("fp", masks)
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
        .groupBy("middle")
        .agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members"))  # few can be this near one value
        .where(F.size("members") > 1)
        .select("a", F.explode("members").alias("b"))
        .where("a <> b")
    )
    return pairs.union(stars)


def near_duplicates(
    docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket_cap: int = BUCKET_CAP
) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) for every row."""
    prints = cut(fingerprints(docs, words, id_col, text_col), "prints").df
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes").df
    of = components(links(nodes, distance, bucket_cap))
    grouped = nodes.join(of, nodes["fp"] == of["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "root")
    found = cut(grouped.join(ids, F.col("component") == F.col("root")).select(F.col("fp").alias("node"), "component_id"), "components").df
    return prints.join(found, F.col("fp") == F.col("node")).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each component, with all its columns and no others."""
    marked = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")
