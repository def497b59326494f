"""Chat formatting of reply trees.

Messages point at the message they answer. Iterative self-joins double the
known distance to an ancestor in each round, so paths of any depth take a
logarithmic number of joins: a first run gives each leaf its depth and its
score summed over the path, the branches of a conversation are ranked by mean
score, and a second run collects the messages of the chosen branches only. Each
chosen path becomes one conversation.

The template marks turns as ``[INST] .. [/INST]`` for the user, ``<s> .. </s>`` for
the assistant, ``<<SYS>> .. <</SYS>>`` for the system, and ``[TURN role] ..
[/TURN]`` for any other role. Inside texts and roles a backslash is put before
each backslash and after the bracket of each control string, so control strings
of the template occur only where the template put them and the text can be read
back exactly. Loss falls on assistant texts, given as spans of code points.

Defined cases: null is a conversation like any other; a null text is empty and a
null role is the empty role; a message
whose parent is missing starts a tree; messages in a cycle have no root and no
leaf and are left out; equal scores go to the smaller leaf id; repeated turns are
put in order by role and text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, cut

#: Opening and closing mark of each role (fixed values of the template).
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
_CONTROL = re.compile(r"\\|\[(?=/?INST\]|TURN |/TURN\])|<(?=/?s>|</?SYS>>|/?SYS>>)")
_TURN = re.compile(
    r"\[INST\] (?P<user>(?:[^\\\[]|\\.|\[(?!/INST\]))*?) \[/INST\]"
    r"|<s>(?P<assistant>(?:[^\\<]|\\.|<(?!/s>))*)</s>"
    r"|<<SYS>>(?P<system>(?:[^\\<]|\\.|<(?!</SYS>>))*)<</SYS>>"
    r"|\[TURN (?P<role>(?:[^\\\]]|\\.)*)\](?P<other>(?:[^\\\[]|\\.|\[(?!/TURN\]))*)\[/TURN\]",
    re.DOTALL,
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it that carry loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        if role in MARKS:
            begin, end = MARKS[role]
        else:
            begin, end = f"[TURN {escape(role).replace(']', chr(92) + ']')}]", "[/TURN]"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(begin), at + len(begin) + len(body)))
        out += [begin, body, end]
        at += len(begin) + len(body) + len(end)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        kind = found.lastgroup
        role = unescape(found["role"]) if kind == "other" else kind
        turns.append((role, unescape(found[kind])))
        at = found.end()
    return turns


def _rounds(jumps: DataFrame):
    """The tables of jumps over 1, 2, 4, .. answers, until none is left or only cycles are.

    A jump is conv, id and the ancestor ``up`` that far above.
    """
    table = cut(jumps, "jumps")
    count = table.df.count()
    most = count.bit_length() + 1  # a path is no longer than there are jumps; what goes on is a cycle
    while count and most:
        yield table
        further = table.df.alias("a").join(table.df.alias("b"), (F.col("a.conv").eqNullSafe(F.col("b.conv"))) & (F.col("a.up") == F.col("b.id")))
        columns = [F.col("a.conv").alias("conv"), F.col("a.id").alias("id"), F.col("b.up").alias("up")]
        columns += [(F.col(f"a.{x}") + F.col(f"b.{x}")).alias(x) for x in jumps.columns[3:]]
        table = cut(further.select(*columns), "jumps")
        count, most = table.df.count(), most - 1


def chosen_paths(messages: DataFrame, per_conversation: int = 1) -> DataFrame:
    """conv, leaf, place, id, role, text along the best branches of each conversation.

    ``messages`` has conv, id (unique in its conversation), parent, role, text
    and score. It is read several times and should be a table.
    """
    known = messages.select(F.col("conv").alias("c"), F.col("id").alias("p"))
    linked = messages.join(known, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("parent") == F.col("p")), "left").withColumn("parent", F.col("p")).drop("c", "p")
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    edges = linked.where("parent is not null").select("conv", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("n"), score.alias("sum"))
    inner = edges.select(F.col("conv").alias("c"), F.col("up").alias("u")).distinct()
    leaves = messages.join(inner, F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("u")), "left_anti")
    tables = list(_rounds(edges))
    best = _best(leaves.select("conv", "id"), [t.df for t in tables], linked, per_conversation)
    path = best.select("conv", "leaf", F.col("leaf").alias("at"), F.lit(0).cast("long").alias("above"))
    so_far: Cut | None = None
    for k, jumps in enumerate(tables):
        step = jumps.df.select(F.col("conv").alias("c"), F.col("id").alias("i"), "up")
        more = path.join(step, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("at") == F.col("i"))).select("conv", "leaf", F.col("up").alias("at"), (F.col("above") + (1 << k)).alias("above"))
        longer = cut(path.union(more), "paths")
        if so_far:
            so_far.drop()
        so_far, path = longer, longer.df
    for table in tables:
        table.drop()
    text = messages.select(F.col("conv").alias("c"), F.col("id").alias("i"), "role", "text")
    return path.join(text, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("at") == F.col("i"))).select("conv", "leaf", (-F.col("above")).alias("place"), F.col("at").alias("id"), "role", "text")


def _best(leaves: DataFrame, tables: list[DataFrame], linked: DataFrame, most: int) -> DataFrame:
    """The leaves whose branches rank first. Each climbs to its root, by the largest jumps first."""
    at = leaves.select("conv", F.col("id").alias("leaf"), F.col("id").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("sum"))
    for jumps in reversed(tables):
        step = jumps.select(F.col("conv").alias("c"), F.col("id").alias("i"), "up", F.col("n").alias("dn"), F.col("sum").alias("ds"))
        at = at.join(step, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("at") == F.col("i")), "left").select(
            "conv",
            "leaf",
            F.coalesce("up", "at").alias("at"),
            (F.col("n") + F.coalesce("dn", F.lit(0))).alias("n"),
            (F.col("sum") + F.coalesce("ds", F.lit(0.0))).alias("sum"),
        )
    roots = linked.where("parent is null").select(F.col("conv").alias("c"), F.col("id").alias("i"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("own"))
    ranked = at.join(roots, (F.col("conv").eqNullSafe(F.col("c"))) & (F.col("at") == F.col("i"))).withColumn("mean", (F.col("sum") + F.col("own")) / (F.col("n") + 1))
    order = Window.partitionBy("conv").orderBy(F.col("mean").desc(), "leaf")
    return cut(ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("conv", "leaf"), "best").df


def format_paths(paths: DataFrame) -> DataFrame:
    """conv, leaf, formatted and loss_spans, one row for each path."""
    turn = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = paths.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.string()), pa.array([[list(s) for s in spans] for _, spans in made], pa.list_(pa.list_(pa.int64())))],
                names=["conv", "leaf", "formatted", "loss_spans"],
            )

    kinds = {x: whole.schema[x].dataType.simpleString() for x in ("conv", "leaf")}
    return whole.mapInArrow(run, f"conv {kinds['conv']}, leaf {kinds['leaf']}, formatted string, loss_spans array<array<long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read back from it: turns and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse_turns(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                rows.append((len(turns), _sha256(whole), len(loss), _sha256(loss), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.select("conv", "formatted", "loss_spans").mapInArrow(
        run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def linear_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Turns of conversations without branches as messages, each an answer to the one before."""
    place: Column = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return (
        turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), "role", "text")
        .withColumn("id", place.cast("long"))
        .select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    )
