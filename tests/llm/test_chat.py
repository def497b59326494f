import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm.chat_trees import chosen_paths, digests, escape, format_paths, format_turns, linear_messages, parse_turns, unescape
from loamwork.llm.common import cut

BITS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[TURN x]", "[/TURN]", "[TURN ", "\\", "<", "[", "]", " ", "\n", "a", "é"]
TEXT = st.lists(st.sampled_from(BITS), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool]", "", "other"]), TEXT), max_size=6)


@settings(max_examples=500, deadline=None)
@given(TURNS)
def test_round_trip(turns):
    text, spans = format_turns(turns)
    assert parse_turns(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_no_control_string_is_left_in_a_body(text):
    body = escape(text)
    assert unescape(body) == text and not any(x in body for x in ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[TURN ", "[/TURN]"])


def brute_paths(rows, conv):
    own = {i: (p, s) for c, i, p, _, _, s in rows if c == conv}
    parents = {p for p, _ in own.values()}
    paths = []
    for leaf in own:
        if leaf in parents:
            continue
        path, seen = [], set()
        at = leaf
        while at in own and at not in seen:
            seen.add(at)
            path.append(at)
            at = own[at][0]
        if at not in seen:
            paths.append(path[::-1])
    return sorted(paths, key=lambda p: (-sum(own[i][1] or 0 for i in p) / len(p), p[-1]))


@pytest.mark.parametrize("most", [1, 2])
def test_best_branches_against_brute_force(spark, most):
    rows = [(1, i, i - 1, "user", f"t{i}", 0.5) for i in range(1, 40)]  # a long chain, its first parent missing
    rows += [(2, 1, None, "user", "root", 1.0), (2, 2, 1, "assistant", "x", 0.1), (2, 3, 1, "assistant", "y", 0.9), (2, 4, 3, None, None, None), (2, 5, 3, "user", "z", 0.4), (2, 6, 5, "assistant", "w", 0.4)]
    rows += [(3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (3, 3, 1, "user", "hangs on it", 1.0)]
    rows += [(4, 7, None, "user", "alone", 0.0), (4, 3, None, "user", "tie", 0.0)]
    table = cut(spark.createDataFrame(rows, "conv long, id long, parent long, role string, text string, score double"), "messages").df
    paths = chosen_paths(table, most)
    got = {}
    for r in sorted(paths.collect(), key=lambda r: r["place"]):
        got.setdefault((r["conv"], r["leaf"]), []).append(r["id"])
    want = {(c, p[-1]): p for c in (1, 2, 3, 4) for p in brute_paths(rows, c)[:most]}
    assert got == want
    assert format_paths(paths).count() == len(want)


def test_conversations(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", "hi"), (1, 1, "assistant", "hi"), (2, None, None, "x"), (None, 0, "user", "lost"), (None, 1, "assistant", "found")]
    table = cut(linear_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), "messages").df
    got = {r["conv"]: r for r in digests(format_paths(chosen_paths(table))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 4 and got[2]["n_turns"] == 1
    assert got[None]["n_turns"] == 2 and got[None]["turns_sha256"] == hashlib.sha256(b"user\nlost\nassistant\nfound\n").hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(format_paths(chosen_paths(cut(linear_messages(empty), "messages").df))).count() == 0
