import random

import numpy as np
import pytest

from loamwork.llm import common, near_text, simhash
from loamwork.llm.components import components
from loamwork.llm.simhash import allocate, fingerprint, group_bits, near_dedup, near_duplicates, shingle_hashes

from .conftest import words


def closure(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "y"), (None, "z"), ("z", None), ("y", "b")], "a string, b string")
    assert {tuple(r) for r in components(odd).collect()} == {("x", "b"), ("y", "b"), ("b", "b")}


def test_thresholds():
    assert allocate([[0, 5, 9], [0, 1, 2], [0, 1, 9]], 0) == (3, [-1, 1, 0])
    groups = group_bits(100, np.full((64, 64), 25.0) + np.eye(64) * 25, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


@pytest.mark.parametrize("cap", [64, 3])
def test_hamming_components_against_brute_force(spark, cap):
    r = random.Random(1)
    prints = {0}
    for _ in range(25):
        at = r.getrandbits(64)
        for _ in range(8):
            prints.add(at)
            at ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    found = {r["node"] % (1 << 64): r["component"] % (1 << 64) for r in components(simhash.links(nodes, 2, cap)).collect()}
    want = closure(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for x in prints:
        groups.setdefault(want[x], set()).add(x)
    mine = {}
    for x in prints:
        mine.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates(make, odd_rows):
    base = words(3, 200)
    rows = odd_rows + [(100 + i, " ".join(base[:-i] + ["end"] * i if i else base)) for i in range(4)]
    got = near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    prints = {r[0]: fingerprint(shingle_hashes((r[1] or "").encode(), 3)) for r in rows if r[0] is not None}
    want = closure(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    kept = near_dedup(make(rows))
    assert kept.columns == make([]).columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == set(want.values())
    assert near_dedup(make([])).count() == 0


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("turns,most", [(2, 1 << 19), (0, 0)])
def test_near_texts_against_brute_force(make, odd_rows, turns, most, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    rows, r = list(odd_rows), random.Random(5)
    for k in range(3):
        base = words(50 + k, 120, size=5000)
        for i in range(25):
            copy = list(base)
            for _ in range(r.randrange(7)):
                copy[r.randrange(len(copy))] = r.choice(["new%d" % r.randrange(40)])
            rows.append((1000 * (k + 1) + i, " ".join(copy)))
    sets = {d: set(shingle_hashes((t or "").encode(), 5).tolist()) for d, t, *_ in rows if d is not None}
    docs = make(rows)
    want = closure(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    kept = near_text.near_dedup_texts(docs, turns=turns)
    got = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and None in got
    assert got - {None} == set(want.values())
    assert near_text.near_dedup_texts(make([])).count() == 0


def edited_copies(seed):
    """Texts with copies that have much appended, cut or replaced at one place."""
    rows, r = [], random.Random(seed)
    for k in range(60):
        n = r.choice([60, 120, 300, 800])
        base, other = words(900 + k, n, size=5000), words(2000 + k, n, size=5000)
        some = n // 10
        edits = [base + other[:some], base + other[: 2 * some], base[: n - some], base[: n - 3 * n // 20], base[: n // 3] + other[: some - 4] + base[n // 3 + some - 4 :]]
        rows += [(10 * k + i, " ".join(t)) for i, t in enumerate([base, r.choice(edits)])]
    return rows


def test_near_texts_far_apart_in_bits_against_brute_force(make):
    rows = edited_copies(3)
    sets = {d: set(shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
    prints = {r["doc_id"]: r["fp"] % (1 << 64) for r in near_text.fingerprints(make(rows).select("doc_id", "text"), 5).collect()}
    similar = [10 * k for k in range(60) if jaccard(sets[10 * k], sets[10 * k + 1]) >= 0.8]
    assert sum((prints[d] ^ prints[d + 1]).bit_count() > 10 for d in similar) > 3
    want = closure(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert {r["doc_id"] for r in near_text.near_dedup_texts(make(rows)).collect()} == set(want.values())


def test_all_of_500_planted_pairs_are_found(make):
    """Pairs with a similarity of 0.80 to 0.85, edited at one place or at many."""
    rows, planted, r, k = [], 0, random.Random(8), 0
    while planted < 500:
        n = r.choice([60, 100, 200])
        copy = base = words(7000 + k, n, size=50_000)
        if k % 3 == 0:
            copy = base + words(90_000 + k, n * r.randrange(17, 25) // 100, size=50_000)
        elif k % 3 == 1:
            copy = base[: n - n * r.randrange(15, 20) // 100]
        else:
            copy = list(base)
            for p in r.sample(range(n), max(1, n // 50)):
                copy[p] = "edit"
        s = [set(shingle_hashes(" ".join(x).encode(), 5).tolist()) for x in (base, copy)]
        if 0.8 <= jaccard(*s) <= 0.85:
            rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
            planted += 1
        k += 1
    kept = {r["doc_id"] for r in near_text.near_dedup_texts(make(rows)).collect()}
    assert kept == {d for d, _ in rows if d % 2 == 0}


def test_parity_bounds_the_difference(make):
    rows, r = [], random.Random(4)
    for k, n in enumerate([0, 3, 200, 270, 500, 640, 1500, 4000]):
        base = words(300 + k, n, size=100_000)
        rows += [(10 * k + i, " ".join(w if r.random() > i / 40 else "new%d" % r.randrange(10**6) for w in base)) for i in range(5)]
    docs = make(rows).select("doc_id", "text")
    found = {x["doc_id"]: x for x in near_text.fingerprints(docs, 5).collect()}
    sets = {x["doc_id"]: set(x["shingles"]) for x in near_text.shingle_sets(docs, 5).collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and (0.8 <= len(sets[a]) / max(len(sets[b]), 1) <= 1.25 or not sets[a] and not sets[b])]
    left = near_text._tried_whole(near_text._tried(make([]).sparkSession.createDataFrame(pairs, "a long, b long"), near_text.fingerprints(docs, 5), 0.8), near_text.fingerprints(docs, 5), 0.8)
    left = {tuple(x) for x in left.collect()}
    alike = {p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8}
    assert alike <= left and all(jaccard(sets[a], sets[b]) > 0.6 for a, b in left)
    assert {len(found[d]["whole"] or []) for d in sets} >= {0, 16, 32}


def test_common_lines_are_last_in_prefixes(make, monkeypatch):
    line = words(1, 40, size=5000)
    docs = make([(i, " ".join(words(100 + i, 200, size=5000) + line)) for i in range(50)]).select("doc_id", "text")
    frequent = near_text.frequent_shingles(docs, 5)
    assert len(frequent[0]) == 36 and set(frequent[1].tolist()) == {50}
    found = near_text.fingerprints(docs, 5, 0.8, frequent).collect()
    keys = [x for r in found for x in r["prefix"]]
    assert len(set(keys)) == len(keys) and all(len(r["prefix"]) == r["size"] - -(-4 * r["size"] // 5) + 1 for r in found)


def pages_of_a_template(n, own, seed=0):
    r = random.Random(seed)
    shared = words(1, 120, size=10**6)
    return [(i, " ".join(shared[:60] + ["o%d" % r.randrange(10**9) for _ in range(own)] + shared[60:])) for i in range(n)]


def test_pages_of_a_template_below_the_similarity_meet_nobody(spark, make):
    def met(n):
        docs = make(pages_of_a_template(n, 12)).select("doc_id", "text")
        sketches = near_text.fingerprints(docs, 5, 0.8, near_text.frequent_shingles(docs, 5))
        none = spark.createDataFrame([], "node long, component long")
        members = common.cut(near_text.mixed_buckets(near_text.shared_prefixes(sketches), none), "members").df
        assert members.groupBy("key").count().where("count > 1").count() > 0
        x, y = (near_text.meeting(members, 0.8, w) for w in "xy")
        return x.join(y, ["key", "x_class", "y_class"]).count()  # what the join itself makes

    assert met(300) <= 3 * 300 and met(900) <= 3 * 900


def test_pages_of_a_template_around_the_similarity(make):
    """Own parts of many lengths: some pairs are similar, most are not."""
    rows = [(i * 10 + k, t) for k, own in enumerate((2, 5, 8, 10, 11, 14, 20)) for i, t in pages_of_a_template(9, own, k)]
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in rows}
    want = closure(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    found = {r["doc_id"]: r["component_id"] for r in near_text.near_duplicate_texts(make(rows)).collect()}
    assert {i: found.get(i, i) for i in sets} == want and len(set(want.values())) > 5
