import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from loamwork.llm import queries
from loamwork.llm.exact_dedup import exact_dedup, mark_duplicates
from loamwork.llm.mixing import mix, mixed_copies, n_words, source_targets


def brute_classes(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


def test_exact_dedup_against_brute_force(make, odd_rows):
    docs = make(odd_rows)
    assert sorted(map(tuple, mark_duplicates(docs).collect()), key=str) == brute_classes(odd_rows)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    want = sorted((r[0] for r in brute_classes(odd_rows) if r[3]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want


def test_ids_of_any_order_and_at_the_ends_of_their_range(spark, make):
    last = (1 << 63) - 1
    rows = [(last, "a"), (5, "b"), (-last - 1, "c d"), (last, "cd"), (0, "a ")]
    assert sorted(map(tuple, mark_duplicates(make(rows)).collect()), key=str) == brute_classes(rows)
    assert {r["doc_id"] for r in exact_dedup(make([(last, "a"), (5, "b")])).collect()} == {last, 5}
    named = spark.createDataFrame([("x", "a"), ("b", "a"), (None, "a"), ("c", "z")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in mark_duplicates(named).collect()} == {("x", "b"), ("b", "b"), (None, "b"), ("c", "c")}
    assert {r["doc_id"] for r in exact_dedup(named).collect()} == {"b", "c"}


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_texts_that_share_the_hash_are_told_apart_by_their_bytes(make, monkeypatch, most):
    from loamwork.llm import common
    from loamwork.llm import exact_dedup as module
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    monkeypatch.setattr(module, "content_hash", lambda norm: F.when(norm.isNotNull(), F.unhex(F.lit("00"))))
    got = {r["doc_id"]: r["keep_id"] for r in mark_duplicates(make([(1, "x y"), (2, "xy"), (3, "z")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty_tables(make):
    docs = make([])
    assert mark_duplicates(docs).count() == exact_dedup(docs).count() == mix(docs).count() == 0


def fill(sizes, weights, most):
    """Water-filling, a source at a time."""
    target, left, open_ = {}, float(sum(sizes.values())), dict(weights)
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if most * sizes[s] < level * open_[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 7, None: 50}, {"a": 5}, {"a": 0, "b": 0}, {"x": 1, "y": 1000, "z": 2}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert got == pytest.approx(fill(sizes, {s: i % 3 + 1 for i, s in enumerate(names)}, 3))


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_mix(make, odd_rows, monkeypatch, most):
    from loamwork.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SOURCES", most)
    docs = make(odd_rows)
    copies = mixed_copies(docs, n_words())
    rows = copies.collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["copies"] <= 3 for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixed_copies(make(odd_rows), n_words()).collect()), key=str)
    out = mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want)
