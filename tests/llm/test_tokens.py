import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamwork.llm import pfor, token_blocks, tokens
from loamwork.llm.common import new_path
from loamwork.llm.packing import pack_documents, plan, sequences

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXT = st.text(st.sampled_from("ab Éé ß\n\t.,!'s#\xa0 \x1c日 12_İ"), max_size=40)


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_ids_are_the_tokenizers_own(name, texts):
    t = plain(name)
    got = [list(x) for _, ids, sizes in tokens.encode_documents(name, pa.array(texts, pa.string()), 1) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("name", NAMES)
def test_ids_of_words_that_polynomials_confuse(name):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "a" * 15, "a" * 16, "a\0", "a"]
    t = plain(name)
    got = [list(x) for _, ids, sizes in tokens.encode_documents(name, pa.array(texts), 1) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_ids_stay_right_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 20)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    monkeypatch.setattr(tokens, "_encoders", {})
    t = plain(NAMES[0])
    for k in range(10):
        text = " ".join(f"word{chr(97 + (i * k) % 26)} and,the" for i in range(15))
        (_, ids, _), = tokens.encode_documents(NAMES[0], pa.array([text]), 2)
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    data = pfor.encode(ids)
    assert (pfor.decode(data) == ids).all() and len(pfor.decode(data)) == len(ids)
    for b in range(-(-len(ids) // pfor.BLOCK)):
        assert (pfor.decode_block(data, b) == ids[b * pfor.BLOCK : (b + 1) * pfor.BLOCK]).all()


def test_outliers_are_exceptions():
    ids = np.arange(128, dtype=np.uint32)
    ids[5] = 1 << 30
    assert len(pfor.encode(ids)) < 200


@pytest.mark.parametrize("segment", [1, 50, 1 << 18])
def test_token_blocks(spark, make, odd_rows, segment):
    path = new_path(spark, "test-blocks")
    token_blocks.write(make(odd_rows), path, NAMES[1], end=1, segment_ids=segment)
    rows = sorted(token_blocks.read(spark, path).collect(), key=lambda r: r["start"])
    t, at = plain(NAMES[1]), 0
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [r[0] for r in ordered]
    for r, (_, text, *_) in zip(rows, ordered, strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_blocks_of_nothing(spark, make):
    path = new_path(spark, "test-blocks")
    token_blocks.write(make([]), path, NAMES[1], end=1)
    assert token_blocks.read(spark, path).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40)))
@settings(max_examples=200, deadline=None)
def test_plan_places_everything_without_gaps(histogram):
    capacity, filled, placed = 60, {}, {}
    for r in plan(histogram, capacity):
        assert r.rank == placed.get(r.length, 0)
        placed[r.length] = r.rank + r.pieces
        for i in range(r.pieces):
            filled.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
    assert placed == histogram
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total, large = sum(k * v for k, v in histogram.items()), sum(v for k, v in histogram.items() if 2 * k > capacity)
    assert len(filled) >= max(-(-total // capacity), large)
    assert len(filled) <= 1.5 * max(-(-total // capacity), large) + 1


def test_large_pieces_are_paired():
    assert len({r.sequence for r in plan({700: 1, 324: 1, 400: 1, 600: 1}, 1024)}) == 2


def test_pack_documents(spark, make, odd_rows):
    docs = make(odd_rows)
    packed = pack_documents(docs, NAMES[0], end=2, capacity=64, with_ids=True).cache()
    assert packed.columns[:2] == ["doc_id", "piece"]
    t = plain(NAMES[0])
    by = {}
    for r in packed.collect():
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text, *_ in odd_rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()
        same = 2 if doc == 5 else 1
        own = sorted(by[doc], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own[::same]) == ids
        assert all(r["length"] == 64 for r in own if r["piece"])
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in own)
    for r in sequences(packed).collect():
        assert 0 < len(r["ids"]) <= 4 * 64
    assert sum(len(r["ids"]) for r in sequences(packed).collect()) == 4 * sum(r["length"] for rows in by.values() for r in rows)
    assert pack_documents(make([]), NAMES[0], end=2).count() == 0
