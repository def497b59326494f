"""The registered queries and the pipeline against plain Python, over whole small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from loamwork.llm import language_id, queries
from loamwork.llm.common import cut, documents
from loamwork.llm.quality_llr import BUCKETS, PRIOR, SIGMAS, gram_buckets
from loamwork.llm.simhash import shingle_hashes
from loamwork.llm.wordhash import chunks

from .test_exact_and_mix import brute_classes, fill
from .test_models import brute_base, brute_scores, tokens_of
from .test_near import closure, jaccard
from .test_tokens import plain


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def rows(sf_dir):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def labels(sf_dir):
    return {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}


def result(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir)


def test_op1(spark, sf_dir, rows):
    found = result(spark, sf_dir, "op1_lm_scoring")
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    n, _, want = brute_scores(rows, lambda d: crc(d) % 5 != 1)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for d, tokens, known, base in want:
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, crc(d) % 5 == 1)
        assert r["base_score"] == pytest.approx(base) and -math.inf < r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op2(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op2_language_id").collect()}
    assert len(got) == len(rows)
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.where(queries._fold(3) != 1))
    pieces = language_id.vocabulary(language_id.VOCABULARY)
    number, logs = {x: i for i, x in enumerate(pieces.pieces)}, np.log(model.p)
    learned = {lang for d, _, lang, _ in rows if lang and crc(d) % 3 != 1}
    right = total = 0
    for k, (d, text, lang, _) in enumerate(rows):
        r = got[d]
        assert r["held_out"] == (crc(d) % 3 == 1) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        assert r["lang_pred"] in learned
        if r["held_out"] and lang:
            right, total = right + (r["lang_pred"] == lang), total + 1
        if k < 8:  # every segmentation of every word, one after the other
            sums = np.zeros(len(model.languages))
            for word in ((" " + w).encode() for w in tokens_of(text)[:200]):
                alpha = [np.zeros(len(sums))]
                for j in range(1, len(word) + 1):
                    alpha.append(np.logaddexp.reduce([alpha[i] + logs[number[word[i:j]]] for i in range(j) if word[i:j] in number]))
                sums += alpha[-1]
            langs, scores = model.predict([" ".join(tokens_of(text)[:200])])
            assert langs == [model.languages[sums.argmax()]] and scores[0] == pytest.approx(1 / np.exp(sums - sums.max()).sum())
    assert right >= 0.95 * total  # 75 texts, some of one word


def test_op3(spark, sf_dir, rows):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result(spark, sf_dir, "op3_token_blocks").collect()}
    t, at, want = plain("word_bpe_49k.json"), 0, {}
    for d, text, *_ in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want


def packed_right(found, ids, copies):
    """Whether pieces hold each document's ids as often as it has copies, and sequences have neither gaps nor too much."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == {d for d, n in copies.items() if n}
    for d, own in by.items():
        whole, head = ids[d], (len(ids[d]) - 1) % 1024 + 1
        ends = [0, *range(head, len(whole) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(whole[a:b].tobytes())) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == sorted(want * copies[d])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    large = sum(1 for r in found if r["length"] > 512)
    least = max(large, -(-sum(r["length"] for r in found) // 1024))
    assert least <= len(sequences) <= 1.05 * least + 1


@pytest.fixture(scope="module")
def ids(rows):
    t = plain("byte_bpe_50k.json")
    return {d: np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4") for d, text, *_ in rows}


def test_op4(spark, sf_dir, rows, ids):
    packed_right(result(spark, sf_dir, "op4_best_fit_packing").collect(), ids, {d: 1 for d, *_ in rows})


def brute_quality(rows, trusted):
    """doc_id -> base columns and whether the text stays."""
    grams = {d: Counter(b for c in chunks(pa.array([text], pa.string())) for b in gram_buckets(c, BUCKETS)[1].tolist()) for d, text, *_ in rows}
    raw, good = Counter(), Counter()
    for d, own in grams.items():
        raw.update(own)
        if d in trusted:
            good.update(own)
    share = sum(good.values()) / max(sum(raw.values()), 1)
    score, base = {}, {d: brute_base(text) for d, text, *_ in rows}
    for d, own in grams.items():
        terms = [n * math.log((good[b] - n * (d in trusted) + PRIOR) / ((raw[b] - n) * share + PRIOR)) for b, n in own.items()]
        score[d] = sum(terms) / max(sum(own.values()), 1)
    known = [score[d] for d in grams if d in trusted and not base[d][-1]]
    threshold = np.mean(known) - SIGMAS * np.std(known)
    assert min(abs(x - threshold) for x in score.values()) > 1e-9
    return {d: (*base[d], not base[d][-1] and score[d] >= threshold) for d in grams}, score


def test_op7(spark, sf_dir, rows, labels):
    found = result(spark, sf_dir, "op7_quality_rules").collect()
    want, score = brute_quality(rows, {d for d, q in labels.items() if q == 1})
    assert {r["doc_id"]: (*tuple(r)[1:7], r["kept"]) for r in found} == want
    assert all(r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-9) for r in found)
    assert 0 < sum(r["kept"] for r in found) < len(rows)


def brute_fingerprint(text):
    w = tokens_of((text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op8(spark, sf_dir, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, sf_dir, "op8_simhash_near_dedup").collect()}
    prints = {d: brute_fingerprint(text) for d, text, *_ in rows}
    root = closure(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {d: (f"{p:016x}", root[d]) for d, p in prints.items()}


def test_pipeline(spark, sf_dir, rows, labels, ids):
    """Each stage does to what its predecessor kept what plain Python does to it."""
    by, docs = {r[0]: r for r in rows}, documents(spark, sf_dir)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name).df
        kept[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    passed = {d for d, x in brute_quality(rows, {d for d, q in labels.items() if q == 1})[0].items() if x[-1]}
    assert kept["quality_rules"] == Counter(passed)
    first = {r[0] for r in brute_classes([by[d] for d in passed]) if r[3]}
    assert kept["exact_dedup"] == Counter(first)
    sets = {d: set(shingle_hashes((by[d][1] or "").encode(), 5).tolist()) for d in first}
    alone = set(closure(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8).values())
    assert kept["simhash_near_dedup"] == Counter(alone)
    sizes = {d: len(tokens_of(by[d][1])) for d in alone}
    sums = Counter()
    for d in alone:
        sums[by[d][3]] += sizes[d]
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    target = fill(sums, weights, 3)
    copies = {}
    for d in alone:
        rate = target[by[d][3]] / sums[by[d][3]]
        draw = int(hashlib.md5(f"{d}:0".encode()).hexdigest()[:8], 16) / 2**32
        copies[d] = math.floor(rate) + (draw < rate - math.floor(rate))
    assert kept["mixing"] == Counter({d: n for d, n in copies.items() if n})
    packed_right(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), ids, copies)


