import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamwork.llm import language_id, lm_maxent, quality_llr
from loamwork.llm.substring_dedup import substring_dedup
from loamwork.llm.wordhash import chunks, run_hashes

from .conftest import words


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_hashes_do_not_depend_on_the_batch():
    texts = [None, "", "a b", " b\ta ", "long " * 50, "é日 a"]
    alone = [next(chunks(pa.array([t], pa.string()))).hashes() for t in texts]
    together = list(chunks(pa.array(["x", *texts], pa.string()).slice(1), chunk_bytes=10))
    assert np.array_equal(np.concatenate(alone), np.concatenate([c.hashes() for c in together]))
    assert [n for c in together for n in c.counts] == [len(tokens_of(t)) for t in texts]
    assert len({*alone[2].tolist(), *alone[3].tolist()}) == 2
    h = alone[4]
    assert len(set(run_hashes(h, 3).tolist())) == 1 and len(run_hashes(h, 60)) == 0


def thue_morse(n):
    """A word of 2^n letters and its complement, whose polynomial hashes modulo 2^64 agree for any odd base from n = 11."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse_are_told_apart(make):
    one, two = thue_morse(11)
    (c,) = chunks(pa.array([f"{one} {two}"]))
    keys, hashes, others = list(zip(*c.keys(), strict=True)), c.hashes(), c.hashes(1)
    assert keys[0] != keys[1] and hashes[0] != hashes[1] and others[0] != others[1]
    short = ["a", "a\0", "\0a", "a" * 15, "a" * 15 + "\0", "a" * 16, "a" * 14, "abcdefgh", "abcdefg", "abcdefghi"]
    (c,) = chunks(pa.array([" ".join(short)]))
    assert len(set(zip(*c.keys(), strict=True))) == len(set(c.hashes().tolist())) == len(short)
    a, b = next(chunks(pa.array(["a b"]))).hashes()
    runs = [run_hashes(np.array([{"a": a, "b": b}[x] for x in word]), 2048)[0] for word in (one, two)]
    assert runs[0] != runs[1]
    # op1: the second word is not known; op7: no three-word run occurs twice
    got = {r["doc_id"]: r["n_known"] for r in lm_maxent.score_documents(make([(1, one), (2, two)]), F.col("doc_id") == 1).collect()}
    assert got == {1: 2, 2: 1}
    (c,) = chunks(pa.array([f"x y {one} x y {two}"]))
    assert quality_llr.base_rules(c, [""])["n_repeat_words"].tolist() == [0]


def brute_base(text):
    text = text or ""
    w, lines = tokens_of(text), [x for x in text.split("\n") if tokens_of(x)]
    seen, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    counts = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*counts, len(w) < 50 or 100 * len(covered) > 50 * len(w))


def quality_rows(odd_rows):
    rows = list(odd_rows)
    for i in range(60):
        good = words(i, 120, size=100)
        rows.append((100 + i, " ".join(good)))
        rows.append((300 + i, " ".join(x + "###" for x in good[:80])))
    return rows


def test_quality_rules(spark, make, odd_rows):
    rows = quality_rows(odd_rows)
    labels = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(300, 0), (9999, 1), (None, 1), (101, None)], "doc_id long, quality int")
    got = quality_llr.quality_rules(make(rows), labels).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert tuple(r)[1:7] == brute_base(texts[r["doc_id"]])
        if r["doc_id"] and r["doc_id"] >= 100:
            assert r["kept"] == (r["doc_id"] < 200)
    docs = make(rows)
    kept = quality_llr.quality_filter(docs, labels)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in got if r["kept"]), key=str)


def test_quality_rules_without_labels_or_rows(spark, make, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_llr.quality_rules(make(odd_rows), none).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] == 0 for r in got)
    assert quality_llr.quality_filter(make([]), none).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language_id.vocabulary(language_id.VOCABULARY)
    p = np.stack([pieces.prior(), pieces.prior()[::-1]], axis=1)
    number = {x: i for i, x in enumerate(pieces.pieces)}

    def total(word, k):
        if not word:
            return 1.0
        return sum(p[number[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in number)

    tried = [b" the", b" heading", b" \xc3\xa9", b"x", b" of", b" straightfor", b" " * 17]
    got = language_id.Lattice(tried, pieces).log_probabilities(p)
    assert got == pytest.approx(np.log([[total(w, k) for k in (0, 1)] for w in tried]))
    uses = language_id.Lattice(tried, pieces).expected(p, np.ones((len(tried), 2)))
    lengths = np.array([len(x) for x in pieces.pieces])
    assert lengths @ uses == pytest.approx(sum(map(len, tried)))


def test_a_word_of_a_megabyte():
    pieces = language_id.vocabulary(language_id.VOCABULARY)
    p = np.stack([pieces.prior(), pieces.prior()[::-1]], axis=1)
    # Only arcs from the place before lead to a place, and no piece is longer than a byte: the sum is a product.
    single = np.array([len(x) == 1 for x in pieces.pieces])
    with np.errstate(divide="ignore"):
        word, bytes_only = b"Zq9" * 350_000, np.where(single[:, None], p, 0)
        began = time.process_time()
        got = language_id.Lattice([word], pieces).log_probabilities(bytes_only)
    took = time.process_time() - began
    assert got[0] == pytest.approx(350_000 * np.log([p[[pieces.pieces.index(x) for x in (b"Z", b"q", b"9")], k] for k in (0, 1)]).sum(axis=1), rel=1e-9)
    assert took < 30  # about six seconds; it was over half a minute


def test_long_words_are_summed_whole():
    pieces = language_id.vocabulary(language_id.VOCABULARY)
    assert len(pieces) == 50_256 and max(map(len, pieces.pieces)) > 100
    p = np.stack([pieces.prior(), pieces.prior()[::-1]], axis=1)
    word = b" " + ("日本語の長い文" * 9).encode()  # cuts at any byte would fall inside characters
    tried = [word[:n] for n in (30, 48, 49, 100, 150)] + [b"=" * 200, b"-" * 60]
    got = language_id.Lattice(tried, pieces).log_probabilities(p)
    number = {x: i for i, x in enumerate(pieces.pieces)}
    for w, own in zip(tried, got, strict=True):
        for k in (0, 1):
            alpha = [0.0]
            for j in range(1, len(w) + 1):
                alpha.append(np.logaddexp.reduce([alpha[i] + math.log(p[number[w[i:j]], k]) for i in range(j) if w[i:j] in number]))
            assert own[k] == pytest.approx(alpha[-1])
    short, long = language_id.Lattice([b" heading"], pieces), language_id.Lattice([b" heading", word], pieces)
    assert long.logs and not short.logs
    uses = short.expected(p, np.ones((1, 2)))
    more = long.expected(p, np.array([[1.0, 1.0], [0.0, 0.0]]))
    assert more == pytest.approx(uses, abs=1e-9)
    lengths = np.array([len(x) for x in pieces.pieces])
    assert lengths @ long.expected(p, np.array([[0.0, 0.0], [2.0, 1.0]])) == pytest.approx([2 * len(word), len(word)])


def language_rows():
    roots = {"en": "the of and ing tion house", "de": "der und ung keit schl haus", "fr": "le les et eaux tion mai"}
    rows = []
    for k, (lang, parts) in enumerate(roots.items()):
        for i in range(40):
            w = words(1000 * k + i, 60, size=36)
            own = parts.split()
            rows.append((1000 * k + i, " ".join(own[int(x[1:]) % 6] + own[int(x[1:]) // 6] for x in w), lang))
    return rows


def test_language_id(make, odd_rows):
    rows = language_rows()
    model = language_id.fit(make([r for r in rows if r[0] % 2] + [(5000, "no lang", None)]), sample_docs=15)
    assert model.languages == ["de", "en", "fr"] and model.p.sum(axis=0) == pytest.approx(1)
    got = {r["doc_id"]: r for r in language_id.identify(make([r for r in rows if not r[0] % 2]), model).collect()}
    assert all(got[d]["lang_pred"] == lang and 0.9 < got[d]["score"] <= 1 for d, _, lang in rows if not d % 2)
    odd = language_id.identify(make(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {1, 2, 3, 11}


def test_language_id_with_nothing_to_learn_from(make, odd_rows):
    model = language_id.fit(make([]))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(make(odd_rows), model).collect()} == {("und", 0.0)}
    assert language_id.identify(make([]), model).count() == 0


def brute_scores(rows, training):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    texts = [(d, [*tokens_of((t or "").translate(lower)), None]) for d, t, *_ in rows]
    counts = Counter(x for d, w in texts if training(d) for x in w)
    n, mass = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    return n, counts, [(d, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.5) / mass) for x in w)) for d, w in texts]


def test_lm_base_score_against_brute_force(make, odd_rows):
    rows = odd_rows + [(100 + i, " ".join(words(i, 50)), "en") for i in range(40)]
    got = lm_maxent.score_documents(make(rows), F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 5 != 1).collect()
    n, _, want = brute_scores(rows, lambda d: (zlib.crc32(str(d).encode()) if d is not None else 0) % 5 != 1)
    key = lambda r: (str(r[0]), r[1])
    assert len(got) == len(rows)
    for g, w in zip(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3])
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


def test_lm_probabilities_sum_to_one(make):
    docs = make([(i, " ".join(words(i, 80, size=60) + [f"rare{i}", f"rare{i % 7}"])) for i in range(60)]).select("doc_id", "text", F.lit(True).alias("training"))
    model, _, counts = lm_maxent.learn(docs)
    size, filler = model.words.size, model.words.filler
    context = np.array([filler, 3, size + 5, 1])
    log = [model.log_probabilities(np.append(context, t), np.array([4]))[0] for t in range(filler)]
    left = {r["hash"]: r["n"] for r in counts.df.collect()}
    for h in model.words.hash:
        left.pop(int(h.astype(np.int64)), None)
    assert left
    in_bucket = np.full(lm_maxent.RARE_BUCKETS, 0.5)  # the unknown word
    for h, n in left.items():
        in_bucket[lm_maxent.bucket_of(np.array([h]).astype(np.uint64))] += n + 0.5
    total = np.exp(log[:size]).sum() + (np.exp(log[size:]) * in_bucket).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_lm_learns_order(make):
    chain = " ".join("abcdefgh"[i % 8] * 2 for i in range(200))
    got = lm_maxent.score_documents(make([(i, chain) for i in range(80)]), F.col("doc_id") % 5 != 1).collect()
    assert all(r["score"] > 0.8 * r["base_score"] for r in got if r["held_out"])


def test_lm_with_nothing_to_learn_from(make, odd_rows):
    got = lm_maxent.score_documents(make(odd_rows), F.lit(False)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["n_known"] == r["train_tokens"] == 0 and abs(r["base_score"]) < 1e-6 and r["held_out"] and math.isfinite(r["score"]) for r in got)
    assert lm_maxent.score_documents(make([]), F.lit(True)).count() == 0


def test_lm_rounds_visit_every_training_token_once():
    sizes = np.array([1, 7, 1, 40, 3])
    at = np.concatenate([lm_maxent.visited(sizes, turn, lm_maxent.ROUNDS) for turn in range(lm_maxent.ROUNDS)])
    assert sorted(at.tolist()) == lm_maxent.places(sizes).tolist()


@pytest.mark.parametrize("n", [10, 700])
def test_lm_every_word_of_a_class_depends_on_all_features(n):
    known = lm_maxent.Vocabulary(np.arange(n, dtype=np.uint64), np.arange(n), np.arange(n, 0, -1), n * n, n, 0, np.full(lm_maxent.RARE_BUCKETS, 1.5))
    model = lm_maxent.MaxentModel.start(known, np.array([0] + [1] * (n - 1)))
    for table in model.tables:
        table[:] = np.random.default_rng(1).normal(size=table.shape)
    same = {level: [] for level in range(3)}
    for t in (1, n - 1, n + 3):
        context = np.array([3, 4, 5, t])
        features = model.features(context, np.array([3]))
        assert len(features) == 4
        own = model.log_probabilities(context, np.array([3]))[0]
        for k in range(3):
            other = context.copy()
            other[k] = 7
            assert model.log_probabilities(other, np.array([3]))[0] != own
        for level, some, *_ in model.levels(features, np.array([t])):
            same[level].append(len(some))
    assert same[0] == same[1] == [1, 1, 1] and same[2] == [0, int(n == 700), 1]
    assert len(set(zip(model.klass, model.slot, model.place, strict=True))) == n + lm_maxent.RARE_BUCKETS


def test_words_made_to_collide_are_told_apart(make):
    """Two words whose low halves were solved for, so that one half's scrambling and the other add up to the same."""
    one, two = "!!(.4y&/:h[=~8i", "!!-ov:*p(#7zls6"
    got = {r["doc_id"]: r["n_known"] for r in lm_maxent.score_documents(make([(1, one), (2, two)]), F.col("doc_id") == 1).collect()}
    assert got == {1: 2, 2: 1}  # the end is known to both
    text = " ".join(f"{one} {i} a{i}" if i % 2 else f"{two} {i} a{i}" for i in range(20))
    assert quality_llr.quality_rules(make([(1, f"{one} a b {two} a b"), (2, text)]), make([]).selectExpr("doc_id", "0 AS quality", "0 AS toxic")).agg(F.sum("n_repeat_words")).first()[0] == 0
    fill = [f"w{i}" for i in range(19)]
    kept = substring_dedup(make([(1, " ".join([one, *fill])), (2, " ".join([two, *fill]))])).collect()
    assert sorted(r["n_removed"] for r in kept) == [0, 0]


def test_lm_learns_the_same_from_any_layout(spark, make):
    r = random.Random(4)
    docs = make([(i, " ".join(r.choice(["a b c", "b d", "c a e", f"x{i % 7}"]) for _ in range(300))) for i in range(60)])
    training = F.col("doc_id") % 5 != 1
    before, each = spark.conf.get("spark.sql.shuffle.partitions"), lm_maxent.TRAINER_TOKENS
    found = []
    try:
        lm_maxent.TRAINER_TOKENS = 1_000
        for parts, shuffled in ((1, 2), (8, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            found.append({x["doc_id"]: x["score"] for x in lm_maxent.score_documents(docs.repartition(parts), training).collect()})
    finally:
        lm_maxent.TRAINER_TOKENS = each
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(abs(found[0][k] - found[1][k]) < 1e-6 * abs(found[0][k]) + 1e-6 for k in found[0])
