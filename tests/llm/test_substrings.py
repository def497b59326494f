import random
import re

import pytest

from loamwork.llm import common
from loamwork.llm.substring_dedup import substring_dedup

from .conftest import words


def brute(rows, window):
    seen, out = {}, {}
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            first = seen.setdefault(tuple(w[p : p + window]), (doc, p))
            if first[0] < doc or first[1] < p:
                gone[p : p + window] = [True] * window
        out[doc] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window,anchor,most", [(20, 10, 1 << 19), (20, 10, 0), (4, 2, 1 << 19)])
def test_against_brute_force(make, odd_rows, window, anchor, most, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    r = random.Random(2)
    passages = [words(20 + i, 45) for i in range(4)]
    rows = [x for x in odd_rows if x[0] is not None]
    for i in range(60):
        parts = [words(100 + i, r.randrange(30), size=6 if i % 5 == 0 else 900)]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(20)
            parts += [p[a : a + r.randrange(5, 45)], words(1000 + 7 * i + len(parts), r.randrange(12))]
        rows.append((50 + i, "\n ".join(" ".join(p) for p in parts)))
    got = substring_dedup(make(rows), window, anchor).collect()
    want = brute(rows, window)
    assert len(got) == len(rows)
    for x in got:
        assert (x["n_words"], x["n_removed"], x["kept_text"]) == want[x["doc_id"]]
        spans = [tuple(s) for s in x["repeats"]]
        assert sum(b - a + 1 for a, b in spans) == x["n_removed"] and all(b - a + 1 >= window for a, b in spans)
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_words_that_polynomials_confuse_do_not_repeat(make):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    one, two = (" ".join([x] + words(1, 30)[:19]) for x in (word, word.translate(str.maketrans("ab", "ba"))))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(make([(1, one), (2, two), (3, one)])).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_rows_without_id_and_no_rows(make):
    text = " ".join(words(1, 30))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(make([(None, text + " " + text), (1, text)])).collect()}
    assert got == {None: 30, 1: 0}
    assert substring_dedup(make([])).count() == 0
