import random
import re
from collections import Counter

import pytest

from loamwork.llm.collocations import collocations

from .conftest import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, share=80, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(found)
            for size in range(1, 5):
                f.update((lang or "und", tuple(found[i : i + size])) for i in range(len(found) - size + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in kept.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        inside = any(x == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in kept.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    ranked, seen = [], Counter()
    for lang, score, a, p, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], p.decode(), -a, l, r, n[lang], -score))
    return sorted(ranked)


def found(docs, **how):
    return sorted(map(tuple, collocations(docs, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def rows():
    r = random.Random(3)
    out = []
    for i in range(150):
        text = words(i, 120, size=40)
        for _ in range(6):
            text.insert(r.randrange(len(text)), r.choice(["New York city", "new YORK city hall", "of the", "Über, alles", "a\tb", "x.y x", "café noir", "one;two three four", "e\x0bf e", "k k k k"]))
        out.append((i, " ".join(text), ["en", "de", None][i % 3], "s"))
    out += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, " \t\n", "de", "s"), (1002, " \t\n", "de", "s"), (None, "new york city", "und", "s"), (1003, "Z" * 300_000 + " zz zz zz", "fr", "s")]
    return out


@pytest.mark.parametrize("how", [{}, {"buckets": 64, "part_bytes": 500}])
def test_as_by_plain_counts_also_where_all_buckets_are_full(make, how):
    given = rows()
    want = plain(given, 12)
    assert len(want) > 20 and {x[0] for x in want} == {"en", "de", "und"}
    assert found(make(given), least=12, **how) == want


def test_a_prefix_of_the_ranks_and_no_documents(make):
    given = rows()
    assert found(make(given), least=8, top=3) == plain(given, 8, top=3)
    assert found(make([(1, None)])) == [] and found(make([(1, None)]).limit(0)) == []
