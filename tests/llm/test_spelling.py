"""Near words and forms against a brute-force comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from runlens.llm import spelling

DOCS = "doc_id long, text string, word string, N int, leaf int, root string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2, "r") for r in rows], DOCS)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, least_n=5, factor=5):
    n = {w: k for w, k in counts.items() if k >= least_n}
    found = {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        found[w] = (best if best is not None and n[best] >= factor * n[w] else None, len(others))
    out = set()
    for w, (form, others) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out.add((w, form, root, n[w], others, n[form] if form is not None else None))
    return out


def vocabulary(rng, size):
    letters = "abcdeéïß"
    words = Counter()
    for _ in range(size):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 8)))
        for _ in range(3):  # its variants, some rarer by far, some anagrams
            words[w] += rng.choice([4, 5, 25, 30, 150, 800, 5000])
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:], w[::-1]])
    words["a" * 400] += 500
    words["a" * 399 + "b"] += 9
    words["a" * 401] += 9
    words["日本語"] += 90
    words["日語"] += 9
    return words


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("leaf,node,sample", [(1 << 14, 48, 1 << 20), (40, 4, 1 << 20), (40, 4, 100)])
def test_variants_equal_brute_force(spark, monkeypatch, leaf, node, sample):
    for name, value in (("LEAF", leaf), ("NODE", node), ("SAMPLE", sample), ("SEEN", 4), ("PAIRS", 64)):
        monkeypatch.setattr(spelling, name, value)
    words = vocabulary(random.Random(leaf), 250)
    rows = [(w, n - 2, "x") for w, n in words.items()] + [(w, 2, "y") for w in words] + [(None, 9, "z"), ("", 9, "z")]
    assert result(spelling.variants(spark.createDataFrame(rows, "word string, n long, Best string"))) == brute(words)


def test_chains_lead_to_the_root(spark):
    words = {"a" * k: 5 ** (k + 1) for k in range(1, 14)}  # each form is the next one's
    got = result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words) and {r[2] for r in got} == {"a" * 13}


def test_words_of_whole_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["Straße", "straße", "ÉCOLE", "École", "running", "Runs", "naïveté", "x" * 30, "a1bcdefg-hijklmn"])
                         for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(None, "nullid nullid"), (7, None), (8, ""), (9, "again again"), (9, "again again"), (10, "longtext " * 30_000), (11, "İstanbul Ÿes Ωmega")]
    want = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 7 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] += 1
    got = Counter()
    for r in spelling.count_words(frame(spark, rows), delete_every=7).collect():
        got[r.word] += r.n
    assert got == want
    assert result(spelling.variants(spelling.count_words(frame(spark, rows), delete_every=7))) == brute(want)


def test_empty(spark):
    assert spelling.variants(spelling.count_words(frame(spark, []))).count() == 0
    assert spelling.variants(spelling.count_words(frame(spark, [(1, None), (2, "short words only")]))).count() == 0
