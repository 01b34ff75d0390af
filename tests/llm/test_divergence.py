"""The quadtree audit against a dense brute-force version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n long, Term string, total int, rank string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "t", 1, "r", 2) for i, r in enumerate(rows)], DOCS)


def brute(rows, least=3, top=200):
    counts, held, seen = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        seen.add((lang, source))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang in {x for x, _ in seen}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = [s for x, s in seen if x == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        for a in sources:
            pair = sorted((-sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b.encode()) for b in sources if b != a)
            term = sorted((-((p[a][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, a][t] and p[a][t] > q[t])[:top]
            out |= {(lang, a, part, item.decode(), -v, i + 1) for part, x in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(x)}
    return out


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("tile,columns,leaf", [(256, 1 << 14, (16, 64)), (4, 64, (2, 8)), (16, 16, (16, 64))])
def test_audit_equals_brute_force(spark, monkeypatch, tile, columns, leaf):
    for name, value in zip(("TILE", "COLUMNS", "LEAF_ROWS", "LEAF_COLUMNS"), (tile, columns, *leaf), strict=True):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(tile)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ä", "ä", "İx", "日本", "A", "a"]
    rows = []
    for i in range(700):
        source = "hot" if i % 3 == 0 else rng.choice([f"s{j}" for j in range(14)] + [None, "", "é", "\U0001f600", "￿"])
        own = vocabulary[hash_of(source) % 200:][:60]  # zero quadrants: most groups use a part of the words
        rows.append((" ".join(rng.choice(own) for _ in range(rng.randint(0, 40))), rng.choice(["xx", "yy", None]), source))
    rows += [(None, "xx", "silent"), ("", "lonely", "one"), ("a b", "rare", "r1"), ("a b", "rare", "r2"), ("q " * 20_000, "yy", "long")]
    rows += [("same same", "yy", "copies")] * 50 + [("1 2 _ @[`{", "signs", "s"), ("x1y\x7fz", "yy", "hot")]
    assert result(divergence.audit(frame(spark, rows))) == brute(rows)


def hash_of(source):
    return sum(map(ord, source or "")) * 37


def test_top_and_least_docs(spark):
    rows = [(f"a b{'cdefgh'[i % 6]} x", "l", "st"[i % 2]) for i in range(40)]
    assert result(divergence.audit(frame(spark, rows), least_docs=7, top=1)) == brute(rows, 7, 1)


def test_empty_and_wordless(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert result(divergence.audit(frame(spark, [(None, "l", "a"), ("1 2", "l", "b")]))) == {("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)}


def test_shares_are_exact_for_huge_groups(spark):
    rng = random.Random(1)
    cases = [(n, total, kept) for total in (3, 10**6, 10**13, 9 * 10**15 - 10**6) for kept in (1, 7, 10**6)
             for n in (0, 1, total // 3, total - 1, rng.randrange(total))]
    want = [1 + 10**9 * (n + 1) // (total + kept) for n, total, kept in cases]
    n, total, kept = (np.array(x, np.int64) for x in zip(*cases, strict=True))
    assert divergence.shares(n, total + kept).tolist() == want
    df = spark.createDataFrame(cases, "n long, t long, k long")
    assert [r[0] for r in df.select(divergence.share(F.col("n"), F.col("t"), F.col("k"))).collect()] == want
