"""The operators with Python tasks, against brute force on small frames."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import common, components, langid, oddsketch, packing, perplexity, pii, tokenfile, tokens, vafile
from runlens.llm.crf import Tagger

SYLLABLES = "an be ce do el fa go hi in jo ka lu mo ne or pa qu re si tu un va we xo ya zo".split()
DOCS = "doc_id long, text string, lang string, source string, _text string, Node int, p int, H string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(*(list(r) + [None] * (4 - len(r))), "t", 1, 2, "h", 0.5) for r in rows], DOCS)


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def words(rng, n):
    return " ".join(word(rng) for _ in range(n))


ODD = ["", None, " ", "\n\n", "  a  b \n\n c", "a<|endoftext|> b", "it's we'll  x", "tab\tsep , . x", "é́x", "日本語 テキスト。\n\n\nx ", "x,. y., z'",
       "12,3 4.5, ßa, Éa.", "de%%% êeux*** ouier### x&&&. (a b) c) «d» e… don' it's' a-b- c--, d_ e_* f!? g#1 h'' ÿ} été.) ß,,", "a\x85 b", "a \x1c b", "Σας ΟΔΟΣ, İx", "ab, ab ab.", ". , ,", "a　b", "y" * 100 + " " + "y" * 100 + ",", "a\nb, c\nb."]


# exact top-k

@pytest.mark.parametrize("block", [16, 10_000])
def test_top_k(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.standard_normal(8) / 3).round(3).tolist()) for i in range(150)]
    vectors += [(200 + i, [0.1] * 8) for i in range(40)]  # one common vector
    vectors += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, []), (None, [0.1] * 8),
                (20, vectors[20][1]), (500, [0.5] * 3), (501, [0.1] * 3), (520, [1e300] * 8), (521, [-1e300] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, id int, Q int")
    got = [tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, 20, block=block).collect()]

    def whole(v):
        return tuple(max(-vafile.WIDEST, min(vafile.WIDEST, math.floor(64 * x) if abs(x) < 1e300 else int(x))) for x in v)

    valid = [(i, whole(v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in {(i, v) for i, v in valid if i % 20 == 0}:
        score = lambda v: max(-vafile.LONGEST - 1, min(vafile.LONGEST, sum(a * b for a, b in zip(q, v, strict=True))))  # noqa: B023, E731
        best = sorted((-score(v), j) for j, v in valid if j != i and len(v) == len(q))[:20]
        want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [20000.0, 0.0]), (2, [30000.0, 0.0]), (20, [1e6, -3.0]), (3, [1e15, 2.0]), (4, [-1e15, 2.0]), (40, [1e14, 1e14])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, 2).orderBy("query_id", "rank").collect()]
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for i in (0, 20, 40):
        best = sorted((-min(vafile.LONGEST, sum(a * b for a, b in zip(whole[i], v, strict=True))), j) for j, v in whole.items() if j != i)[:2]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == want


def test_top_k_tasks_do_not_grow_with_pairs_of_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.integers(-40, 41, (2400, 6)), np.tile([[30, 30, 30, 30, 30, 30]], (300, 1))])  # many equal ones
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = vafile.top_k(df, F.lit(True), 3, block=16)  # 169 blocks, which all rows ask
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"partitioning\(asked[^)]*, (\d+)\)", plan)]
    assert dealt and max(dealt) < 169 * 169 // 10
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -10**9)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert got.keys() == set(range(len(vectors)))
    for q, rows in got.items():
        assert sorted(rows) == [(r + 1, v, scores[q, v]) for r, v in enumerate(best[q].tolist())], q


def test_top_k_in_either_precision():
    rng = np.random.default_rng(3)
    for top in (40, 400_000):  # sums that fit single precision, and that don't
        exact = rng.integers(-top, top + 1, (500, 9))
        ids, low, queries = np.sort(rng.integers(0, 300, 500)), exact.min(axis=0), exact[:300]
        width = np.maximum(-(-(exact.max(axis=0) - low + 1) // vafile.CELLS), 1)
        best = vafile.Best(300, 4)
        for first in range(0, 500, 50):
            own = slice(first, first + 50)
            vafile.search_block(queries, np.arange(300), np.arange(300), exact[own], vafile.approximate(exact[own], low, width), ids[own], low, width, best)
        for j, q in enumerate(queries):
            want = sorted((-int(s), i) for s, i in zip(exact @ q, ids.tolist(), strict=True) if i != j)[:4]
            assert list(zip((-best.scores[j]).tolist(), best.ids[j].tolist(), strict=True)) == want


def test_top_k_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(df, F.col("vec_id") % 20 == 0).count() == 0


# tokens, files, packing

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 9_000)
    monkeypatch.setattr(tokens, "TAILS", 9)
    encode, rng = tokens.Encoder(public_tokenizers.path(name)), random.Random(2)
    assert encode._direct is not None
    for text in ODD + [words(rng, 80) for _ in range(20)]:
        plain = encode._tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encode(text), encode.dtype).tolist() == plain, text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_of_a_group_look_a_part_up_once(name, monkeypatch):
    rng, asked = random.Random(5), []
    monkeypatch.setattr(tokens, "GROUP", 1)
    encode = tokens.Encoder(public_tokenizers.path(name))
    encode.cache = 2_000
    texts = [*ODD, *(words(rng, 60) + " ouier### xqz&&&." for _ in range(30)), *ODD, "x" * 9000, None, "end"]
    plain = [encode._tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, encode.dtype).tolist() for ids in tokens.encode_column(encode, pa.array(texts))] == plain
    assert encode._size <= encode.cache + 2 * (tokens.ENTRY + 9 * tokens.CACHED_CHARS)
    assert list(tokens.encode_column(encode, pa.array([], pa.string()))) == []
    # words behind a newline, too, without the whole tokenizer
    lines = [f"a\n{w}{signs} b" for w in (*tokens.PROBES, "don't", "x1") for signs in ("", ",", ".", "&&&")]
    plain = [encode._tokenizer.encode(t, add_special_tokens=False).ids for t in lines]
    assert [np.frombuffer(encode(t), encode.dtype).tolist() for t in lines] == plain
    assert encode._line is not None
    # words behind signs that are not kept, too
    learn = encode._learn
    monkeypatch.setattr(encode, "_learn", lambda missing: asked.extend(missing) or learn(missing))
    encode.all(["a haus### b", "c haus###", "haus### haus###"] * 50)
    assert collections.Counter(asked)["haus###"] == 1


def edge_documents(rng, n=60):
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(n)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    return rows + [(2000, words(rng, 9000)), (5, "again"), (5, "again"), (None, "no id"), (None, None)]


def ids_of(name, text):
    tk = tokens.encoder(public_tokenizers.path(name))._tokenizer
    return np.array([*tk.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)


def test_token_files(spark, tmp_path):
    rows = edge_documents(random.Random(3))
    index = tokenfile.write_token_files(frame(spark, rows), str(tmp_path / "f"), public_tokenizers.path("byte_bpe_50k.json"), length=64)
    got = sorted((tuple(r) for r in tokenfile.read_checksums(index).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = collections.Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ((i, ids_of("byte_bpe_50k.json", t)) for i, t in rows))
    assert collections.Counter((i, n, crc) for i, _, n, crc in got) == want
    # random access: sequences of one length, masked behind the end of the file's stream
    files = {}
    for r in index.collect():
        files[r.file] = max(files.get(r.file, 0), r.at + r.n_tokens)
    for path, size in files.items():
        reader = tokenfile.SequenceReader(path)
        last, mask = reader.sequence((size - 1) // 64)
        assert len(last) == 64 and mask.sum() == (size - 1) % 64 + 1
        assert np.array_equal(reader.sequence(0)[0][:min(64, size)], reader.read(0, min(64, size)))


def test_pack(spark):
    rows = edge_documents(random.Random(4)) + [(3000 + i, "one two three") for i in range(200)]  # a hot length
    got = packing.pack(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json"), 256, keep_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in rows:
        ids = ids_of("word_bpe_49k.json", text)
        cut = [(at, min(256, len(ids) - at), zlib.crc32(ids[at:at + 256].tobytes()), len(ids)) for at in range(0, len(ids), 256)]
        have = collections.Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i])
        assert not collections.Counter(cut) - have
    assert len(got) == sum(-(-len(ids_of("word_bpe_49k.json", t)) // 256) for _, t in rows)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sorted(sequences) == list(range(len(sequences)))


def test_pack_empty(spark, tmp_path):
    assert packing.pack(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    index = tokenfile.write_token_files(frame(spark, []), str(tmp_path / "f"), public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfile.read_checksums(index).count() == 0


def test_pack_fills_sequences_with_short_texts(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["the"] * rng.randint(0, 29)) or None) for i in range(4000)]
    for size in (256, 100):  # 100 is no power of two
        got = packing.pack(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json"), size).toPandas()
        used = got.groupby("sequence_id").length.sum()
        assert used.max() <= size and len(got) == len(rows)
        assert used.sum() > 0.98 * size * len(used)
    long = [(i, " ".join(["the"] * rng.randint(200, 999))) for i in range(300)]
    got = packing.pack(frame(spark, long), public_tokenizers.path("word_bpe_49k.json"), 700).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 700


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(5)
    sizes = np.unique(rng.integers(1, 129, 60))
    demand = rng.integers(1, 4000, len(sizes))
    plan = packing.patterns(sizes, demand, 128)
    assert np.array_equal(sum(c * n for c, n in plan), demand)
    assert all((c * sizes).sum() <= 128 for c, _ in plan)
    bound = sum(x for _, x in packing.column_generation(sizes, demand, 128))
    used = sum(n for _, n in plan)
    assert (sizes * demand).sum() / 128 <= bound + 1e-6 <= used + 1e-6 and used <= bound + len(sizes)
    value, counts = packing.knapsack(np.array([0.3, 0.5]), np.array([3, 5]), 11)
    assert (value, counts.tolist()) == (pytest.approx(1.1), [2, 1])


@pytest.mark.parametrize("draw", ["even", "skewed", "few"])
def test_planning_takes_seconds(draw):
    rng = np.random.default_rng(6)
    lengths = {"even": rng.integers(1, 4096, 100_000), "skewed": np.minimum(rng.lognormal(6, 1, 100_000).astype(int) + 1, 4095),
               "few": rng.integers(1, 4096, 900)}[draw]
    step = np.maximum(1, np.exp2(np.ceil(np.log2(lengths)) - 7)).astype(int)
    sizes, demand = np.unique(-(-lengths // step) * step, return_counts=True)
    assert len(sizes) > 250
    begun = time.process_time()
    plan = packing.patterns(sizes, demand, 4096, packing.GAP)
    assert time.process_time() - begun < 5
    assert np.array_equal(sum(c * n for c, n in plan), demand) and all((c * sizes).sum() <= 4096 for c, _ in plan)
    # few pieces leave some sequences of a pattern unfilled
    assert lengths.sum() > (0.95 if draw == "few" else 0.98) * 4096 * sum(n for _, n in plan)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_knapsack_against_all_fillings(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 30, size))
        value = rng.random(len(sizes)).round(2)
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, value, strict=True) if s <= c)])
        got, counts = packing.knapsack(value, sizes, 60)
        assert got == pytest.approx(best[60]) and counts @ sizes <= 60 and counts @ value == pytest.approx(got)


# near duplicates

def brute_components(rows, n, percent):
    def shingle_set(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        return frozenset(tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()

    sets = [shingle_set(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * min(len(a), len(sets[j])) < percent * max(len(a), len(sets[j])):
                continue  # the sizes alone rule it out
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    smallest = {}
    for p, (i, _) in zip(part, rows, strict=True):
        if i is not None:
            smallest[p] = min(smallest.get(p, i), i)
    return collections.Counter((i, len(s), smallest.get(p) if s else i, i == (smallest.get(p) if s else i)) for p, (i, _), s in zip(part, rows, sets, strict=True))


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 85, 2048), (5, 80, 16)])
def test_near_duplicates(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(oddsketch, "BLOCK", block)
    rng = random.Random(n)
    rows = [(i, words(rng, rng.randint(1, 80))) for i in range(80)]
    base = words(rng, 120).split()
    at = 100
    for _ in range(60):  # near copies of one text, most at the edge of the similarity
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word(rng)
        rows.append((at := at + 1, " ".join(copy)))
    chain = words(rng, 100).split()  # each like the next only
    for _ in range(12):
        rows.append((at := at + 1, " ".join(chain)))
        chain = chain[5:] + words(rng, 5).split()
    rows += [(at + 1 + i, "The SAME text, again and again.") for i in range(50)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "two words"), (404, "TWO  words"), (405, "two"), (None, base_text := " ".join(base)),
             (None, None), (3, rows[3][1]), (407, "x y " * 5_000)]
    got = collections.Counter(tuple(r) for r in oddsketch.near_duplicates(frame(spark, rows), n, percent).collect())
    assert base_text and got == brute_components(rows, n, percent)


def test_near_duplicates_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = collections.Counter(tuple(r) for r in oddsketch.near_duplicates(docs, 3, 85).collect())
    assert got == brute_components(rows, 3, 85)


def test_drop_near_duplicates(spark):
    rng = random.Random(9)
    a = words(rng, 50)
    df = frame(spark, [(4, a), (2, a), (2, a), (3, words(rng, 50)), (5, None)])
    left = oddsketch.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert oddsketch.drop_near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(60) if i % 20] + [("star", f"s{i}") for i in range(300)] + [("x", "x")]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["020"] == "001" and got["040"] == "021" and got["060"] == "041"
    assert {got[f"s{i}"] for i in range(300)} == {"s0"} and got["star"] == "s0"


def test_odd_sketch_tells_similarity():
    rng = np.random.default_rng(3)
    sign = oddsketch.Signature(0.85)
    for share in (0.5, 0.85, 0.95):
        a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        k = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 2000 - k, dtype=np.uint64)])
        x, y = (np.frombuffer(sign(s)[1], np.uint64) for s in (a, b))
        odd = int(np.bitwise_count(x ^ y).sum())
        differ = -oddsketch.BITS / 4 * math.log(1 - 2 * odd / oddsketch.BITS)
        assert abs(differ / sign.samples - (1 - share)) < 0.17
        assert (odd <= sign.most_odd) or share < 0.85


# quality

def test_base_counts():
    def brute(text):
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many = {x for x, k in collections.Counter(win).items() if k > 1}
        covered = {i + d for i, x in enumerate(win) if x in many for d in range(5)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)

    rng = random.Random(4)
    texts = ODD + ["a " * 9, "a a a a a a", "x\ny\nx\n \n\nx", "# * $%&|<>"] + [words(rng, 30) + "\n" + words(rng, 4) for _ in range(10)]
    texts += [" ".join(rng.choice("abc") for _ in range(60)) for _ in range(20)]
    for t in texts:
        assert perplexity.base_counts(t) == brute(t), t


class BruteModel:
    """The word model by its definition, on words as strings; "<" is the begin of a text."""

    def __init__(self, texts):
        triples = set()
        for t in texts:
            ws = ["<", "<", *t.split()]
            triples |= set(zip(ws, ws[1:], ws[2:], strict=False))
        self.c = collections.Counter((v, w) for _, v, w in triples)
        self.follow, self.left = collections.defaultdict(list), collections.Counter(w for _, w in self.c)
        for (v, _), n in self.c.items():
            self.follow[v].append(n)
        self.d, self.lower_d = (self.discounts(list(x.values())) for x in (self.c, self.left))

    @staticmethod
    def discounts(counts):
        n = [max(sum(x == i for x in counts), 1) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
        return [0.0, *(d if 0.01 < d < i else i / 2 for i, d in enumerate(raw, 1))]

    def lower(self, w):
        rest = sum(self.lower_d[min(n, 3)] for n in self.left.values())
        n = self.left[w]
        return (max(n - self.lower_d[min(n, 3)], 0) + rest / (len(self.left) + 1)) / len(self.c)

    def p(self, v, w):
        if not self.follow[v]:
            return self.lower(w)
        total, n = sum(self.follow[v]), self.c[v, w]
        return (max(n - self.d[min(n, 3)], 0) + sum(self.d[min(x, 3)] for x in self.follow[v]) * self.lower(w)) / total

    def surprise(self, text):
        ws = ["<", *text.split()]
        return -sum(math.log(self.p(v, w)) for v, w in zip(ws, ws[1:], strict=False)) / (len(ws) - 1)

    def tables(self, texts):
        """What the operator is given for ``texts``."""
        tag = np.array([7], np.uint64)
        begin = perplexity.word_ids(["x"], tag)[2][0]
        names = {"<": begin} | {w: perplexity.word_ids([w], tag)[3][0] for t in texts for w in t.split()}
        pairs = {p for t in texts for p in zip(["<", *t.split()], t.split(), strict=False) if self.c[p]}
        keys = perplexity.bigram_ids(*(np.array([names[p[i]] for p in pairs], np.uint64) for i in (0, 1)))
        rows = [[sum(f), *(sum(min(x, 3) == k for x in f) for k in (1, 2, 3)), self.left[w]] for w in names for f in [self.follow[w]]]
        totals = perplexity.Totals.of([sum(x == i for x in self.c.values()) for i in range(1, 5)], [sum(x == i for x in self.left.values()) for i in range(1, 5)],
                                      len(self.c), len(self.left))
        return {7: totals}, (keys, np.array([self.c[p] for p in pairs], np.int64)), (np.array(list(names.values()), np.uint64), np.array(rows, np.int64))


def surprises(model, texts):
    totals, pairs, rows = model.tables(texts)
    return perplexity.log_perplexities(texts, np.full(len(texts), 7, np.uint64), np.zeros(len(texts), bool), totals, pairs, rows)


def test_perplexity_equals_the_model_and_sums_to_one():
    rng = random.Random(5)
    common = [word(rng) for _ in range(40)]
    model = BruteModel([" ".join(rng.choice(common) for _ in range(rng.randint(1, 30))) for _ in range(60)])
    texts = [" ".join(rng.choice([*common, "neverseen", "zzz"]) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    assert surprises(model, texts) == pytest.approx([model.surprise(t) for t in texts])
    for v in [*list(model.left)[:8], "neverseen"]:
        follows = [*model.left, "qqunknown"]  # all words and one for the unknown
        both = np.exp(-2 * np.array(surprises(model, [f"{v} {w}" for w in follows])))
        assert both.sum() / math.exp(-surprises(model, [v])[0]) == pytest.approx(1)


def test_quality_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(40, 120)), "ab"[i % 2]) for i in range(300)]
    noise = "".join(chr(rng.randint(33, 126)) + (" " if k % 6 == 0 else "") for k in range(500))
    rows += [(900, noise, "a"), (901, " ".join(f"{w}***" for w in words(rng, 80).split()), "b"), (902, None, None), (903, "few words", "a"),
             (904, "a b c d e f g h i j " * 4, "a"), (905, words(rng, 60), None), (906, words(rng, 20_000), "a"), (None, words(rng, 50), "a")]
    got = {r.doc_id: r for r in perplexity.quality(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and not got[900].kept and not got[901].kept
    assert got[900].perplexity > got[900].upper_band and not got[900].base_failed
    assert [got[i].base_failed for i in (902, 903, 904)] == [True] * 3
    assert all(got[r[0]].kept for r in rows[:300]) and got[905].kept and got[906].kept
    assert perplexity.quality(frame(spark, [])).count() == 0


def test_quality_hears_word_order_in_any_script(spark):
    rng = random.Random(8)
    greek = [chr(0x3B1 + i) for i in range(17)]
    own = ["".join(rng.choice(greek) for _ in range(6)) for _ in range(400)]
    follow = {w: rng.sample(own, 4) for w in own}

    def prose(n):
        out = [rng.choice(own)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    rows = [(i, " ".join(prose(100)), "el") for i in range(300)]
    rows += [(900, " ".join("".join(rng.choice(greek) for _ in range(6)) for _ in range(100)), "el"), (901, " ".join(rng.choice(own) for _ in range(100)), "el"),
             (902, " ".join(w for w in prose(50) for _ in range(2)), "el")]
    got = {r.doc_id: r for r in perplexity.quality(frame(spark, rows)).collect()}
    assert all(got[i].kept or got[i].base_failed for i in range(300)) and sum(got[i].kept for i in range(300)) > 280
    assert not any(got[i].kept or got[i].base_failed for i in (900, 901, 902))
    assert len({r.upper_band for r in got.values()}) < 4


def test_quality_of_a_rare_length(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(60, 70)), "a") for i in range(300)]
    rows += [(900, " ".join("".join(rng.choice("bcdfghjklm") for _ in range(9)) for _ in range(2000)), "a"), (901, words(rng, 2000), "a")]
    # the same noise under other tags doesn't excuse it
    rows += [(1000 + i, " ".join("".join(rng.choice("bcdfghjklm") for _ in range(9)) for _ in range(60)), k) for i in range(40) for k in (None, "b")]
    got = {r.doc_id: r for r in perplexity.quality(frame(spark, rows)).collect()}
    assert not got[900].kept and not got[900].base_failed and got[901].kept


def test_quality_keeps_a_large_source_of_tables(spark):
    rng = random.Random(10)
    heads = [word(rng) for _ in range(60)]
    rows = [(i, words(rng, rng.randint(40, 120)), "a") for i in range(300)]
    rows += [(1000 + i, "\n".join(f"| {rng.choice(heads)} | {rng.choice(heads)} | {rng.choice(heads)} |" for _ in range(25)), "a") for i in range(100)]
    got = {r.doc_id: r for r in perplexity.quality(frame(spark, rows)).collect()}
    assert sum(got[r[0]].base_failed for r in rows) < 5
    assert all(got[r[0]].kept or got[r[0]].base_failed for r in rows)


# languages

def test_every_label_is_learned(spark):
    rng = random.Random(21)
    names = [f"l{i:02d}" for i in range(70)]
    own = {n: [chr(0x3400 + 40 * i + j) for j in range(12)] for i, n in enumerate(names)}
    rows = [(i, "".join(rng.choice(own[n]) for _ in range(60)), n) for i, n in enumerate(names * 12)]
    rows += [(10_000 + i, "".join(rng.choice(own["l00"]) for _ in range(60)), "l00") for i in range(300)]  # a frequent one
    got = langid.identify(frame(spark, rows)).where(langid.held_out(F.col("doc_id"))).collect()
    assert {r.lang_pred for r in got} == {r.lang for r in got} and len({r.lang for r in got}) == 70
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    rng = random.Random(22)
    rows = [(1, f"text {i % 4000}", "a") for i in range(9000)] + [(i, words(rng, 5), "b") for i in range(50)] + [(2, "the same", "c")] * 500
    seen = []
    monkeypatch.setattr(langid, "SAMPLE", 90)
    monkeypatch.setattr(langid, "fit", lambda data, idf: seen.extend(data) or langid.Model([], None, np.zeros(0), 1.0))
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2))
    langid.identify(frame(spark, rows)).count()
    assert collections.Counter(r[0] for r in seen) == {"a": 30, "b": min(30, sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(50))), "c": 1}


def test_languages(spark):
    rng = random.Random(7)
    own = {k: [word(rng) for _ in range(60)] for k in ("aa", "bb", "cc")}
    rows = [(i, " ".join(rng.choice(own[k]) for _ in range(rng.randint(3, 40))), k) for i, k in ((i, rng.choice(list(own))) for i in range(600))]
    rows += [(700, None, "aa"), (701, "123 ... 4", "bb"), (702, "", None), (703, rows[0][1], None), (None, rows[1][1], "cc"), (704, rows[2][1] * 3000, None)]
    out = langid.identify(frame(spark, rows))
    assert out.columns == [*(c for c in frame(spark, []).columns if c != "score"), "lang_pred", "score"]
    got = {r.doc_id: r for r in out.withColumn("held", langid.held_out(F.col("doc_id"))).collect()}
    for i in (700, 701, 702):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    held = [r for r in rows[:600] if got[r[0]].held]
    assert 100 < len(held) < 200 and all(got[r[0]].held == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows[:600])
    right = [got[r[0]].lang_pred == r[2] for r in held]
    assert np.mean(right) > 0.97
    assert abs(np.mean(right) - np.mean([got[r[0]].score for r in held])) < 0.1  # calibrated
    assert got[703].lang_pred == rows[0][2] and got[704].lang_pred == rows[2][2]
    # no label, no language
    assert [r.lang_pred for r in langid.identify(frame(spark, [(1, "abc", None)])).collect()] == ["und"]
    assert langid.identify(frame(spark, [])).count() == 0


def test_slots_of_chunks_are_those_of_the_text(monkeypatch):
    text = words(random.Random(1), 200)
    whole = np.sort(np.concatenate(list(langid.slots(text))))
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(langid.slots(text)))), whole)
    assert len(whole) == sum(len(text) - k for k in range(3))


def test_elastic_net_leaves_weights_at_zero():
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], np.array([i % 2, 5 + rng.integers(0, 50)]), np.array([0.5, 0.5])) for i in range(200)]
    model = langid.fit(rows, np.ones(langid.FEATURES))
    assert (model.table != 0).sum() < 120 and model.temperature > 0


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits)))
            if (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "email"
                    or kind == "card" and 14 <= len(digits) <= 19 and total % 10 == 0 or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@+- ()09é\n%25") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 100_000 + "@") == [] and pii.base_spans(None) == []


def test_crf_gradient():
    tagger, rng = Tagger(12, 5, width=3, hidden=4), np.random.default_rng(0)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    codes, tags = rng.integers(0, 12, (3, 7)), rng.integers(0, 5, (3, 7))
    _, grad = tagger._step(codes, tags)
    for k, p in tagger.p.items():
        at = tuple(rng.integers(0, d) for d in p.shape)
        p[at] += 1e-4
        up = tagger._step(codes, tags)[0]
        p[at] -= 2e-4
        assert (up - tagger._step(codes, tags)[0]) / 2e-4 == pytest.approx(grad[k][at], abs=2e-3)
        p[at] += 1e-4


def personal(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = "4" + d(14)
    card += next(c for c in "0123456789" if pii.luhn(card + c))
    return rng.choice([f"{word(rng)}.{d(2)}@mail{d(1)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card,
                       f"+1 ({d(3)}) {d(3)}-{d(4)}"])


def test_pii_on_documents(spark):
    rng = random.Random(3)
    rows = [(i, f"{words(rng, rng.randint(5, 60))} {personal(rng)} {words(rng, 8)}" if i % 2 else words(rng, 30)) for i in range(500)]
    rows += [(600 + i, f"{words(rng, 10)} version 2.0 of {rng.randint(1, 99)} {words(rng, 5)}") for i in range(60)]
    rows += [(700, None), (701, ""), (702, words(rng, 4000) + " a1.b@c.de " + words(rng, 4000)), (None, "x 1.2.3.4"), (1, rows[1][1]),
             (703, f"{words(rng, 12)} +1 (212) 555-0100 {words(rng, 12)} (212) 555-0199 {words(rng, 20)} joe.11 @ mail3.example.com {words(rng, 9)}")]
    df = frame(spark, rows)
    out = pii.find(df)
    assert out.columns == [*df.columns, "pii_spans"]
    got = [(r.doc_id, r.text, [(s.start, pii.KINDS.index(s.kind), s.end, s.base) for s in r.pii_spans], r.masked)
           for r in out.withColumn("masked", pii.mask(F.coalesce("text", F.lit("")), F.col("pii_spans"))).collect()]
    assert len(got) == len(rows)
    for i, text, spans, masked in got:
        assert [s[:3] for s in spans if s[3]] == plain_spans(text)
        more = [s for s in spans if not s[3]]
        assert not more or i == 703, (i, more)  # clean text is left alone
        assert not plain_spans(masked)
    last = next(g for g in got if g[0] == 703)
    assert {last[1][a:b] for a, _, b, base in last[2] if not base} & {"(212) 555-0199", "joe.11 @ mail3.example.com"}
    assert pii.find(frame(spark, [])).count() == 0
    assert [r.pii_spans for r in pii.find(frame(spark, [(1, "no digits"), (2, "5")])).collect()] == [[], []]


def test_windows_agree_at_their_edges():
    rng = random.Random(4)
    windows = []
    for _ in range(250):
        text = f"{words(rng, rng.randint(0, 6))} {personal(rng)} {words(rng, 4)}"
        windows.append((text[:pii.WINDOW], [s for s in pii.base_spans(text[:pii.WINDOW])]))
    tagger = pii.learn(windows)
    texts = [f"{'é' * k} {words(rng, k % 7)} {personal(rng)} {words(rng, 20)}" for k in range(0, 120)]
    found = pii.model_spans(texts, tagger)
    want = [plain_spans(t) for t in texts]
    hit = sum(set(w) <= set(f) for w, f in zip(want, found, strict=True))
    assert hit >= 0.9 * len(texts), hit
    again = Tagger.from_bytes(tagger.to_bytes())
    assert pii.model_spans(texts, again) == found


# the pipeline

def test_language_stage_on_foreign_and_wrongly_tagged_texts(spark, sf_dir):
    import corpus_pipeline as c
    rng = random.Random(31)
    foreign = ["και το να είναι δεν για με που από στο της του ένα αυτό θα μας ήταν έχει".split(),
               "ja on ei että hän mutta kuin tämä olla minä sinä voida tulla saada pitää ihminen vuosi päivä aika".split(),
               "się nie jest przez był które oraz także może została czy bardzo tylko już między według roku wszystkie".split()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    planted = [(90_000 + i, " ".join(rng.choice(foreign[i % 3]) for _ in range(120)), None, "planted", 0) for i in range(30)]
    long = [r for r in rows if r.lang and r.text and len(r.text.split()) > 60][:200]
    wrong = [(91_000 + i, r.text, "de" if r.lang != "de" else "fr", "wrong", 0) for i, r in enumerate(long[:8])]
    other = [(92_000, None, "en", "x", 0), (92_001, "", "en", "x", 0), (92_002, "12 34 ###", "en", "x", 0), (None, long[0].text, None, None, None)]
    table = docs.unionByName(spark.createDataFrame(planted + wrong + other, docs.schema)).withColumn("_words", F.lit(1)).withColumn("Score", F.lit("x"))
    out = c.language(spark, table, sf_dir)
    assert out.columns == list(c.COLUMNS)
    got = {r.doc_id: r for r in out.collect()}
    assert sum(i in got for i, *_ in planted) <= 2
    assert sum(got[91_000 + i].lang == r.lang for i, r in enumerate(long[:8]) if 91_000 + i in got) >= 4
    assert not {92_000, 92_001, 92_002} & set(got) and got[None].lang == long[0].lang
    assert sum(r.doc_id in got for r in long) >= 0.98 * len(long)


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    import corpus_pipeline as c
    rng = random.Random(32)
    a, b = words(rng, 80), words(rng, 80)
    rows = [(1, a, "en", "s", 5), (1, a, "en", "s", 5), (None, b, None, None, None), (2, b, "en", None, 1), (3, None, "en", "s", 0), (4, "", None, "s", 0),
            (5, "mail me at someone@example.com or +1 555 123 4567 " + words(rng, 60), "en", "s", 0), (6, words(rng, 20_000), "en", "long", 0)]
    rows += [(10 + i, words(rng, 50), "en", "s", 0) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for part in (rows, []):
        docs = spark.createDataFrame([(*r, "x", 1) for r in part], schema + ", Node string, _size int")
        for name, stage in c.STAGES:
            docs = stage(spark, docs, sf_dir)
            held = docs.collect()
            if name != c.STAGES[-1][0]:
                assert docs.columns == list(c.COLUMNS)
                docs = spark.createDataFrame(held, schema)
        assert bool(held) == bool(part)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES:
        docs = stage(spark, docs, sf_dir)
        kept[name] = docs.toPandas()
        if name != c.STAGES[-1][0]:
            assert docs.columns == list(c.COLUMNS)
            docs = spark.createDataFrame(kept[name], "doc_id long, text string, lang string, source string, n_chars long")
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    near = brute_components([(r.doc_id, r.text) for r in source if r.doc_id in set(kept["language"].doc_id)], 5, 80)
    assert sorted(kept["near_dedup"].doc_id) == sorted(k[0] for k in near if k[3])
    assert len(kept["mask_personal_data"]) == len(kept["near_dedup"])
    assert not any(plain_spans(t) for t in kept["mask_personal_data"].text)
    assert (kept["mask_personal_data"].text.str.len() == kept["mask_personal_data"].n_chars).all()
    copies = collections.Counter(kept["mix"].doc_id)
    assert set(copies) <= set(kept["near_dedup"].doc_id) and max(copies.values()) <= 3
    total = sum(len(ids_of("word_bpe_49k.json", t)) for t in kept["mix"].text)
    assert kept["pack"].length.sum() == total
    assert kept["pack"].groupby("sequence_id").length.sum().max() <= 4096
    assert c.run(spark, sf_dir).count() == len(kept["pack"])


def test_a_worker_keeps_no_encoder_of_the_pipeline(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame(spark, [(i, f"some words {i}, and others", "en", "s") for i in range(40)]).coalesce(1)

    size = lambda keep: sorted(r.length for r in packing.cut_pieces(docs, path, 4096, 2, "doc_id", "text", False, 1 << 20, keep).collect())
    assert size(True) == size(False)
    tokens.encoder(path, 1 << 20)
    tokens.forget(path)
    tokens.forget(path)
    assert path not in tokens._ENCODERS


def test_texts_travel_once(spark):
    docs = frame(spark, [(i, "ein Satz mit Worten" if i % 2 else "some words in a row", "de" if i % 2 else "en", "s") for i in range(60)])
    plan = langid.identify(docs)
    assert "__text" not in plan._jdf.queryExecution().optimizedPlan().toString()
    other = langid.identify(docs.withColumn("text", F.col("text").cast("binary")))
    assert sorted((r.doc_id, r.lang_pred) for r in plan.collect()) == sorted((r.doc_id, r.lang_pred) for r in other.collect())


def test_masked_texts_travel_once(spark):
    docs = frame(spark, [(i, f"{'some words ' * i}1.2.3.{i}" if i else None, "en", "s") for i in range(20)])
    plan = pii.find(docs)
    assert "__text" not in plan._jdf.queryExecution().optimizedPlan().toString()
    other = pii.find(docs.withColumn("text", F.col("text").cast("binary")))
    assert sorted((r.doc_id, str(r.pii_spans)) for r in plan.collect()) == sorted((r.doc_id, str(r.pii_spans)) for r in other.collect())


def test_slices_are_small_and_whole():
    rows = [{"a": "x" * (i % 50) * 100, "b": i} for i in range(1000)]
    batches = [pa.RecordBatch.from_pylist(rows), pa.RecordBatch.from_pylist(rows[:0], pa.schema([("a", pa.string()), ("b", pa.int64())])),
               pa.RecordBatch.from_pylist([{"a": "y" * 200_000, "b": 1}])]
    got = list(common.slices(batches, 100_000))
    assert [r for b in got for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert max(b.nbytes for b in got[:-1]) < 150_000


def test_packing_makes_no_rows_in_python(spark, monkeypatch):
    """Their workers would stay beside those of the encoding step."""
    docs = frame(spark, [(i, "some words " * (i + 1), "en", "s") for i in range(40)])
    path, sc = public_tokenizers.path("word_bpe_49k.json"), type(spark.sparkContext)
    monkeypatch.setattr(sc, "parallelize", lambda *a, **k: pytest.fail("rows of Python"))
    got = packing.pack(docs, path, 64, 2).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_emissions_keep_no_steps():
    """Scoring holds the outputs of its windows, not every gate of every step."""
    import tracemalloc

    tagger, codes = Tagger(64, 9), np.random.default_rng(1).integers(0, 64, (256, 96))
    x = tagger.p["embed"][codes]
    both = np.concatenate([tagger._run(x, "f")[0], tagger._run(x[:, ::-1], "b")[0][:, ::-1]], axis=2)
    tracemalloc.start()
    got = tagger.emissions(codes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, both @ tagger.p["out"] + tagger.p["out_b"])
    assert most < 26 << 20
