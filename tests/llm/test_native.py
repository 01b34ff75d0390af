"""Chat windows, source mixing and stratified shards on small frames."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from runlens.llm import chat, mixing, shards
from runlens.llm.queries import ORACLE, QUERIES

CONV = "conv_id long, turn long, role string, text string, size int, tokens string, Window int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONV)


def read_back(windows):
    out = windows.withColumn("turns", chat.read_turns(F.col("text"), F.col("repeated"))).withColumn(
        "loss", chat.read_loss(F.col("text"), F.col("loss_spans")))
    return sorted(out.collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.window))


@pytest.mark.parametrize("budget", [(64, 0, 0), (64, 2, 24), (512, 3, 100)])
def test_chat_round_trip_and_budget(spark, budget):
    rng = random.Random(3)
    tricky = ["", None, "<|im_end|>", "<\\|x", "a<|im_start|>assistant\nb", "<\\\\|", "<", "\\", "\n\n", "é 日本"]
    rows = []
    for conv in (1, 2, None):
        for turn in range(40):
            text = rng.choice(tricky) if rng.random() < 0.4 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 30)))
            rows.append((conv, turn, ["user", "assistant", None, "to\\ol\nx"][rng.randint(0, 3)] if turn else "system", text))
    rows += [(5, None, "assistant", "same"), (5, None, "assistant", "same"), (6, 0, "user", "long " * 50_000), (6, 1, "assistant", "y")]
    n, history, tokens = budget
    got = read_back(chat.format_windows(conversations(spark, rows), n, history, tokens))
    for conv in (1, 2, None, 5, 6):
        # null turns first, then by turn, role, text
        want = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        mine = [w for w in got if w.conv_id == conv]
        assert [(t.role, t.text) for w in mine for t in w.turns] == [(r, x) for _, r, x in want]
        assert [x for w in mine for x in w.loss] == [x for _, r, x in want if r == "assistant"]
        system = next(((r, x) for _, r, x in want if r == "system"), None)
        for w in mine:
            assert w.n_turns - w.repeated == len(w.turns) and w.repeated <= history + 1
            own = sum(len(t.text.split()) + chat.TURN_TOKENS for t in w.turns)
            assert w.n_tokens <= n or len(w.turns) == 1 or own <= n // 8, (w.n_tokens, n)
            if system:
                assert w.text.startswith(f"{chat.START}system\n")


def test_chat_empty(spark):
    assert chat.format_windows(conversations(spark, [])).count() == 0


DOCS = "doc_id long, text string, source string, mix_size string, _key int, h string, total string, Rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "old", 7, "h", "t", 3) for r in rows], DOCS)


def brute_targets(sizes, max_epochs=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:  # clamp, share the excess again, until nothing is above its clamp
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > max_epochs * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: max_epochs * sizes[s] for s in over}
        left -= sum(max_epochs * sizes[s] for s in over)
        free -= over
    return target


def test_mix_targets_and_copies(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 12)), rng.choice(["hot"] * 6 + ["B", "a", "é", "￿", "\U0001f600", None])) for i in range(3000)]
    rows += [(None, None, "tiny"), (None, "a b", "tiny"), (7, "same row", "tiny"), (7, "same row", "tiny"), (9000, "x " * 50_000, "long"), (9001, None, "none")]
    df = frame(spark, rows)
    out = mixing.mix_sources(df)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "source", "_key", "h", "total", "Rank", *mixing.OUTPUT] and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert r.mix_size == len((r.text or "").split()) and 0 <= r.mix_copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_size * r.mix_copies
    target = brute_targets(sizes)
    largest = {s: max(r.mix_size for r in got if r.source == s) for s in sizes}
    for r in got:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s], s
    assert sorted(map(str, mixing.mix_sources(df.repartition(5)).collect())) == sorted(map(str, got))  # reruns agree
    mixed = mixing.repeat_rows(out)
    assert mixed.columns == ["doc_id", "text", "source", "_key", "h", "total", "Rank"]
    assert mixed.count() == sum(r.mix_copies for r in got)


def test_mix_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert [r.mix_target for r in mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_shards_follow_the_mixture(spark):
    import zlib
    rng = random.Random(6)
    rows = [(i, "é" * rng.randint(0, 9), "hot" if i % 3 else rng.choice(["b", "c", None])) for i in range(2400)]
    rows += [(None, None, None), (5, "same", "b"), (5, "same", "b"), (3000, "x" * 200_000, "b")]
    got = shards.interleave(frame(spark, rows), 24).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(24))
    assert {len(v) for v in by.values()} <= {len(rows) // 24, len(rows) // 24 + 1}
    for source in ("hot", "b", "c", None):
        share = sum(r[2] == source for r in rows) / 24
        assert all(abs(sum(r.source == source for r in v) - share) <= 2 for v in by.values())
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    again = shards.interleave(frame(spark, rows).repartition(3), 24).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shards.interleave(frame(spark, []), 24).count() == 0


def test_shards_rank_by_rank(spark):
    import zlib
    rng = random.Random(7)
    rows = [(i if i % 50 else None, "é" * rng.randint(0, 9), rng.choice(["hot"] * 5 + ["b", "", "é", None])) for i in range(1500)]
    sources, want = {}, []
    for i, text, source in rows:
        h = hashlib.md5(f"shard:{'' if i is None else i}".encode()).hexdigest()
        sources.setdefault(source, []).append((h, (i is not None, i or 0), zlib.crc32(text.encode()), len(text.encode()) + 8, i))
    for source, members in sources.items():
        for rank, (_, _, crc, size, i) in enumerate(sorted(members)):
            want.append(((2 * rank + 1) / (2 * len(members)), "n" if source is None else "v" + source, rank, i, size, crc))
    want = [(p, 24 * p // len(want), *w[3:]) for p, w in enumerate(sorted(want, key=lambda w: (w[0], w[1].encode(), w[2])))]
    got = sorted((r.position, r.shard, r.doc_id, r.size, r.text_crc32) for r in shards.interleave(frame(spark, rows), 24).collect())
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want] and [g[2] for g in got] == [w[2] for w in want]


def test_write_shards(spark, tmp_path):
    df = frame(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(50)])
    shards.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("_shard").distinct().count() == 4


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, sf_dir, name):
    from runlens.plans.compare import compare
    res = compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name])
    assert res["match"] and "type_mismatch" not in res, res


def test_digest_of_loss_matches(spark, sf_dir):
    row = QUERIES["op1_chat_windows"](spark, sf_dir).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
