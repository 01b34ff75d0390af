"""The queries of this subpackage and their DuckDB SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import chat, divergence, langid, mixing, oddsketch, packing, pagetext, perplexity, pii, shards, spelling, tokenfile, vafile
from runlens.llm.common import materialise, word_count
from runlens.session import scratch_path
from runlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


#: Production parameters of the chat windows.
CHAT = {"max_tokens": 512, "history_turns": 2, "history_tokens": 128}
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op1_chat_windows", rf"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
), counted AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {chat.TURN_TOKENS} AS tokens,
    length(text) + len(regexp_extract_all(text, '<\\*\|')) + length(role) + length('{chat.START}') + 12 AS size,
    row_number() OVER w - 1 AS place
  FROM base WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) - tokens AS "before",
    min(CASE WHEN role = 'system' THEN place END) OVER (PARTITION BY conv_id) AS sys
  FROM counted
), roomy AS (
  SELECT *, greatest({CHAT["max_tokens"] - CHAT["history_tokens"]}
    - coalesce(max(CASE WHEN place = sys THEN tokens END) OVER (PARTITION BY conv_id), 0), {CHAT["max_tokens"] // 8}) AS room,
    max(CASE WHEN place = sys THEN size END) OVER (PARTITION BY conv_id) AS sys_size
  FROM summed
), cut AS (
  SELECT *, 2 * ("before" // room) + CASE WHEN "before" + tokens > ("before" // room + 1) * room THEN 1 ELSE 0 END AS win FROM roomy
), spans AS (
  SELECT conv_id, win, min(place) AS first, min("before") AS start, max(sys_size) AS sys_size,
    sum(size) AS own, count(*) FILTER (place = sys) AS has_sys
  FROM cut GROUP BY conv_id, win
), history AS (
  SELECT s.conv_id, s.win, sum(c.size) AS again FROM spans s JOIN cut c
    ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.place < s.first AND c.place >= s.first - {CHAT["history_turns"]}
    AND s.start - c."before" <= {CHAT["history_tokens"]} AND c.place IS DISTINCT FROM c.sys
  GROUP BY s.conv_id, s.win
), chars AS (
  SELECT s.conv_id, sum(s.own + coalesce(h.again, 0) + CASE WHEN s.has_sys = 0 THEN coalesce(s.sys_size, 0) ELSE 0 END) AS n
  FROM spans s LEFT JOIN history h ON h.conv_id IS NOT DISTINCT FROM s.conv_id AND h.win = s.win GROUP BY s.conv_id
), digests AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss
  FROM counted GROUP BY conv_id
)
SELECT d.conv_id, d.n_turns, d.turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(c.n AS BIGINT) AS formatted_chars
FROM digests d JOIN chars c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
""")
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{CONTROL}'), (-1L, 1L, 'assistant', '{CONTROL}') "
                        "AS t(conv_id, turn, role, text)")
    windows = chat.format_windows(conversations.unionByName(planted), **CHAT)
    said = F.transform(chat.read_turns(F.col("text"), F.col("repeated")),
                       lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = windows.select("conv_id", F.length("text").alias("chars"), F.struct(
        "window", said.alias("turns"), F.array_join(chat.read_loss(F.col("text"), F.col("loss_spans")), "").alias("loss")).alias("w"))
    # one digest over a conversation needs its windows in order in one place
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    turns = F.flatten(F.transform("ws", lambda w: w["turns"]))
    return whole.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


@query("op4_source_mix", r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), sources AS (
  SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
    sum(sum(size)) OVER () AS all_words
  FROM sized GROUP BY source
), clamps AS (
  SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][place % 3 + 1] AS weight, total * 3.0::DOUBLE AS clamp FROM sources
), levels AS (
  SELECT *, (all_words::DOUBLE - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY clamp / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM clamps
), lvl AS (
  SELECT arg_min(level, (clamp / weight, place)) AS level FROM levels WHERE level <= clamp / weight
), plan AS (
  SELECT source, total AS source_size, least(clamp, coalesce((SELECT level FROM lvl) * weight, clamp)) AS target FROM clamps
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM plan
), walked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size) AS upto,
    sum(s.size) OVER (PARTITION BY s.source, s.h, s.size) AS words
  FROM sized s JOIN passes p ON p.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND rest > 0 AND upto - words / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM walked
""")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # count the words of each text once; the operator then works on ids and sizes
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-docs")
    return mixing.mix_sources(sized, size_col="words").select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


@query("op10_stratified_shards")
def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.interleave(read_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tokenfile.write_token_files(read_table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"),
                                        public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_checksums(index)


@query("op9_cutting_stock")
def op9_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, end_id=2)


@query("op2_va_topk", r"""
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
""")
def op2_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


@query("op7_odd_sketches")
def op7_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


@query("op3_kneser_ney_bands")
def op3_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = perplexity.quality(read_table(spark, sf_dir, "documents"))
    return rated.select("doc_id", *perplexity.BASE, "base_failed", "kept", "perplexity", "lower_band", "upper_band")


@query("op5_ftrl_languages")
def op5_ftrl_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_lstm_crf_pii")
def op8_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("pii_spans")).alias("spans"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("op11_quadtree_divergence", rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), terms AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{UPPER.lower()}') AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), langs AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang
), seen AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(sum(s.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN seen s USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n, 1 + 1000000000 * (coalesce(s.n, 0) + 1) // (g.total + l.v) AS p,
    1 + 1000000000 * (k.n + 1) // (l.total + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f.value), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
""")
def op11_quadtree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@query("op12_letter_kd_variants", rf"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents
), counted AS (
  SELECT run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM runs WHERE length(run) >= 6 GROUP BY id, run
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(c // 256, crc.steps[xor(c, x) % 256 + 1])), 4294967295) AS h
  FROM counted, crc
), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM near GROUP BY word
), named AS (
  SELECT b.word, b.n_near, b.best_n, min(x.other) AS best FROM best b JOIN near x ON x.word = b.word AND x.other_n = b.best_n GROUP BY ALL
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 5 * w.n THEN b.best END AS form,
    CASE WHEN b.best_n >= 5 * w.n THEN b.best_n END AS form_n
  FROM words w LEFT JOIN named b ON b.word = w.word
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN roots r ON r.word = f.word
""")
def op12_letter_kd_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(read_table(spark, sf_dir, "documents"), delete_every=199))


@query("op13_max_subsequence_text")
def op13_max_subsequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
