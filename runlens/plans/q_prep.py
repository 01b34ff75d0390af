"""Queries for dataset preparation (P01-P20) over documents, labels, pages,
benchmark, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import prep as P
from runlens.operators.user import map_batches
from runlens.plans.registry import query
from runlens.plans.sql_views import WORDS
from runlens.sources import bindings as B
from runlens.sources.tables import read_table


def r6(c):
    return F.round(c, 6)


PYWS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
SEED = 42
VOCAB_SIZE = 5000
MAX_LENGTH = 128
CHUNK, STRIDE = 256, 128
BATCH = 8
SAMPLE_N = 50


@query("p01_drop_null_labels", """WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) AS n_total, count(*) FILTER (WHERE quality IS NOT NULL) AS n_kept,
  count(*) FILTER (WHERE quality IS NULL) AS n_dropped,
  round(count(*) FILTER (WHERE quality IS NULL) * CAST(100 AS DOUBLE) / count(*), 6) AS pct_dropped,
  count(*) FILTER (WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL
    AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL) AS n_kept_any
FROM j""")
def p01(spark, d):
    j = B.labelled(spark, d, "left")
    kept, report = P.drop_nulls(j, ["quality"])
    _, report_any = P.drop_nulls(j, None, "any")
    return report.select("n_total", "n_kept", "n_dropped", r6(F.col("pct_dropped")).alias("pct_dropped"),
                         report_any.select("n_kept").scalar().alias("n_kept_any"))


_LABEL_TEXT_SQL = """lt AS (SELECT event_id, CASE event_type
    WHEN 'view' THEN CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) || '.0'
    WHEN 'click' THEN printf('%.2f', value)
    WHEN 'error' THEN ' '
    WHEN 'signup' THEN NULL
    ELSE CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'abc' WHEN 1 THEN 'inf' ELSE '-2.5' END
  END AS label_text FROM events),
parsed AS (SELECT event_id, label_text,
  regexp_replace(regexp_replace(label_text, '^""" + PYWS + """+', ''), '""" + PYWS + """+$', '') AS s FROM lt),
parsed2 AS (SELECT *, TRY_CAST(s AS DOUBLE) AS dbl FROM parsed),
parsed3 AS (SELECT event_id, label_text,
  CASE WHEN label_text IS NULL THEN 'missing' WHEN s = '' THEN 'blank' WHEN dbl IS NULL THEN 'not_a_number'
       WHEN TRY_CAST(trunc(dbl) AS BIGINT) IS NULL THEN 'not_finite' END AS reason,
  TRY_CAST(trunc(dbl) AS BIGINT) AS lbl FROM parsed2),
labels_parsed AS (SELECT event_id, label_text, CASE WHEN reason IS NULL THEN lbl END AS label, reason FROM parsed3)"""


def _label_text(spark, d):
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    text = (F.when(F.col("event_type") == "view", F.concat((k % 5).cast("string"), F.lit(".0")))
            .when(F.col("event_type") == "click", F.format_string("%.2f", F.col("value")))
            .when(F.col("event_type") == "error", F.lit(" "))
            .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
            .otherwise(F.when(k % 3 == 0, "abc").when(k % 3 == 1, "inf").otherwise("-2.5")))
    return e.select("event_id", text.alias("label_text"))


@query("p02_label_parse", f"WITH {_LABEL_TEXT_SQL} SELECT event_id, label_text, label, reason FROM labels_parsed")
def p02(spark, d):
    return P.parse_labels(_label_text(spark, d), "label_text")


@query("p03_label_range", f"""WITH {_LABEL_TEXT_SQL}
SELECT count(*) AS n_rows, count(label) AS n_parsed, count(*) FILTER (WHERE label IS NOT NULL AND label NOT BETWEEN 0 AND 4) AS n_out_of_range,
  count(*) FILTER (WHERE label IS NOT NULL AND label NOT BETWEEN 0 AND 4) = 0 AS ok FROM labels_parsed""")
def p03(spark, d):
    return P.label_range_report(P.parse_labels(_label_text(spark, d), "label_text"))


@query("p04_text_normalize", f"""SELECT doc_id, regexp_replace(lower(regexp_replace(regexp_replace(coalesce(text, ''),
  '^{PYWS}+', ''), '{PYWS}+$', '')), '<[^<>]*>', '', 'g') AS clean FROM documents""")
def p04(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", T.normalize_text("text", tags="after").alias("clean"))


@query("p05_strip_tags", """SELECT page_id, regexp_replace(html, '<[^<>]*>', '', 'g') AS text,
  CAST(length(regexp_replace(html, '<[^<>]*>', '', 'g')) AS INTEGER) AS n_chars FROM pages""")
def p05(spark, d):
    p = read_table(spark, d, "pages").select("page_id", T.strip_tags("html").alias("text"))
    return p.withColumn("n_chars", F.length("text"))


@query("p06_standard_projection", """SELECT doc_id AS idx, text, lang AS language, source, CAST(n_chars AS INTEGER) AS n_chars FROM documents""")
def p06(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("idx"), "text", F.col("lang").alias("language"), "source",
                       F.col("n_chars").cast("int").alias("n_chars"))


_SPLIT_SQL = """lab AS (SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
cnt AS (SELECT quality, count(*) AS n FROM lab GROUP BY quality),
q1 AS (SELECT *, n * ceil(0.1 * sum(n) OVER ()) / sum(n) OVER () AS cont, ceil(0.1 * sum(n) OVER ()) AS ndraw FROM cnt),
q1b AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM q1),
q1c AS (SELECT quality, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, quality) <= ndraw - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS q_test FROM q1b),
q2 AS (SELECT *, n - q_test AS nr FROM q1c),
q2a AS (SELECT *, nr * ceil(0.1111 * sum(nr) OVER ()) / sum(nr) OVER () AS cont, ceil(0.1111 * sum(nr) OVER ()) AS ndraw FROM q2),
q2b AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM q2a),
quota AS (SELECT quality, q_test, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, quality) <= ndraw - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS q_dev FROM q2b),
ranked AS (SELECT lab.*, row_number() OVER (PARTITION BY lab.quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM lab),
splits AS (SELECT ranked.doc_id, ranked.quality, CASE WHEN r < q_test THEN 'test' WHEN r < q_test + q_dev THEN 'dev' ELSE 'train' END AS split
  FROM ranked JOIN quota ON ranked.quality = quota.quality)"""


def _splits(spark, d):
    lab = B.labelled(spark, d).select("doc_id", "quality")
    return P.stratified_split(lab, "quality", "doc_id", 0.1, 0.1111, seed=SEED)


@query("p08_stratified_split", f"WITH {_SPLIT_SQL} SELECT doc_id, quality, split FROM splits")
def p08(spark, d):
    return _splits(spark, d).select("doc_id", "quality", "split")


@query("p07_row_index", f"""WITH {_SPLIT_SQL}
SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS idx FROM splits""")
def p07(spark, d):
    return P.row_index(_splits(spark, d), ["split"], ["doc_id"], name="idx").select("doc_id", "split", "idx")


@query("p09_split_summary", f"""WITH {_SPLIT_SQL}
SELECT split, quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM splits GROUP BY split, quality""")
def p09(spark, d):
    s = P.split_summary(_splits(spark, d), "split", "quality")
    return s.select("split", "quality", "n", r6(F.col("share")).alias("share"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
SEEDS = list(range(1, 11))


@query("p10_grid_minus_done", """WITH grid AS (
  SELECT a AS alpha, t AS temperature, CAST(s AS INTEGER) AS seed
  FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) AS x(a),
       (VALUES ('F'), ('O'), ('P')) AS y(t), range(1, 11) AS z(s)),
done AS (SELECT DISTINCT o_orderpriority AS alpha, o_orderstatus AS temperature, CAST(year(o_orderdate) - 1994 AS INTEGER) AS seed FROM orders),
todo AS (SELECT * FROM grid WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.alpha = grid.alpha AND done.temperature = grid.temperature AND done.seed = grid.seed))
SELECT alpha, temperature, seed, CAST(row_number() OVER (ORDER BY alpha, temperature, seed) AS INTEGER) AS run_no,
  printf('run%d_%s_%s_s%d', row_number() OVER (ORDER BY alpha, temperature, seed), replace(alpha, ' ', ''), temperature, seed) AS run_name
FROM todo""")
def p10(spark, d):
    o = read_table(spark, d, "orders")
    done = o.select(F.col("o_orderpriority").alias("alpha"), F.col("o_orderstatus").alias("temperature"),
                    (F.year("o_orderdate") - 1994).cast("int").alias("seed"))
    g = P.grid_minus_done({"alpha": PRIORITIES, "temperature": STATUSES, "seed": SEEDS}, done)
    return g.withColumn("run_name", F.format_string("run%d_%s_%s_s%d", F.col("run_no"), F.replace(
        F.col("alpha"), F.lit(" "), F.lit("")), F.col("temperature"), F.col("seed")))


@query("p11_choice_explode", """SELECT b.item_id, CAST(d.doc_id % 5 AS INTEGER) AS choice, b.text AS context, d.text AS candidate
FROM benchmark b JOIN documents d ON d.doc_id // 5 = b.item_id WHERE d.text IS NOT NULL""")
def p11(spark, d):
    docs = read_table(spark, d, "documents").select(
        F.expr("doc_id div 5").alias("item_id"), (F.col("doc_id") % 5).cast("int").alias("c"), "text")
    bench = read_table(spark, d, "benchmark").select("item_id", F.col("text").alias("context"))
    return P.join_choices(bench, docs, "item_id", "context", "c", "text").select("item_id", "choice", "context", "candidate")


_VOCAB_SQL = f"""{WORDS},
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY freq DESC, word) + 1 AS INTEGER) AS word_id
  FROM (SELECT word, count(*) AS freq FROM words GROUP BY word) ORDER BY freq DESC, word LIMIT {VOCAB_SIZE})"""


@query("p12_fixed_length_encode", f"""WITH {_VOCAB_SQL},
tok AS (SELECT w.doc_id, w.pos, coalesce(v.word_id, 1) AS id FROM words w LEFT JOIN vocab v ON v.word = w.word WHERE w.pos < {MAX_LENGTH}),
agg AS (SELECT doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids FROM tok GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens,
  CASE WHEN n IS NULL THEN substr(repeat(',0', {MAX_LENGTH}), 2) WHEN n = {MAX_LENGTH} THEN ids ELSE ids || repeat(',0', {MAX_LENGTH} - n) END AS input_ids,
  CAST(coalesce(n, 0) AS INTEGER) AS mask_sum
FROM documents d LEFT JOIN agg ON d.doc_id = agg.doc_id""")
def p12(spark, d):
    vocab = P.vocabulary(P.word_frequencies(B.words(spark, d)), size=VOCAB_SIZE)
    docs = read_table(spark, d, "documents").select(
        "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(B.WORD_PATTERN), 0).alias("tokens"))
    enc = P.encode_fixed_length(docs, "tokens", vocab, MAX_LENGTH)
    return enc.select("doc_id", "n_tokens", F.array_join("input_ids", ",").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@query("p13_batch_pad", rf"""WITH x AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS INTEGER) AS n_tokens,
  (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch_id FROM documents)
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, n_tokens, max(n_tokens) OVER (PARTITION BY batch_id) AS padded_len FROM x""")
def p13(spark, d):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit(B.WORD_PATTERN), 0))
    docs = read_table(spark, d, "documents").select("doc_id", n.alias("_len"))  # tokenised once
    return P.batch_pad_lengths(docs, "doc_id", F.col("_len"), BATCH).select("doc_id", "batch_id", "n_tokens", "padded_len")


PAIR_LENGTH = 512
_PAIR_SQL = rf"""{_VOCAB_SQL},
pairs AS (SELECT b.item_id, CAST(d.doc_id % 5 AS INTEGER) AS choice, regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]{{2,}}') AS a,
  regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]{{2,}}') AS b, {PAIR_LENGTH - 3} AS room, {(PAIR_LENGTH - 3) // 2} AS half
  FROM benchmark b JOIN documents d ON d.doc_id // 5 = b.item_id),
sized AS (SELECT *, CASE WHEN len(a) + len(b) <= room THEN len(a) WHEN len(b) <= half THEN room - len(b)
  WHEN len(a) <= room - half THEN len(a) ELSE room - half END AS ka FROM pairs),
cut AS (SELECT item_id, choice, a[1:ka] AS a, b[1:CASE WHEN len(a) + len(b) <= room OR len(b) <= half THEN len(b) ELSE room - ka END] AS b FROM sized),
flat AS (SELECT item_id, choice, 0 AS side, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM cut
  UNION ALL SELECT item_id, choice, 1, unnest(b), generate_subscripts(b, 1) FROM cut),
ids AS (SELECT item_id, choice, string_agg(',' || coalesce(v.word_id, 1), '' ORDER BY pos) FILTER (side = 0) AS ia,
  string_agg(',' || coalesce(v.word_id, 1), '' ORDER BY pos) FILTER (side = 1) AS ib, count(*) AS n
  FROM flat f LEFT JOIN vocab v ON v.word = f.word GROUP BY item_id, choice),
enc AS (SELECT c.item_id, c.choice, coalesce(n, 0) + 3 AS n, '-1' || coalesce(ia, '') || ',-2' || coalesce(ib, '') || ',-2'
  || repeat(',0', CAST({PAIR_LENGTH} - 3 - coalesce(n, 0) AS BIGINT)) AS ids FROM cut c LEFT JOIN ids i ON i.item_id = c.item_id AND i.choice = c.choice)
"""


@query("p12_pair_encode", f"""WITH {_PAIR_SQL}
SELECT item_id, string_agg(ids, '|' ORDER BY choice) AS input_ids, string_agg(CAST(n AS VARCHAR), '|' ORDER BY choice) AS n_tokens
FROM enc GROUP BY item_id""")
def p12_pairs(spark, d):
    vocab = P.vocabulary(P.word_frequencies(B.words(spark, d)), size=VOCAB_SIZE)
    toks = lambda c: F.regexp_extract_all(F.lower(c), F.lit(B.WORD_PATTERN), 0)
    docs = read_table(spark, d, "documents").select(
        F.expr("doc_id div 5").alias("item_id"), (F.col("doc_id") % 5).cast("int").alias("choice"), toks("text").alias("b"))
    bench = read_table(spark, d, "benchmark").select("item_id", toks("text").alias("a"))
    enc = P.encode_pairs(bench.join(docs, "item_id"), ["item_id", "choice"], "a", "b", vocab, PAIR_LENGTH)
    enc = enc.select("item_id", "choice", F.struct(F.array_join("input_ids", ",").alias("ids"), F.col("n_tokens").alias("n")).alias("e"))
    five = P.regroup_choices(enc, "item_id", "choice", "e")  # back to one row per example
    return five.select("item_id", F.array_join(F.transform("choices", lambda e: e["ids"]), "|").alias("input_ids"),
                       F.array_join(F.transform("choices", lambda e: e["n"].cast("string")), "|").alias("n_tokens"))


@query("p13_padded_batches", f"""WITH {_VOCAB_SQL},
tok AS (SELECT w.doc_id, w.pos, coalesce(v.word_id, 1) AS id FROM words w LEFT JOIN vocab v ON v.word = w.word WHERE w.pos < {MAX_LENGTH}),
agg AS (SELECT doc_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids FROM tok GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens, coalesce(ids, '') AS ids,
  (row_number() OVER (ORDER BY d.doc_id) - 1) // {BATCH} AS batch_id FROM documents d LEFT JOIN agg ON agg.doc_id = d.doc_id),
p AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) AS padded_len FROM b)
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, n_tokens, padded_len, n_tokens AS mask_sum,
  CASE WHEN n_tokens = 0 THEN substr(repeat(',0', padded_len), 2) ELSE ids || repeat(',0', padded_len - n_tokens) END AS input_ids FROM p""")
def p13_padded(spark, d):
    vocab = P.vocabulary(P.word_frequencies(B.words(spark, d)), size=VOCAB_SIZE)
    docs = read_table(spark, d, "documents").select(
        "doc_id", F.slice(F.regexp_extract_all(F.lower("text"), F.lit(B.WORD_PATTERN), 0), 1, MAX_LENGTH).alias("tokens"))
    ids = P.token_ids(docs, ["doc_id"], F.col("tokens"), vocab, "ids")
    out = P.pad_batches(ids, "doc_id", "ids", BATCH)
    return out.select("doc_id", "batch_id", F.size("ids").alias("n_tokens"), "padded_len",
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                      F.array_join("input_ids", ",").alias("input_ids"))


@query("u01_user_map", "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Z]')) AS BIGINT) AS n_capitals FROM documents")
def u01(spark, d):
    def capitals(batch):
        return batch.assign(n_capitals=batch["text"].fillna("").str.count("[A-Z]").astype("int64"))[["doc_id", "n_capitals"]]

    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return map_batches(docs, capitals, "doc_id bigint, n_capitals bigint")


@query("p14_seeded_sample", f"""(SELECT doc_id, 'first' AS selection FROM documents ORDER BY doc_id LIMIT {SAMPLE_N})
UNION ALL (SELECT doc_id, 'random' FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {SAMPLE_N})""")
def p14(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id")
    first = docs.orderBy("doc_id").limit(SAMPLE_N).withColumn("selection", F.lit("first"))
    rnd = docs.orderBy(P.seeded_key("doc_id", SEED), "doc_id").limit(SAMPLE_N).withColumn("selection", F.lit("random"))
    return first.unionByName(rnd)


@query("p15_bow_counts", f"""WITH {_VOCAB_SQL}
SELECT w.doc_id, w.word, count(*) AS n FROM words w JOIN vocab v ON v.word = w.word GROUP BY w.doc_id, w.word""")
def p15(spark, d):
    counts = P.doc_word_counts(B.words(spark, d))
    return P.bag_of_words(counts, P.vocabulary(P.frequencies_from_counts(counts), size=VOCAB_SIZE))


@query("p16_sliding_chunks", rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents),
c AS (SELECT doc_id, w, CAST(unnest(range(0, 1 + CAST(ceil(greatest(len(w) - {CHUNK}, 0) / {STRIDE}) AS BIGINT))) AS INTEGER) AS chunk_no FROM t WHERE len(w) > 0)
SELECT doc_id, chunk_no, chunk_no * {STRIDE} AS start, CAST(len(w[chunk_no * {STRIDE} + 1 : chunk_no * {STRIDE} + {CHUNK}]) AS INTEGER) AS n_words,
  array_to_string(w[chunk_no * {STRIDE} + 1 : chunk_no * {STRIDE} + {CHUNK}], ' ') AS text FROM c""")
def p16(spark, d):
    docs = read_table(spark, d, "documents").select(
        "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(B.WORD_PATTERN), 0).alias("w"))
    return P.sliding_chunks(docs, "doc_id", "w", CHUNK, STRIDE)


# Per-dataset configuration: text column, label column, maximum tokens of the encoder (P12 applies it), class weight.
DATASETS = {
    "documents": ("text", "lang", 512, 1.0),
    "pages": ("html", None, 1024, 0.5),
    "benchmark": ("text", None, 256, 2.0),
}
_ID = {"documents": "doc_id", "pages": "page_id", "benchmark": "item_id"}


@query("p17_dataset_union", """SELECT 'documents' AS dataset, doc_id AS record_id, text, 512 AS max_length, lang AS label, CAST(1.0 AS DOUBLE) AS class_weight FROM documents
UNION ALL SELECT 'pages', page_id, html, 1024, NULL, CAST(0.5 AS DOUBLE) FROM pages
UNION ALL SELECT 'benchmark', item_id, text, 256, NULL, CAST(2.0 AS DOUBLE) FROM benchmark""")
def p17(spark, d):
    out = None
    for name, (text, label, max_length, weight) in DATASETS.items():
        t = read_table(spark, d, name)
        part = t.select(F.lit(name).alias("dataset"), F.col(_ID[name]).alias("record_id"),
                        F.col(text).alias("text"), F.lit(max_length).alias("max_length"),
                        (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
                        F.lit(weight).alias("class_weight"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p18_key_pairing", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def p18(spark, d):
    return B.labelled(spark, d).select("doc_id", "lang", "quality", "toxic")


@query("p19_run_name_codec", r"""WITH n AS (SELECT o_orderkey AS ord,
  printf('vanilla_L%d_A%s_T%d', [6, 4, 3, 2][o_orderkey % 4 + 1], replace(printf('%.1f', (o_orderkey % 9 + 1) / 10.0), '.', 'p'), o_custkey % 20 + 1) AS run_name
  FROM orders)
SELECT ord, run_name, split_part(run_name, '_', 1) AS family,
  TRY_CAST(regexp_extract(run_name, '_L([0-9]+)(_|$)', 1) AS INTEGER) AS layers,
  TRY_CAST(replace(regexp_extract(run_name, '_A([0-9p]+)(_|$)', 1), 'p', '.') AS DOUBLE) AS alpha,
  TRY_CAST(regexp_extract(run_name, '_T([0-9]+)(_|$)', 1) AS DOUBLE) AS temperature FROM n""")
def p19(spark, d):
    o = read_table(spark, d, "orders")
    layers = F.element_at(F.array(*[F.lit(x) for x in (6, 4, 3, 2)]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    alpha = (F.col("o_orderkey") % 9 + 1) / F.lit(10.0)
    named = o.select(F.col("o_orderkey").alias("ord"),
                     T.format_run_name(layers, alpha, F.col("o_custkey") % 20 + 1).alias("run_name"))
    parsed = T.parse_run_name("run_name")
    return named.select("ord", "run_name", *[parsed[k].alias(k) for k in ("family", "layers", "alpha", "temperature")])


@query("p20_round_defaults", """SELECT o_orderkey, round(o_totalprice / 7, 4) AS m1,
  round(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 3 END, CAST(0 AS DOUBLE)), 4) AS m2 FROM orders""")
def p20(spark, d):
    o = read_table(spark, d, "orders")
    m2 = F.coalesce(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 3), F.lit(0.0))
    return o.select("o_orderkey", F.round(F.col("o_totalprice") / 7, 4).alias("m1"), F.round(m2, 4).alias("m2"))
