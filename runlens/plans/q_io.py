"""Queries for sources and sinks (S01-S10) and the incremental ingest.

Each query writes into a fresh folder under the shared checkpoint location
(``spark.checkpoint.dir``) and returns the lazily re-read result, which the
oracle compares with the original table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators import runs as R
from runlens.plans import report as REP
from runlens.plans.registry import query
from runlens.plans.sql_views import PATHS, RUNS, STRATEGIES
from runlens.session import scratch_path
from runlens.sources import bindings as B
from runlens.sources import io as IO
from runlens.sources import results as RES
from runlens.sources.tables import read_table
from runlens.streaming.ingest import ingest_once

EVENT_COLS = ["event_id", "user_id", "event_type", "value", "props"]
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType())])


@query("s01_csv_scan", "SELECT event_id, user_id, event_type, value, props FROM events")
def s01(spark, d):
    path = scratch_path(spark, "s01-csv")
    IO.write_delimited(read_table(spark, d, "events").select(*EVENT_COLS), path)
    return IO.read_delimited(spark, path, EVENT_SCHEMA)


_SPLIT_OF = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END"


@query("s02_split_scan", f"""SELECT {_SPLIT_OF} AS split, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars,
  count(*) FILTER (WHERE lang = 'en') AS n_en FROM documents GROUP BY 1""")
def s02(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    path = scratch_path(spark, "s02-splits")
    IO.write_splits(docs.withColumn("split", F.expr(_SPLIT_OF)), path)
    out = IO.read_splits(spark, path)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("total_chars"),
                                    F.count_if(F.col("lang") == "en").alias("n_en"))


LOG_CHUNK = 256


def _trainer_states(spark, d):
    """Trainer-state documents derived from events: per (user, week)
    checkpoint, documents of at most LOG_CHUNK log entries (so no document
    grows with a hot user) with a heterogeneous log_history array (fields
    absent rather than null, like the JSON a trainer writes)."""
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    entry = F.struct(
        F.col("event_id").alias("step"),
        F.round(F.col("value") / 100, 2).alias("epoch"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "click", F.col("value") / 1000).alias("learning_rate"),
        F.when(F.col("event_type") == "view", k).alias("grad_norm"),
        F.when(F.col("event_type") == "error", F.col("value")).alias("eval_loss"))
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    return e.groupBy(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("run_name"),
                     ((week + 1) * 100).cast("int").alias("checkpoint_step"),
                     F.floor(F.col("event_id") / LOG_CHUNK).alias("part")) \
        .agg(F.collect_list(entry).alias("log_history"))


@query("s03_training_curves", """WITH e AS (SELECT *, 'user_' || CAST(user_id AS VARCHAR) AS run_name,
  CAST((floor((dayofmonth(ts) - 1) / 7) + 1) * 100 AS INTEGER) AS checkpoint_step FROM events),
last AS (SELECT run_name, max(checkpoint_step) AS s FROM e GROUP BY run_name)
SELECT e.run_name, event_id AS step, round(value / 100, 2) AS epoch, value AS loss,
  CASE WHEN event_type = 'click' THEN value / 1000 ELSE CAST(0 AS DOUBLE) END AS learning_rate,
  CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS grad_norm
FROM e JOIN last ON e.run_name = last.run_name AND e.checkpoint_step = last.s
WHERE event_type IN ('click', 'view', 'purchase')""")
def s03(spark, d):
    states = _trainer_states(spark, d)
    path = scratch_path(spark, "s03-states")
    states.write.json(path)  # JSON writer omits null fields
    schema = T.StructType([
        T.StructField("run_name", T.StringType()), T.StructField("checkpoint_step", T.IntegerType()),
        T.StructField("part", T.LongType()), T.StructField("log_history", T.ArrayType(T.StructType([
            T.StructField("step", T.LongType()), T.StructField("epoch", T.DoubleType()),
            T.StructField("loss", T.DoubleType()), T.StructField("learning_rate", T.DoubleType()),
            T.StructField("grad_norm", T.DoubleType()), T.StructField("eval_loss", T.DoubleType())])))])
    return IO.training_curves(spark.read.schema(schema).json(path))


@query("s04_json_column", """SELECT event_id,
  CAST(json_object('event_type', event_type, 'k', CAST(json_extract_string(props, '$.k') AS BIGINT), 'user_id', user_id) AS VARCHAR) AS hyperparameters,
  event_type AS event_type_rt, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_rt FROM events""")
def s04(spark, d):
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    hp = e.select("event_id", F.to_json(F.struct(F.col("event_type"), k.alias("k"), F.col("user_id")))
                  .alias("hyperparameters"))
    schema = "event_type string, k bigint, user_id bigint"
    parsed = hp.withColumn("_p", F.from_json("hyperparameters", schema))
    return parsed.select("event_id", "hyperparameters", F.col("_p.event_type").alias("event_type_rt"),
                         F.col("_p.k").alias("k_rt"))


@query("s05_checkpoint_catalog", rf"""WITH {PATHS},
p AS (SELECT *, regexp_extract(path, '^.*/(vanilla|pkd_skip|pkd_last)_L([0-9]+)(?:_A([0-9]+p[0-9]+)_T([0-9]+)|_B([0-9]+))/checkpoint-([0-9]+)$',
  ['strategy', 'layers', 'a', 't', 'b', 'step']) AS m FROM paths
  WHERE regexp_matches(path, '^.*/(vanilla|pkd_skip|pkd_last)_L([0-9]+)(?:_A([0-9]+p[0-9]+)_T([0-9]+)|_B([0-9]+))/checkpoint-([0-9]+)$'))
SELECT l_orderkey, l_linenumber, l_partkey, path, m.strategy AS strategy, TRY_CAST(m.layers AS INTEGER) AS layers,
  TRY_CAST(replace(nullif(m.a, ''), 'p', '.') AS DOUBLE) AS alpha, TRY_CAST(nullif(m.t, '') AS DOUBLE) AS temperature,
  TRY_CAST(nullif(m.b, '') AS DOUBLE) AS beta, TRY_CAST(m.step AS INTEGER) AS step,
  CAST(TRY_CAST(m.step AS INTEGER) // 1325 AS INTEGER) AS epoch FROM p""")
def s05(spark, d):
    return IO.checkpoint_catalog(B.checkpoint_paths(spark, d))[0]


@query("s05_catalog_rejects", rf"""WITH {PATHS}
SELECT * FROM paths WHERE NOT coalesce(regexp_matches(path, '^.*/(vanilla|pkd_skip|pkd_last)_L([0-9]+)(?:_A([0-9]+p[0-9]+)_T([0-9]+)|_B([0-9]+))/checkpoint-([0-9]+)$'), false)""")
def s05_rejects(spark, d):
    return IO.checkpoint_catalog(B.checkpoint_paths(spark, d))[1]


@query("s06_append_results", f"WITH {RUNS} SELECT run_name, epoch, metric, ord FROM runs")
def s06(spark, d):
    runs = B.runs(spark, d).select("run_name", "epoch", "metric", "ord")
    path = scratch_path(spark, "s06-results")
    RES.append_results(runs.where(F.col("epoch") % 2 == 1), path, ["run_name", "epoch"], ["ord"])
    RES.append_results(runs, path, ["run_name", "epoch"], ["ord"])   # only the even epochs are new
    RES.append_results(runs, path, ["run_name", "epoch"], ["ord"])   # a re-run appends nothing
    return RES.read_results(spark, path, runs.schema)


@query("s07_tsv_sink", """SELECT d.doc_id AS "index", d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def s07(spark, d):
    lab = B.labelled(spark, d).select(F.col("doc_id").alias("index"), "text", F.col("quality").alias("label"))
    path = scratch_path(spark, "s07-tsv")
    IO.write_delimited(lab, path, sep="\t")
    schema = T.StructType([T.StructField("index", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("label", T.IntegerType())])
    return IO.read_delimited(spark, path, schema, sep="\t", multi_line=True)  # texts have line breaks


@query("s08_example_documents", "SELECT conv_id, turn, role, text, CAST(length(text) AS INTEGER) AS n_chars FROM conversations")
def s08(spark, d):
    c = read_table(spark, d, "conversations").withColumn("n_chars", F.length("text"))
    path = scratch_path(spark, "s08-docs")
    IO.write_documents(c.select("role", "conv_id", "turn", "text", "n_chars"), path, "role")
    schema = "conv_id bigint, turn bigint, text string, n_chars int, role string"
    return spark.read.schema(schema).json(path).select("conv_id", "turn", "role", "text", "n_chars")


_LOSS = "metric / 4"  # the stand-in of a loss

_FMT4 = "printf('%.4f', round({}, 4))".format


@query("s09_report_lines", f"""WITH {RUNS},
lossy AS (SELECT *, {_LOSS} AS loss FROM runs),
best_run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY metric DESC, ord) AS rn FROM lossy) WHERE rn = 1),
best_epoch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY metric DESC, ord) AS rn FROM runs) WHERE rn = 1),
best AS (SELECT * FROM lossy ORDER BY metric DESC, ord LIMIT 1),
per_run AS (SELECT *, CAST(row_number() OVER (ORDER BY metric DESC, ord) AS INTEGER) AS o FROM best_run),
every AS (SELECT *, CAST(row_number() OVER (ORDER BY metric DESC, ord) AS INTEGER) AS o FROM runs),
final AS (SELECT * FROM runs WHERE epoch = (SELECT max(epoch) FROM runs)),
alphas AS (SELECT alpha, avg(metric) AS m FROM final GROUP BY alpha),
temps AS (SELECT temperature, avg(metric) AS m FROM final GROUP BY temperature),
r AS (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch DESC, ord DESC) AS rn FROM runs),
conv AS (SELECT a.run_name, b.metric AS prev, a.metric AS last, a.metric - b.metric AS delta, b.epoch AS prev_epoch, a.epoch AS last_epoch,
  CASE WHEN a.metric - b.metric > CAST(0.001 AS DOUBLE) THEN '{R.STATUS_IMPROVING}'
       WHEN abs(a.metric - b.metric) < CAST(0.001 AS DOUBLE) THEN '{R.STATUS_CONVERGED}' ELSE '{R.STATUS_OVERFITTING}' END AS status,
  CAST(row_number() OVER (ORDER BY a.run_name) AS INTEGER) AS o
  FROM r a JOIN r b ON a.run_name = b.run_name AND b.rn = 2 WHERE a.rn = 1),
convc AS (SELECT status, count(*) AS c FROM conv GROUP BY status)
SELECT 1 AS section_no, 'overview' AS section, 0 AS ord, printf('Total evaluations: %d', (SELECT count(*) FROM runs)) AS line
UNION ALL SELECT 1, 'overview', 1, printf('Runs: %d', (SELECT count(DISTINCT run_name) FROM runs))
UNION ALL SELECT 1, 'overview', 2, printf('Best metric: %s (%s, epoch %d, loss %s)', {_FMT4("metric")}, run_name, epoch, {_FMT4("loss")}) FROM best
UNION ALL SELECT 2, 'best_per_run', o, printf('%d. %s epoch %d: %s, loss %s', o, run_name, epoch, {_FMT4("metric")}, {_FMT4("loss")}) FROM per_run
UNION ALL SELECT 3, 'best_per_epoch', epoch, printf('epoch %d: %s alpha=%s temperature=%s: %s', epoch, run_name, alpha, temperature, {_FMT4("metric")}) FROM best_epoch
UNION ALL SELECT 4, 'alpha_effect', CAST(row_number() OVER (ORDER BY m DESC, alpha) AS INTEGER), printf('alpha=%s: %s', alpha, {_FMT4("m")}) FROM alphas
UNION ALL SELECT 5, 'temperature_effect', CAST(row_number() OVER (ORDER BY m DESC, temperature) AS INTEGER), printf('temperature=%s: %s', temperature, {_FMT4("m")}) FROM temps
UNION ALL SELECT 6, 'all_evaluations', o, printf('%d. %s epoch %d alpha=%s temperature=%s: %s', o, run_name, epoch, alpha, temperature, {_FMT4("metric")}) FROM every
UNION ALL SELECT 7, 'convergence', o, printf('%s: epoch %d %s -> epoch %d %s, change %s (%s)', run_name, prev_epoch, {_FMT4("prev")}, last_epoch, {_FMT4("last")},
  printf('%+.4f', round(delta, 4)), status) FROM conv
UNION ALL SELECT 8, 'convergence_summary', CAST(row_number() OVER (ORDER BY status) AS INTEGER), printf('%s: %d', status, c) FROM convc""")
def s09(spark, d):
    table, path = scratch_path(spark, "s09-runs"), scratch_path(spark, "s09-lines")
    B.runs(spark, d).withColumn("loss", F.expr(_LOSS)).write.parquet(table)  # the results table that a report reads
    REP.report_lines(spark.read.parquet(table)).write.parquet(path)  # computed once, for the report and for the result
    lines = spark.read.parquet(path)
    REP.write_report(lines, scratch_path(spark, "s09-report"))
    return lines


@query("s09_comparison_lines", f"""WITH {STRATEGIES},
rows AS (SELECT *, CAST(l_orderkey * 10 + size AS BIGINT) AS ord FROM strategies),
base AS (SELECT max(metric) AS base FROM rows WHERE strategy = 'vanilla' AND size = 6),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, size ORDER BY metric DESC, ord) AS rn FROM rows
  WHERE beta = 'F' AND strategy IN ('last', 'skip')) WHERE rn = 1),
sized AS (SELECT *, printf('size %d: %s (ord %d), vs baseline %s (%s%%)', size, {_FMT4("metric")}, ord, printf('%+.4f', round(metric - base, 4)),
  printf('%+.2f', round((metric - base) / base * 100, 2))) AS line FROM best, base),
betas AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY beta ORDER BY metric DESC, ord) AS rn FROM rows WHERE strategy = 'skip') WHERE rn = 1),
common AS (SELECT a.size, a.metric AS a, b.metric AS b, a.metric - b.metric AS diff,
  CASE WHEN a.metric > b.metric THEN 'LAST' WHEN a.metric < b.metric THEN 'SKIP' ELSE 'TIE' END AS winner
  FROM best a JOIN best b ON a.size = b.size AND a.strategy = 'last' AND b.strategy = 'skip'),
reach AS (SELECT min(size) AS s FROM best, base WHERE strategy = 'last' AND metric >= base)
SELECT 1 AS section_no, 'baseline' AS section, 0 AS ord, printf('vanilla size 6: %s', {_FMT4("base")}) AS line FROM base WHERE base IS NOT NULL
UNION ALL SELECT 2, 'best_last', -size, line FROM sized WHERE strategy = 'last'
UNION ALL SELECT 3, 'best_skip', -size, line FROM sized WHERE strategy = 'skip'
UNION ALL SELECT 4, 'best_per_beta', CAST(row_number() OVER (ORDER BY beta) AS INTEGER), printf('beta=%s: size %d: %s (ord %d)', beta, size, {_FMT4("metric")}, ord) FROM betas
UNION ALL SELECT 5, 'comparison', -size, printf('size %d: LAST %s, SKIP %s, difference %s (%s%%), winner %s', size, {_FMT4("a")}, {_FMT4("b")},
  printf('%+.4f', round(diff, 4)), printf('%+.2f', round(diff / b * 100, 2)), winner) FROM common
UNION ALL SELECT 6, 'findings', 0, printf('best LAST model: size %d (%s)', size, {_FMT4("metric")}) FROM (
  SELECT * FROM best WHERE strategy = 'last' ORDER BY metric DESC, size LIMIT 1)
UNION ALL SELECT 6, 'findings', 1, printf('wins: LAST %d, SKIP %d, ties %d', count(*) FILTER (WHERE winner = 'LAST'),
  count(*) FILTER (WHERE winner = 'SKIP'), count(*) FILTER (WHERE winner = 'TIE')) FROM common
UNION ALL SELECT 6, 'findings', 2, printf('smallest LAST size that reaches the baseline: %d (%s%% smaller)', s, printf('%.1f', (12 - s) / CAST(12 AS DOUBLE) * 100))
  FROM reach WHERE s IS NOT NULL""")
def s09_comparison(spark, d):
    rows = B.strategies(spark, d).withColumn("ord", F.col("l_orderkey") * 10 + F.col("size"))
    return REP.comparison_lines(rows, "last", "skip", "vanilla", 6, "F")


@query("s10_optional_union", "SELECT event_id, user_id, event_type, value FROM events")
def s10(spark, d):
    events = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    missing = IO.optional_source(spark, scratch_path(spark, "s10-missing"), events.schema)
    path = scratch_path(spark, "s10-present")
    events.where(F.col("event_type") == "error").write.parquet(path)
    present = IO.optional_source(spark, path, events.schema)
    return events.where(F.col("event_type") != "error").unionByName(missing).unionByName(present)


@query("t01_incremental_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def t01(spark, d):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    events = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    inbox, out, ckpt = (scratch_path(spark, n) for n in ("t01-inbox", "t01-table", "t01-checkpoint"))
    events.where(F.col("event_type") != "error").write.parquet(f"{inbox}/batch=1")
    ingest_once(spark, inbox, out, ckpt, schema, ["event_id"])
    # A later delivery repeats part of the first one and brings the rest.
    events.where(F.col("event_type").isin("error", "click")).write.parquet(f"{inbox}/batch=2")
    ingest_once(spark, inbox, out, ckpt, schema, ["event_id"])
    return RES.read_results(spark, out, schema)
