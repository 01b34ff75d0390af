"""The binding views of ``runlens.sources.bindings`` as SQL common table
expressions for the DuckDB oracle (tables are pre-registered views)."""

RUNS = """runs AS (
  SELECT 'run_' || CAST(o_custkey AS VARCHAR) AS run_name,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS epoch,
         o_totalprice AS metric, o_orderpriority AS alpha, o_orderstatus AS temperature, o_orderkey AS ord
  FROM orders)"""

STRATEGIES = """strategies AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'skip' WHEN 'R' THEN 'last' ELSE 'vanilla' END AS strategy,
         l_linenumber AS size, l_extendedprice AS metric, l_linestatus AS beta,
         l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax
  FROM lineitem)"""

VECTORS = """vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"""

PAIRS = VECTORS + """,
pairs AS (
  SELECT t.vec_id AS example_id, t.label AS t_label, t.vec AS t_vec, s.label AS s_label, s.vec AS s_vec
  FROM vectors t JOIN vectors s ON s.vec_id = t.vec_id + 1)"""

WORDS = r"""words AS (
  SELECT doc_id, lang, source, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents))"""

PATHS = """paths AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         '/models/' ||
         CASE WHEN l_discount = 0 THEN printf('tmp_L%d', l_linenumber)
              WHEN l_returnflag = 'A' THEN printf('pkd_skip_L%d_B%d', l_linenumber, CAST(pow(10, l_suppkey % 4) AS INTEGER))
              WHEN l_returnflag = 'R' THEN printf('pkd_last_L%d_B%d', l_linenumber, (l_suppkey % 4 + 1) * 250)
              ELSE printf('vanilla_L%d_A0p%d_T%d', l_linenumber, l_suppkey % 9 + 1, l_partkey % 20 + 1) END
         || '/checkpoint-' || CAST((l_orderkey % 4 + 1) * 1325 AS VARCHAR) AS path
  FROM lineitem)"""

ELEMS_SQL = """elems AS (SELECT vec_id, label, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, unnest(vec) AS v FROM vectors)"""
