"""Queries on runs, near matches, contributions, attribution, causal paths, fixes and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.operators import (
    attribution as A,
    causal as G,
    contribution as B,
    fixes as X,
    fuzzy as Z,
    intercompany as I,
    mapping_checks as K,
    metrics as M,
    notebooks as N,
    outliers as O,
    parameters as Q,
    rollup as L,
    runs as R,
    schema_diff as S,
)
from tieout.operators.enrich import fold
from tieout.operators.metrics import as_report
from tieout.plans.investigate import Scopes, gap_evidence, investigate, scoped
from tieout.plans.investigate import component_findings as component_rows
from tieout.scale import pin
from tieout.sources import files, remote
from verification.check_queries import COVERAGE, IC, PAIRS, RAW_AMOUNT, SIDES, UNMAPPED, raw_amount
from verification.gap_queries import LINE, RULES, TOTAL_GAPS
from verification.registry import query
from verification.views import Views

# ---------------------------------------------------------------- sources


@query(
    f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id, CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS TIMESTAMP) END AS date,
      CASE WHEN l_linenumber <> 7 THEN year(l_shipdate) || 'Q' || quarter(l_shipdate) END AS period,
      CAST(l_partkey AS VARCHAR) AS account_code, CAST(l_suppkey AS VARCHAR) AS entity_code,
      round(CAST(coalesce(TRY_CAST({RAW_AMOUNT} AS DECIMAL(18,2)), 0) AS DOUBLE), 2) AS amount,
      l_returnflag = 'A' AS is_intercompany, false AS adjustment_flag, CAST(NULL AS VARCHAR) AS counterparty_entity,
      CAST(NULL AS VARCHAR) AS adjustment_type, 'USD' AS currency
    FROM lineitem
    """
)
def load_source(spark, folder):
    raw = Views(spark, folder).table("lineitem").select(
        F.col("l_orderkey").cast("string").alias(" Txn ID "),
        F.when(F.col("l_linenumber") == 7, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Posting Date"),
        F.col("l_partkey").cast("string").alias("GL Account"),
        F.col("l_suppkey").cast("string").alias("Company Code"),
        raw_amount().alias("Net Amount"),
        F.when(F.col("l_returnflag") == "A", "Yes").when(F.col("l_returnflag") == "N", "False").alias("Is Intercompany"),
    )
    return as_report(files.load_source(raw), "amount").withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    f"""
    , low AS (SELECT p_brand, p_name, lower(trim(CASE p_partkey % 5 WHEN 0 THEN 'Net Sales' WHEN 1 THEN ' OPEX other' ELSE p_type END)) AS t FROM part)
    SELECT p_brand AS source_account_code, p_name AS target_account_code, {RULES} AS metric_category FROM low
    """
)
def load_mapping(spark, folder):
    k = F.col("p_partkey") % 5
    raw = Views(spark, folder).table("part").select(
        F.col("p_brand").alias("From Account"), F.col("p_name").alias("To Account"),
        F.when(k == 0, "Net Sales").when(k == 1, " OPEX other").otherwise(F.col("p_type")).alias("Category"),
    )
    return files.load_mapping(raw)


@query(
    f"""
    SELECT l_returnflag AS metric, l_linestatus AS group_by, CAST(year(l_shipdate) AS VARCHAR) AS period,
      round(CAST(coalesce(TRY_CAST({RAW_AMOUNT} AS DECIMAL(18,2)), 0) AS DOUBLE), 2) AS amount FROM lineitem
    """
)
def load_target(spark, folder):
    raw = Views(spark, folder).table("lineitem").select(
        F.col("l_returnflag").alias("KPI"), F.col("l_linestatus").alias("Region"),
        F.year("l_shipdate").cast("string").alias("Fiscal Period"), raw_amount().alias("Reported Value"),
    )
    return as_report(files.load_target(raw), "amount")


@query("SELECT s_name AS entity_code, CAST(s_nationkey AS VARCHAR) AS region FROM supplier")
def load_hierarchy(spark, folder):
    raw = Views(spark, folder).table("supplier").select(
        F.col("s_name").alias("Legal Entity Code"), F.col("s_nationkey").cast("string").alias("Region")
    )
    return files.load_hierarchy(raw)


TURNOVER = """
, t AS (SELECT p_name || '/' || l_returnflag || '/' || l_linenumber AS account_code, sum(CAST(l_extendedprice * (CASE l_linestatus WHEN 'F' THEN 1 ELSE -1 END) AS DECIMAL(18,2))) AS total,
    count(*) AS n, sum(abs(CAST(l_extendedprice AS DECIMAL(18,2)))) AS turnover FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY turnover DESC, account_code) - 1 AS place FROM t),
top AS (SELECT * FROM ranked WHERE place < 500)
"""


def remote_rows(v: Views):
    rows = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice") * F.when(F.col("l_linestatus") == "F", 1).otherwise(-1)
    return rows.select(
        F.concat_ws("/", "p_name", "l_returnflag", F.col("l_linenumber").cast("string")).alias("account_code"), price.cast("decimal(18,2)").alias("amount")
    )


@query(TURNOVER + "SELECT account_code, round(CAST(total AS DOUBLE), 2) AS total_amount, n AS row_count FROM top")
def account_aggregates(spark, folder):
    return as_report(remote.account_aggregates(remote_rows(Views(spark, folder))), "total_amount")


@query(
    TURNOVER
    + """
    SELECT CAST(place AS VARCHAR) AS transaction_id, account_code, 'CONNECTOR' AS entity_code, round(CAST(total AS DOUBLE), 2) AS amount,
      n AS transaction_count, false AS is_intercompany, false AS adjustment_flag, 'USD' AS currency FROM ranked
    """
)
def aggregates_as_source(spark, folder):
    return as_report(remote.aggregates_as_source(remote_rows(Views(spark, folder))), "amount")


@query(
    """
    SELECT 'P' || user_id AS pipeline_id, CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'target' END AS side, event_type AS task_name,
      CASE WHEN event_id % 2 = 0 THEN date_trunc('millisecond', ts) ELSE CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) END AS end_time,
      CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE event_type END AS status, json_extract_string(props, '$.k') AS k,
      CASE WHEN event_id % 2 = 1 THEN value END AS high_watermark
    FROM events
    """
)
def run_history(spark, folder):
    e = Views(spark, folder).table("events").withColumn("pipeline_id", F.concat(F.lit("P"), F.col("user_id").cast("string")))
    first = e.filter(F.col("event_id") % 2 == 0).select(
        "pipeline_id", F.lit("source").alias("side"), F.col("event_type").alias("run_name"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("end_time"), F.col("props").alias("overriding_parameters"),
    )
    second = e.filter(F.col("event_id") % 2 == 1).select(
        "pipeline_id", F.lit("target").alias("side"), F.col("event_type").alias("pipelineName"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("runEnd"), F.col("event_type").alias("status"),
        F.col("props").alias("parameters"), F.col("value").cast("string").alias("watermark"),
    )
    runs = remote.all_runs(
        remote.run_history(first, {"task_name": "run_name", "end_time": "end_time", "parameters": "overriding_parameters"}, millis=True),
        remote.run_history(second, {"task_name": "pipelineName", "end_time": "runEnd", "status": "status", "parameters": "parameters", "high_watermark": "watermark"}),
    )
    return runs.select(
        "pipeline_id", "side", "task_name", F.col("end_time").cast("timestamp_ntz").alias("end_time"), "status", F.col("parameters")["k"].alias("k"), "high_watermark"
    )


# ---------------------------------------------------------------- runs

LATEST = """
, latest AS (SELECT *, count(*) OVER (PARTITION BY pipeline_id, side) AS task_count FROM run_log
  QUALIFY row_number() OVER (PARTITION BY pipeline_id, side
    ORDER BY lower(status) IN ('succeeded', 'success', 'completed') DESC, end_time DESC, task_name DESC, status DESC) = 1),
pairs AS (SELECT coalesce(s.pipeline_id, t.pipeline_id) AS pipeline_id, s.end_time AS s_ts, t.end_time AS t_ts, s.param_k AS s_k, t.param_k AS t_k,
    s.high_watermark AS s_w, t.high_watermark AS t_w
  FROM (SELECT * FROM latest WHERE side = 'source') s FULL JOIN (SELECT * FROM latest WHERE side = 'target') t ON s.pipeline_id = t.pipeline_id),
facts AS (SELECT pipeline_id, s_ts, t_ts, abs(CAST(floor(epoch(s_ts)) AS BIGINT) - CAST(floor(epoch(t_ts)) AS BIGINT)) AS apart,
    CASE WHEN s_k IS DISTINCT FROM t_k THEN 1 ELSE 0 END AS params, round(s_w - t_w, 4) AS water FROM pairs),
run_facts AS (SELECT *, coalesce(apart > 3600, false) AS late, coalesce(water <> 0, false) AS wet,
    round(least(0.5::DOUBLE + CASE WHEN s_ts IS NOT NULL AND t_ts IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0 END
      + CASE WHEN NOT coalesce(apart > 3600, false) AND params = 0 AND NOT coalesce(water <> 0, false) THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END, 1.0), 3) AS conf FROM facts)
"""


@query(
    LATEST
    + """
    SELECT pipeline_id, side, task_name, end_time AS last_run_ts, status AS last_run_status, param_k AS k, high_watermark, task_count FROM latest
    """
)
def latest_runs(spark, folder):
    rows = R.latest_runs(Views(spark, folder).run_log)
    return rows.withColumn("k", F.col("parameters")["k"]).withColumn("last_run_ts", F.col("last_run_ts").cast("timestamp_ntz")).drop("parameters")


@query(
    """
    SELECT pipeline_id, side, task_name, CAST(row_number() OVER (PARTITION BY pipeline_id, side ORDER BY end_time DESC, task_name DESC) AS INT) AS place
    FROM run_log QUALIFY place <= 10
    """
)
def recent_tasks(spark, folder):
    return R.recent_tasks(Views(spark, folder).run_log)


@query(
    LATEST
    + """
    SELECT pipeline_id, apart AS timestamp_diff_seconds, late AS timestamp_gap_flag, CAST(params AS BIGINT) AS parameter_diff_count,
      water AS watermark_gap, wet AS watermark_gap_flag, conf AS run_confidence FROM run_facts
    """
)
def run_checks(spark, folder):
    return R.run_checks(R.paired_runs(Views(spark, folder).run_log)).drop("source_ts", "target_ts")


@query(LATEST + "SELECT pipeline_id, 'k' AS parameter, s_k AS source_value, t_k AS target_value FROM pairs WHERE s_k IS DISTINCT FROM t_k")
def parameter_differences(spark, folder):
    return R.parameter_differences(R.paired_runs(Views(spark, folder).run_log))


# ---------------------------------------------------------------- near matches


def fuzzy_sql(left: str, right: str, score: int, category: str) -> str:
    """Scores all pairs by growing the common-subsequence table one character of the left text at a time."""
    words = lambda c: f"array_to_string(list_sort(string_split(regexp_replace(trim({c}), '\\s+', ' ', 'g'), ' ')), ' ')"
    return f"""
    , codes AS (SELECT DISTINCT account_code AS a, {words('account_code')} AS x FROM {left}
        WHERE account_code IS NOT NULL AND account_code NOT IN (SELECT source_account_code FROM {right})),
    known AS (SELECT source_account_code AS b, {words('source_account_code')} AS y, min({category}) AS cat FROM {right} GROUP BY 1),
    grow AS (
      SELECT a, b, cat, x, y, 0 AS i, list_transform(range(length(y) + 1), lambda q: 0) AS r FROM codes, known
        WHERE 200 * least(length(x), length(y)) >= {score} * (length(x) + length(y))
      UNION ALL
      SELECT a, b, cat, x, y, i + 1, [0] || list_transform(range(1, length(y) + 1), lambda j:
          list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k + 1], CASE WHEN substr(y, k, 1) = substr(x, i + 1, 1) THEN r[k] + 1 ELSE 0 END))))
      FROM grow WHERE i < length(x)),
    scored AS (SELECT a, b, cat, 200.0::DOUBLE * r[length(y) + 1] / (length(x) + length(y)) AS score FROM grow WHERE i = length(x)),
    best AS (SELECT * FROM scored WHERE score >= {score} QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
    """


BEST = "SELECT a AS source_code, b AS suggested_code, round(score, 1) AS score, cat AS suggested_category FROM best"


@query(fuzzy_sql("recon_source", "recon_mapping", 80, "metric_category") + BEST)
def fuzzy_accounts(spark, folder):
    v = Views(spark, folder)
    return Z.fuzzy_matches(v.source("account_code"), v.mapping)


@query(fuzzy_sql("odd_names", "name_mapping", 80, "metric_category") + BEST)
def fuzzy_names(spark, folder):
    v = Views(spark, folder)
    return Z.fuzzy_matches(v.odd_names, v.names)


@query(fuzzy_sql("odd_names", "name_mapping", 85, "metric_category") + BEST)
def fuzzy_names_by_characters(spark, folder):
    """The same search by shared segments of characters only, as for codes that need many deletions."""
    v = Views(spark, folder)
    return Z.fuzzy_matches(v.odd_names, v.names, 85, whole_deletions=-1)


@query()
def fuzzy_customers(spark, folder):
    """Every customer name with one zero dropped against all names, which differ only in their digits."""
    c = Views(spark, folder).table("customer")
    mapping = c.select(
        F.col("c_name").alias("source_account_code"), F.col("c_name").alias("target_account_code"), F.col("c_mktsegment").alias("metric_category")
    )
    return Z.fuzzy_matches(c.select(F.concat(F.substring("c_name", 1, 9), F.substring("c_name", 11, 20)).alias("account_code")), mapping)


# ---------------------------------------------------------------- contributions

ENTITY = ["entity_code"]
ENTITY_GAPS = """
, e_ours AS (SELECT entity_code, metric_category AS metric, sum(amount) AS v FROM recon_source JOIN recon_mapping ON account_code = source_account_code
  WHERE NOT is_intercompany GROUP BY ALL),
e_theirs AS (SELECT entity_code, metric, sum(amount) AS v FROM recon_grouped_target GROUP BY ALL),
e_gaps AS (SELECT entity_code, metric, coalesce(o.v, 0) - coalesce(t.v, 0) AS gap FROM e_ours o FULL JOIN e_theirs t USING (entity_code, metric)),
e_primary AS (SELECT entity_code, metric, CASE WHEN abs(gap) > 1000 THEN gap ELSE 0 END AS gap FROM e_gaps
  QUALIFY row_number() OVER (PARTITION BY entity_code ORDER BY
    CASE WHEN abs(gap) > 1000 AND contains(lower(metric), 'revenue') THEN 0 WHEN abs(gap) > 1000 THEN 1 ELSE 2 END,
    CASE WHEN abs(gap) > 1000 AND NOT contains(lower(metric), 'revenue') THEN -abs(gap) ELSE 0 END, metric) = 1)
"""


def entity_lines(v: Views, *columns: str):
    """Transactions summed over all that the checks tell apart, read once for everything that a query does with them."""
    return pin(fold(v.source(*dict.fromkeys(("entity_code", *LINE, *columns)))))


def entity_gaps(v: Views, source):
    ours = M.category_totals(source, v.mapping, by=ENTITY)
    return M.gaps(ours, M.target_metrics(v.grouped_target, ENTITY), ENTITY)


def entity_primary(v: Views, source):
    """One gap per entity, written once; ``source`` as made by ``entity_lines``."""
    primary = M.primary_metric(entity_gaps(v, source), ENTITY)
    return pin(primary.select("entity_code", F.col("primary_metric").alias("metric"), F.col("primary_gap").alias("gap")))


def entity_deltas(v: Views):
    """Amounts of all transactions, also of those without an order, which the gaps leave out."""
    return B.account_deltas(v.source("entity_code", "account_code", "amount"), ENTITY)


def scores_sql(order: str, excluded: str = "false") -> str:
    return f"""
    , d AS (SELECT entity_code, account_code, sum(amount) AS delta FROM recon_source WHERE NOT ({excluded}) GROUP BY 1, 2),
    cum AS (SELECT d.entity_code, account_code, delta, gap, sum(abs(delta)) OVER (PARTITION BY d.entity_code ORDER BY {order}
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM d JOIN e_primary p ON d.entity_code = p.entity_code WHERE abs(gap) >= 1),
    kept AS (SELECT *, CAST(c AS DOUBLE) / CAST(abs(gap) AS DOUBLE) AS share FROM cum WHERE CAST(c - abs(delta) AS DOUBLE) / CAST(abs(gap) AS DOUBLE) < 0.95)
    """


KEPT = """SELECT entity_code, account_code, round(CAST(delta AS DOUBLE), 2) AS delta, round(CAST(gap AS DOUBLE), 2) AS gap,
  round(CAST(delta AS DOUBLE) / CAST(gap AS DOUBLE) * 100, 2) AS contribution_pct, share AS cumulative_share FROM kept"""


@query(ENTITY_GAPS + scores_sql("abs(delta) DESC, account_code") + KEPT)
def contribution_scores(spark, folder):
    v = Views(spark, folder)
    rows = B.contribution_scores(entity_deltas(v), entity_primary(v, entity_lines(v)), ENTITY)
    return as_report(rows, "delta", "gap").drop("metric")


@query(
    ENTITY_GAPS
    + scores_sql("coalesce(CASE WHEN account_code = 'Brand#7' THEN 0 WHEN account_code = 'Brand#3' THEN 1 END, 99), abs(delta) DESC, account_code", "account_code = 'Brand#9'")
    + KEPT
)
def contribution_scores_with_priorities(spark, folder):
    v = Views(spark, folder)
    brand = F.col("p_brand")
    first = v.table("part").filter(brand.isin("Brand#7", "Brand#3")).select(brand.alias("account_code"), F.when(brand == "Brand#7", 0).otherwise(1).alias("rank"))
    excluded = v.table("part").filter(brand == "Brand#9").select(brand.alias("account_code"))
    return as_report(B.contribution_scores(entity_deltas(v), entity_primary(v, entity_lines(v)), ENTITY, excluded, first), "delta", "gap").drop("metric")


EXPLAINED = """
, explained AS (SELECT p.entity_code, p.gap, CASE WHEN abs(p.gap) < 1 THEN 1.0 ELSE round(least(coalesce(max(share), 0.0), 1.0), 4) END AS explained_share,
    abs(p.gap) < 1 OR coalesce(max(share), 0.0) >= 0.95 AS stopped_early
  FROM e_primary p LEFT JOIN kept k ON p.entity_code = k.entity_code GROUP BY p.entity_code, p.gap)
"""


@query(
    ENTITY_GAPS
    + scores_sql("abs(delta) DESC, account_code")
    + EXPLAINED
    + "SELECT entity_code, round(CAST(gap AS DOUBLE), 2) AS gap, CAST(explained_share AS DOUBLE) AS explained_share, stopped_early FROM explained"
)
def contribution_summary(spark, folder):
    v = Views(spark, folder)
    primary = entity_primary(v, entity_lines(v))
    scores = B.contribution_scores(entity_deltas(v), primary, ENTITY)
    return as_report(B.contribution_summary(scores, primary, ENTITY), "gap")


@query(
    TOTAL_GAPS
    + """
    , d AS (SELECT transaction_id AS account_code, sum(amount) AS delta FROM recon_source GROUP BY 1),
    cum AS (SELECT account_code, delta, gap, sum(abs(delta)) OVER (ORDER BY abs(delta) DESC, account_code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
      FROM d, (SELECT gap FROM gap_rows WHERE metric = 'Revenue'))
    SELECT account_code, round(CAST(delta AS DOUBLE), 2) AS delta, round(CAST(gap AS DOUBLE), 2) AS gap,
      round(CAST(delta AS DOUBLE) / CAST(gap AS DOUBLE) * 100, 2) AS contribution_pct, CAST(c AS DOUBLE) / CAST(abs(gap) AS DOUBLE) AS cumulative_share
    FROM cum WHERE CAST(c - abs(delta) AS DOUBLE) / CAST(abs(gap) AS DOUBLE) < 0.95
    """
)
def contribution_of_transactions(spark, folder):
    """One group with as many accounts as there are transactions, summed over several tasks."""
    v = Views(spark, folder)
    gap = M.gap_summary(v.source(*LINE), v.mapping, v.target).filter("metric = 'Revenue'").select("gap")
    deltas = B.account_deltas(v.source("transaction_id", "amount").withColumnRenamed("transaction_id", "account_code"))
    return as_report(B.contribution_scores(deltas, gap), "delta", "gap")


# ---------------------------------------------------------------- attribution

EVIDENCE = (
    ENTITY_GAPS
    + UNMAPPED
    + LATEST
    + f"""
, x_un AS (SELECT entity_code, count(*) AS n, sum(t) AS t FROM u GROUP BY 1),
x_cov AS (SELECT entity_code, {COVERAGE} GROUP BY entity_code),
x_ic AS (SELECT entity_code, count(*) AS n, sum(abs(t)) AS t FROM (SELECT entity_code, counterparty_entity, sum(amount) AS t FROM recon_source
    WHERE is_intercompany GROUP BY 1, 2) WHERE abs(t) > 0.01 GROUP BY 1),
x_adj AS (SELECT entity_code, sum(amount) AS t FROM recon_source WHERE adjustment_flag GROUP BY 1),
x_run AS (SELECT max(late OR params > 0 OR wet) AS found, round(avg(conf::DECIMAL(10,3)), 3) AS conf, max(late) AS late, max(params > 0) AS params, max(wet) AS wet FROM run_facts),
ev AS MATERIALIZED (SELECT p.entity_code, metric, round(CAST(gap AS DOUBLE), 2) AS g, coalesce(x_un.n, 0) > 0 AS has_un, coalesce(round(CAST(x_un.t AS DOUBLE), 2), 0.0) AS un,
    coalesce(x_ic.n, 0) > 0 AS has_ic, coalesce(round(CAST(x_ic.t AS DOUBLE), 2), 0.0) AS ic, coalesce(CAST(x_adj.t AS DOUBLE), 0.0) AS adj,
    coalesce(unmapped_ratio, 0.0) AS ratio, found, x_run.conf AS conf, late, params, wet,
    CASE WHEN gap < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s,
    round((1.0 - CASE WHEN coalesce(unmapped_ratio, 0.0) > 0.05 THEN 0.3 ELSE 0.0 END - 0.2)::DOUBLE, 3) AS dconf
  FROM e_primary p LEFT JOIN x_un USING (entity_code) LEFT JOIN x_cov USING (entity_code) LEFT JOIN x_ic USING (entity_code) LEFT JOIN x_adj USING (entity_code), x_run)
"""
)
CAP = "CASE WHEN abs({0}) > abs({1}) THEN {1} ELSE {0} END"
CHAIN = (
    EVIDENCE
    + f"""
, s1 AS MATERIALIZED (SELECT *, CASE WHEN has_un THEN {CAP.format('s * abs(un)', 'g')} END AS a1 FROM ev),
r1 AS MATERIALIZED (SELECT *, g - coalesce(a1, 0.0) AS l1 FROM s1),
s2 AS MATERIALIZED (SELECT *, CASE WHEN has_ic AND abs(l1) > 1 THEN {CAP.format('least(ic, abs(l1)) * s', 'l1')} END AS b2 FROM r1),
r2 AS MATERIALIZED (SELECT *, CASE WHEN abs(b2) > 1 THEN b2 END AS a2, l1 - coalesce(CASE WHEN abs(b2) > 1 THEN b2 END, 0.0) AS l2 FROM s2),
s3 AS MATERIALIZED (SELECT *, CASE WHEN found AND abs(l2) > 1 AND ((conf > 0.3 AND late) OR params OR wet) THEN s * abs(abs(l2) * least(conf * 0.5::DOUBLE, 0.3::DOUBLE)) END AS b3 FROM r2),
r3 AS MATERIALIZED (SELECT *, CASE WHEN abs(b3) > 1 THEN b3 END AS a3, l2 - coalesce(CASE WHEN abs(b3) > 1 THEN b3 END, 0.0) AS l3 FROM s3),
s4 AS MATERIALIZED (SELECT *, CASE WHEN abs(l3) > 1 AND ratio > 0.01 THEN s * abs(abs(l3) * least(ratio, 0.2::DOUBLE)) END AS b4 FROM r3),
r4 AS MATERIALIZED (SELECT *, CASE WHEN abs(b4) > 1 THEN b4 END AS a4, l3 - coalesce(CASE WHEN abs(b4) > 1 THEN b4 END, 0.0) AS l4 FROM s4),
r5 AS MATERIALIZED (SELECT *, CASE WHEN abs(l4) > 1 THEN l4 END AS a5 FROM r4),
r6 AS MATERIALIZED (SELECT *, g - (coalesce(CASE WHEN abs(round(a1, 2)) > 0.01 THEN round(a1, 2) END, 0.0) + coalesce(CASE WHEN abs(round(a2, 2)) > 0.01 THEN round(a2, 2) END, 0.0)
    + coalesce(CASE WHEN abs(round(a3, 2)) > 0.01 THEN round(a3, 2) END, 0.0) + coalesce(CASE WHEN abs(round(a4, 2)) > 0.01 THEN round(a4, 2) END, 0.0)
    + coalesce(CASE WHEN abs(round(a5, 2)) > 0.01 THEN round(a5, 2) END, 0.0)) AS rest FROM r5),
parts AS (
  SELECT entity_code, metric, g, 1 AS seq, 'Mapping Gap' AS category, a1 AS a, 0.95::DOUBLE AS confidence, 'add_mapping' AS fix_type, 'type1_code' AS check_type FROM r6
  UNION ALL SELECT entity_code, metric, g, 2, 'Intercompany Elimination', a2, 0.85, 'add_elimination', 'type1_code' FROM r6
  UNION ALL SELECT entity_code, metric, g, 3, 'Orchestration Timing', a3, round(conf, 3), 'fix_orchestration', 'type3_orchestration' FROM r6
  UNION ALL SELECT entity_code, metric, g, 4, 'Schema / Mapping Drift', a4, round(dconf, 3), 'add_mapping', 'type2_data' FROM r6
  UNION ALL SELECT entity_code, metric, g, 5, 'Manual Adjustment', a5, 0.65, 'add_adjustment', 'type1_code' FROM r6
  UNION ALL SELECT entity_code, metric, g, 6, 'Hierarchy Mismatch', 0.0, 0.80, 'fix_hierarchy', 'type2_data' FROM r6
  UNION ALL SELECT entity_code, metric, g, 8, 'Unexplained Residual', CASE WHEN abs(rest) > 0.01 THEN rest END, 0.0, NULL, NULL FROM r6),
components AS (SELECT entity_code, metric, g, seq, category, round(a, 2) AS amount, CASE WHEN g <> 0 THEN round(a / g * 100, 1) ELSE 0.0 END AS pct_of_gap,
    confidence, fix_type, check_type, CASE WHEN confidence >= 0.95::DOUBLE * 0.9 THEN 'High' WHEN confidence >= 0.95::DOUBLE * 0.65 THEN 'Medium' ELSE 'Low' END AS confidence_label
  FROM parts WHERE a IS NOT NULL)
"""
)
EVIDENCE_LINE = ("entity_code", "account_code", "amount", "is_intercompany", "counterparty_entity", "adjustment_flag")


def entity_evidence(v: Views, source=None, primary=None):
    """Evidence of every entity's primary gap."""
    source = entity_lines(v, *EVIDENCE_LINE) if source is None else source
    return gap_evidence(
        entity_primary(v, source) if primary is None else primary, source, v.mapping, ENTITY,
        run_checks=R.run_checks(R.paired_runs(v.run_log)),
        drift=S.schema_drift(v.inventory, "old", "new"),
        fuzzy=Z.fuzzy_matches(source, v.mapping),
        mismatches=L.region_mismatches(source, v.mapping, v.target, v.hierarchy),
    )


def entity_attribution(v: Views):
    return A.attribute(entity_evidence(v))


KEYS = ["entity_code", "metric"]


@query(CHAIN + "SELECT entity_code, metric, seq, category, amount, pct_of_gap, confidence, fix_type, check_type, confidence_label FROM components")
def attribution_components(spark, folder):
    return A.component_rows(entity_attribution(Views(spark, folder)), KEYS)


@query(
    CHAIN
    + """
    , z AS (SELECT entity_code, metric, any_value(g) AS g, sum(amount) FILTER (category <> 'Unexplained Residual' AND abs(amount) > 0.01) AS ex,
        sum(confidence * abs(amount)) FILTER (confidence > 0 AND abs(amount) > 0.01) AS wc, sum(abs(amount)) FILTER (confidence > 0 AND abs(amount) > 0.01) AS w,
        sum(abs(amount)) FILTER (abs(amount) > 0.01 AND fix_type IN ('add_mapping', 'add_elimination', 'fix_orchestration', 'fix_hierarchy')) AS fx
      FROM (SELECT * FROM components ORDER BY entity_code, seq) GROUP BY 1, 2)
    SELECT entity_code, metric, g AS total_gap, greatest(0.0, least(100.0, CASE WHEN g <> 0 THEN round((1 - abs(g - coalesce(ex, 0)) / abs(g)) * 100, 1) ELSE 100.0 END)) AS explained_pct,
      CASE WHEN w > 0 THEN round(wc / w * 100, 1) ELSE 0.0 END AS overall_confidence, CASE WHEN g <> 0 THEN round(coalesce(fx, 0) / abs(g) * 100, 1) ELSE 0.0 END AS auto_fixable_pct FROM z
    """
)
def attribution_summary(spark, folder):
    return A.attribution_summary(entity_attribution(Views(spark, folder)), KEYS)


@query(
    CHAIN
    + """
    SELECT entity_code, metric, seq, category, amount, round(sum(amount) OVER (PARTITION BY entity_code, metric ORDER BY seq), 2) AS running_total,
      CASE WHEN amount < 0 THEN 'negative' ELSE 'positive' END AS direction FROM components
    """
)
def waterfall(spark, folder):
    rows = A.component_rows(entity_attribution(Views(spark, folder)), KEYS)
    return A.waterfall(rows.select(*KEYS, "seq", "category", "amount"), KEYS)


@query(
    CHAIN
    + """
    SELECT entity_code, metric, category, abs(amount) AS amount, round(abs(amount) / sum(abs(amount)) OVER (PARTITION BY entity_code, metric ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS share FROM components WHERE abs(amount) > 0
    """
)
def cause_shares(spark, folder):
    rows = A.component_rows(entity_attribution(Views(spark, folder)), KEYS)
    return A.cause_shares(rows, KEYS)


@query(
    """
    , p AS (SELECT period, entity_code, counterparty_entity, sum(amount) AS t FROM recon_source WHERE is_intercompany GROUP BY 1, 2, 3),
    n AS (SELECT a.period, a.entity_code AS entity, a.counterparty_entity AS counterparty, a.t + coalesce(b.t, 0) AS net
      FROM p a LEFT JOIN p b ON a.period = b.period AND a.entity_code = b.counterparty_entity AND a.counterparty_entity = b.entity_code)
    SELECT period, entity, counterparty, round(CAST(net AS DOUBLE), 2) AS net_uneliminated,
      CAST(row_number() OVER (PARTITION BY period ORDER BY abs(net) DESC, entity, counterparty) AS INT) AS place
    FROM n WHERE abs(net) > 0.01 QUALIFY place <= 10
    """
)
def drill_down(spark, folder):
    found = I.intercompany_findings(Views(spark, folder).source("period", *IC), by=["period"])
    rows = A.drill_down(found, ["period"], [F.desc(F.abs("net_uneliminated")), F.col("entity"), F.col("counterparty")])
    return as_report(rows.select("period", "entity", "counterparty", "net_uneliminated", "place"), "net_uneliminated")


# ---------------------------------------------------------------- causal path

NODES = (
    EVIDENCE
    + """
, n AS (
  SELECT entity_code, metric, g, 1 AS o, 'manual_adj' AS node, abs(adj) AS d FROM ev
  UNION ALL SELECT entity_code, metric, g, 2, 'schema_version', abs(g) * ratio FROM ev
  UNION ALL SELECT entity_code, metric, g, 3, 'orchestration_timing', CASE WHEN late OR (found AND wet) THEN abs(g) * 0.10::DOUBLE ELSE 0.0 END FROM ev
  UNION ALL SELECT entity_code, metric, g, 4, 'ic_elimination', abs(ic) FROM ev
  UNION ALL SELECT entity_code, metric, g, 5, 'mapping_join', abs(un) FROM ev
  UNION ALL SELECT entity_code, metric, g, 6, 'source_data', 0.0 FROM ev),
m AS (SELECT *, CASE WHEN g <> 0 THEN abs(d) / abs(g) ELSE 0.0 END AS share FROM n),
w AS (SELECT *, min(CASE WHEN share >= 0.5 THEN o END) OVER (PARTITION BY entity_code, metric) AS stop FROM m)
"""
)


@query(NODES + "SELECT entity_code, metric, o AS ordinal, node, round(d, 2) AS delta, round(share, 4) AS contribution_pct FROM w WHERE g <> 0 AND (stop IS NULL OR o <= stop)")
def causal_paths(spark, folder):
    traced = G.trace(G.stage_deltas(entity_evidence(Views(spark, folder))))
    return G.path_rows(traced, KEYS)


@query(
    NODES
    + """
    SELECT entity_code, metric, CASE WHEN g = 0 THEN 'none' ELSE node END AS root_cause, CASE WHEN g = 0 THEN 0.0 ELSE round(share, 4) END AS root_share FROM w
    QUALIFY row_number() OVER (PARTITION BY entity_code, metric ORDER BY o = stop DESC NULLS LAST, round(share, 4) DESC, o) = 1
    """
)
def root_causes(spark, folder):
    traced = G.trace(G.stage_deltas(entity_evidence(Views(spark, folder))))
    return traced.select(*KEYS, "root_cause", "root_share")


GATE = (
    EVIDENCE
    + scores_sql("abs(delta) DESC, account_code")
    + EXPLAINED
    + """
, g1 AS (SELECT ev.entity_code, ev.metric, CAST(explained_share AS DOUBLE) AS explained_share, DCONF AS data_confidence, conf AS run_confidence,
    round(least(CAST(explained_share AS DOUBLE) * 0.55::DOUBLE + (DCONF) * 0.25::DOUBLE + conf * 0.20::DOUBLE, 1.0), 4) AS overall_confidence
  FROM ev JOIN explained ON ev.entity_code = explained.entity_code)
SELECT *, overall_confidence < 0.8 AS needs_review FROM g1
"""
)


@query(GATE.replace("DCONF", "dconf"))
def confidence_gate(spark, folder):
    v = Views(spark, folder)
    source = entity_lines(v, *EVIDENCE_LINE)
    primary = entity_primary(v, source)
    evidence = entity_evidence(v, source, primary)
    scores = B.contribution_scores(entity_deltas(v), primary, ENTITY)
    explained = B.contribution_summary(scores, primary, ENTITY).select(F.col("entity_code").alias("e"), "explained_share")
    rows = G.confidence_gate(evidence.join(explained, F.col("entity_code") == F.col("e")))
    return rows.select(*KEYS, "explained_share", "data_confidence", "run_confidence", "overall_confidence", "needs_review")


@query(GATE.replace("DCONF", "dconf"))
def investigation(spark, folder):
    """The whole investigation per entity; a check for near matches that is not run takes nothing off."""
    v = Views(spark, folder)
    found = investigate(
        v.source(*EVIDENCE_LINE), v.mapping, v.grouped_target, by=ENTITY, run_log=v.run_log, drift=S.schema_drift(v.inventory, "old", "new"),
    )
    return found.gate


# ---------------------------------------------------------------- evidence per group


@query(
    """
    , weeks AS (SELECT DISTINCT date_trunc('week', end_time)::TIMESTAMP AS b FROM timed_runs)
    SELECT strftime(b, '%Y-%m-%d') AS period, count(*) AS run_count, count(DISTINCT pipeline_id) AS feed_count, count(*) FILTER (begun < b) AS begun_before
    FROM weeks JOIN timed_runs ON begun < b + INTERVAL 7 DAY AND end_time >= b GROUP BY 1
    """
)
def runs_by_period(spark, folder):
    """Runs of up to three days with the weeks that they overlap."""
    log = Views(spark, folder).timed_runs
    weeks = log.select(F.date_trunc("week", "end_time").alias("period_start")).distinct()
    weeks = weeks.select(F.date_format("period_start", "yyyy-MM-dd").alias("period"), "period_start", (F.col("period_start") + F.expr("INTERVAL 7 DAYS")).alias("period_end"))
    before = F.count_if(F.col("start_time") < F.to_timestamp("period"))
    return R.in_periods(log, weeks).groupBy("period").agg(F.count(F.lit(1)).alias("run_count"), F.count_distinct("pipeline_id").alias("feed_count"), before.alias("begun_before"))


@query(
    """
    WITH e AS (SELECT event_id, user_id AS u, event_id % 5 = 0 AS changed, event_id % 7 = 0 AS added, event_id % 11 = 0 AS dropped FROM events)
    SELECT event_id, 'window.days[1]' AS parameter, '2' AS source_value, '3.5' AS target_value FROM e WHERE changed
    UNION ALL SELECT event_id, 'window.mode.name', NULL, '"' || u || '"' FROM e WHERE added
    UNION ALL SELECT event_id, 'user', u::VARCHAR, NULL FROM e WHERE dropped
    UNION ALL SELECT event_id, 'window.mode', '{}', NULL FROM e WHERE added
    """,
    raw=True,
)
def nested_parameters(spark, folder):
    """Parameters of both sides of every event, with other orders of fields, other spellings of numbers, and some real differences."""
    e = Views(spark, folder).table("events")
    u, n = F.col("user_id").cast("string"), F.col("event_id")
    ours = F.concat(F.lit('{"user": '), u, F.lit(', "window": {"days": [1, 2], "mode": {}}, "rate": 1.0, "none": null}'))
    user = F.when(n % 11 == 0, "").otherwise(F.concat(F.lit('"user": '), u, F.lit(".0, ")))
    mode = F.when(n % 7 == 0, F.concat(F.lit('{"name": "'), u, F.lit('"}'))).otherwise("{}")
    theirs = F.concat(F.lit('{"none": null, "rate": 1, '), user, F.lit('"window": {"mode": '), mode, F.lit(', "days": [1e0, '), F.when(n % 5 == 0, "3.50").otherwise("2.0"), F.lit("]}}"))
    return Q.nested_differences(e.select("event_id", ours.alias("source_parameters"), theirs.alias("target_parameters")), ["event_id"])


RUNS_BY_FEED = """
, x_run AS (SELECT entity_code, max(late OR params > 0 OR wet) AS found, round(avg(conf::DECIMAL(10,3)), 3) AS conf, max(late) AS late, max(params > 0) AS params, max(wet) AS wet
  FROM run_facts JOIN feeds USING (pipeline_id) GROUP BY 1)"""
DRIFT_BY_TABLE = """
, x_drift AS (SELECT entity_code, max(old_type IS NULL OR new_type IS NULL OR old_type <> new_type) AS drifted FROM sides JOIN fed_tables USING (table_name) GROUP BY 1)
"""


def by_feed(text: str) -> str:
    """The evidence with runs and drift of each entity in place of one value for all."""
    start = text.index("x_run AS (")
    end = text.index("ev AS MATERIALIZED")
    text = text[:start] + RUNS_BY_FEED.strip(", \n") + SIDES.rstrip() + DRIFT_BY_TABLE.rstrip() + ",\n" + text[end:]
    for old, new in (
        ("found, x_run.conf AS conf, late, params, wet,", "coalesce(found, false) AS found, coalesce(x_run.conf, 0.5::DOUBLE) AS conf, coalesce(late, false) AS late, coalesce(params, false) AS params, coalesce(wet, false) AS wet,"),
        ("ELSE 0.0 END - 0.2)::DOUBLE", "ELSE 0.0 END - CASE WHEN coalesce(drifted, false) THEN 0.2 ELSE 0.0 END)::DOUBLE"),
        ("LEFT JOIN x_adj USING (entity_code), x_run)", "LEFT JOIN x_adj USING (entity_code) LEFT JOIN x_run USING (entity_code) LEFT JOIN x_drift USING (entity_code))"),
    ):
        assert text.count(old) == 1, old
        text = text.replace(old, new)
    return text


@query(by_feed(GATE.replace("DCONF", "dconf")))
def investigation_by_feed(spark, folder):
    """The whole investigation per entity; runs and drift count for the entities that their feeds and tables serve."""
    v = Views(spark, folder)
    found = investigate(
        v.source(*EVIDENCE_LINE), v.mapping, v.grouped_target, by=ENTITY, run_log=v.run_log, drift=S.schema_drift(v.inventory, "old", "new"),
        scopes=Scopes(feeds=v.feeds, tables=v.fed_tables),
    )
    return found.gate


@query(
    ENTITY_GAPS
    + LATEST
    + RUNS_BY_FEED
    + SIDES
    + DRIFT_BY_TABLE
    + fuzzy_sql("recon_source", "recon_mapping", 80, "metric_category")
    + """
    , have AS (SELECT DISTINCT entity_code, account_code FROM recon_source),
    x_fuzzy AS (SELECT DISTINCT entity_code, true AS matched FROM best JOIN have ON a = account_code),
    x_odd AS (SELECT entity_code, count(*)::INTEGER AS n FROM have WHERE account_code IN ('Brand#4', 'Brand#8', 'Brand#12') GROUP BY 1),
    x_apart AS (SELECT DISTINCT n_name AS entity_code, true AS apart FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%')
    SELECT entity_code, coalesce(found, false) AS has_run_findings, coalesce(conf, 0.5::DOUBLE) AS run_confidence, coalesce(late, false) AS timestamp_gap_flag,
      coalesce(params, false) AS has_parameter_diffs, coalesce(wet, false) AS watermark_gap_flag, coalesce(drifted, false) AS has_schema_drift,
      coalesce(matched, false) AS has_fuzzy_match, coalesce(apart, false) AS has_region_mismatch, coalesce(n, 0)::INTEGER AS anomalous_count
    FROM e_primary LEFT JOIN x_run USING (entity_code) LEFT JOIN x_drift USING (entity_code) LEFT JOIN x_fuzzy USING (entity_code)
      LEFT JOIN x_odd USING (entity_code) LEFT JOIN x_apart USING (entity_code)
    """
)
def evidence_by_group(spark, folder):
    """Evidence of every entity from its own feeds, tables, accounts and region."""
    v = Views(spark, folder)
    source = entity_lines(v, *EVIDENCE_LINE)
    scopes = Scopes(feeds=v.feeds, tables=v.fed_tables, regions=v.places.select(F.col("r_name").alias("region"), F.col("n_name").alias("entity_code")))
    odd = v.table("part").where(F.col("p_brand").isin("Brand#4", "Brand#8", "Brand#12")).select(F.col("p_brand").alias("account_code")).distinct()
    apart = v.table("region").where("r_name LIKE 'A%'").select(F.col("r_name").alias("group"))
    found = scoped(scopes, source, ENTITY, scopes.run_checks(v.run_log, ENTITY), S.schema_drift(v.inventory, "old", "new"), Z.fuzzy_matches(source, v.mapping), apart, odd)
    rows = gap_evidence(entity_primary(v, source), source, v.mapping, ENTITY, None, *found)
    flags = ["has_run_findings", "run_confidence", "timestamp_gap_flag", "has_parameter_diffs", "watermark_gap_flag", "has_schema_drift", "has_fuzzy_match", "has_region_mismatch", "anomalous_count"]
    return rows.select(*ENTITY, *flags)


@query(
    UNMAPPED
    + LATEST
    + """
    , f AS (
      SELECT entity_code, 1 AS seq, 'Mapping Gap' AS category, account_code AS finding, t AS amount FROM u
      UNION ALL SELECT * FROM (SELECT entity_code, 2, 'Intercompany Elimination', entity_code || ' / ' || counterparty_entity, sum(amount) AS t FROM recon_source
        WHERE is_intercompany GROUP BY entity_code, counterparty_entity) WHERE abs(t) > 0.01
      UNION ALL SELECT entity_code, 3, 'Orchestration Timing', pipeline_id, NULL FROM run_facts JOIN feeds USING (pipeline_id) WHERE late OR params > 0 OR wet
      UNION ALL SELECT entity_code, 5, 'Manual Adjustment', entity_code, sum(amount) FROM recon_source WHERE adjustment_flag GROUP BY entity_code)
    SELECT entity_code, seq, category, finding, round(CAST(amount AS DOUBLE), 2) AS amount,
      CAST(row_number() OVER (PARTITION BY entity_code, seq ORDER BY abs(amount) DESC NULLS LAST, finding) AS INT) AS place FROM f QUALIFY place <= 10
    """
)
def component_findings(spark, folder):
    """The largest findings behind each component of every entity's gap."""
    v = Views(spark, folder)
    checks = Scopes(feeds=v.feeds).run_checks(v.run_log, ENTITY)
    return as_report(component_rows(pin(fold(v.source(*EVIDENCE_LINE))), v.mapping, ENTITY, run_checks=checks), "amount")


# ---------------------------------------------------------------- outliers


@query()
def outlier_accounts(spark, folder):
    """Parts as accounts."""
    lines = Views(spark, folder).table("lineitem")
    rows = lines.select(F.col("l_partkey").cast("string").alias("account_code"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return as_report(O.outlier_accounts(O.outlier_scores(O.account_amounts(rows))), "amount")


@query()
def top_outliers(spark, folder):
    lines = Views(spark, folder).table("lineitem")
    rows = lines.select(F.col("l_suppkey").cast("string").alias("account_code"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return as_report(O.top_outliers(O.outlier_scores(O.account_amounts(rows))), "amount")


@query(
    """
    , scored AS (SELECT CAST(l_partkey AS VARCHAR) AS account_code, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1),
    given AS (SELECT account_code, amount, CAST(abs(amount) AS DOUBLE) / 1000 AS score FROM scored),
    flagged AS (SELECT *, score > (SELECT quantile_cont(score, 0.95) FROM given) AS is_anomalous FROM given)
    SELECT account_code, round(CAST(amount AS DOUBLE), 2) AS amount, score, is_anomalous FROM flagged
    """
)
def outlier_flags(spark, folder):
    """The cut and the flags for given scores."""
    lines = Views(spark, folder).table("lineitem")
    rows = lines.select(F.col("l_partkey").cast("string").alias("account_code"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    scored = O.account_amounts(rows).withColumn("score", F.abs("amount").cast("double") / 1000)
    return as_report(O.flag_highest(scored), "amount")


@query(
    """
    , accounts AS (SELECT CAST(l_partkey AS VARCHAR) AS account_code, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1),
    steps AS (SELECT CAST(o_totalprice AS DOUBLE) * 10 AS start, sum(CAST(o_custkey AS DECIMAL(28,12))) AS change FROM orders GROUP BY 1),
    summed AS (SELECT start, sum(change) OVER (ORDER BY start) AS depth FROM steps)
    SELECT account_code, round(CAST(amount AS DOUBLE), 2) AS amount, coalesce(CAST(depth AS DOUBLE), 0.0) AS depth
    FROM accounts ASOF LEFT JOIN summed ON CAST(amount AS DOUBLE) >= start
    """
)
def as_of_lookup(spark, folder):
    """Every account with the sum of all steps up to its amount; orders stand for the steps of a forest."""
    v = Views(spark, folder)
    rows = v.table("lineitem").select(F.col("l_partkey").cast("string").alias("account_code"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    steps = v.table("orders").groupBy((F.col("o_totalprice").cast("double") * 10).alias("start")).agg(F.sum(F.col("o_custkey").cast("decimal(28,12)")).cast("decimal(28,12)").alias("change"))
    found = O.as_of_sum(O.account_amounts(rows), steps)
    return as_report(found.withColumn("depth", F.col("depth").cast("double")), "amount")


# ---------------------------------------------------------------- fixes

ADDED = """
, added AS (SELECT DISTINCT account_code AS source_account_code, 'TGT_' || account_code AS target_account_code, 'Revenue' AS metric_category FROM recon_source
  WHERE account_code NOT IN (SELECT source_account_code FROM recon_mapping)),
fixed_mapping AS (SELECT * FROM recon_mapping UNION ALL SELECT * FROM added)
"""
AFTER = """
, f_ours AS (SELECT metric_category AS metric, sum(amount) AS v FROM recon_source JOIN fixed_mapping ON account_code = source_account_code
  WHERE NOT is_intercompany GROUP BY 1),
f_all AS (SELECT metric, v FROM f_ours
  UNION ALL SELECT 'Gross Margin', sum(v) FROM f_ours WHERE metric IN ('Revenue', 'COGS')
  UNION ALL SELECT 'Operating Profit', sum(v) FROM f_ours),
f_gaps AS (SELECT coalesce(o.metric, t.metric) AS metric, coalesce(o.v, 0) AS our, coalesce(t.v, 0) AS target, coalesce(o.v, 0) - coalesce(t.v, 0) AS gap
  FROM f_all o FULL JOIN theirs t ON o.metric = t.metric)
SELECT b.metric, round(CAST(b.our AS DOUBLE), 2) AS before_our_value, round(CAST(f.our AS DOUBLE), 2) AS after_our_value,
  round(CAST(b.target AS DOUBLE), 2) AS target_value, round(CAST(b.gap AS DOUBLE), 2) AS gap_before, round(CAST(f.gap AS DOUBLE), 2) AS gap_after,
  round(CAST(b.gap - f.gap AS DOUBLE), 2) AS gap_closed,
  CASE WHEN b.gap <> 0 THEN round(abs(CAST(b.gap - f.gap AS DOUBLE) / CAST(b.gap AS DOUBLE) * 100), 1) ELSE 0.0 END AS gap_closed_pct
FROM gap_rows b JOIN f_gaps f ON b.metric = f.metric
"""
PREVIEW = ("before_our_value", "after_our_value", "target_value", "gap_before", "gap_after", "gap_closed")


def suggested(v: Views):
    return K.suggested_mapping(K.unmapped_codes(K.unmapped_totals(v.source("account_code", "amount"), v.mapping)))


@query(ADDED + "SELECT * FROM fixed_mapping")
def add_mapping(spark, folder):
    v = Views(spark, folder)
    return X.add_mapping(v.mapping, suggested(v).unionByName(v.mapping))


@query(TOTAL_GAPS + ADDED + AFTER)
def preview_mapping_fix(spark, folder):
    v = Views(spark, folder)
    return as_report(X.preview_fix("add_mapping", suggested(v), v.source(*LINE), v.mapping, v.target), *PREVIEW)


@query(
    TOTAL_GAPS
    + fuzzy_sql("recon_source", "recon_mapping", 80, "metric_category")
    + """
    , fixed_mapping AS (SELECT * FROM recon_mapping UNION ALL SELECT a, 'TGT_' || b, cat FROM best)
    """
    + AFTER
)
def preview_fuzzy_fix(spark, folder):
    v = Views(spark, folder)
    entries = X.mapping_from_suggestions(Z.fuzzy_matches(v.source("account_code"), v.mapping), v.mapping)
    return as_report(X.preview_fix("add_mapping", entries, v.source(*LINE), v.mapping, v.target), *PREVIEW)


@query(TOTAL_GAPS + ", fixed_mapping AS (SELECT * FROM recon_mapping)" + AFTER)
def preview_elimination_fix(spark, folder):
    v = Views(spark, folder)
    entries = I.suggested_eliminations(I.intercompany_findings(v.source(*IC)))
    return as_report(X.preview_fix("add_elimination", entries, v.source(*LINE, "entity_code", "counterparty_entity"), v.mapping, v.target), *PREVIEW)


BY_REGION = """
, fixed AS (SELECT entity_code, CASE WHEN entity_code IN ('NATION_3', 'NATION_8') THEN 'Corporate' WHEN entity_code = 'NATION_5' THEN 'ASIA' ELSE region END AS region FROM recon_hierarchy),
moved AS (SELECT 'b' AS state, h.region, metric_category AS metric, amount FROM recon_source s JOIN recon_mapping ON account_code = source_account_code JOIN recon_hierarchy h ON s.entity_code = h.entity_code WHERE NOT is_intercompany
  UNION ALL SELECT 'a', f.region, metric_category, amount FROM recon_source s JOIN recon_mapping ON account_code = source_account_code JOIN fixed f ON s.entity_code = f.entity_code WHERE NOT is_intercompany
  UNION ALL SELECT 't', region, metric, amount FROM recon_grouped_target JOIN recon_hierarchy USING (entity_code)),
summed AS (SELECT state, region, metric, sum(amount) AS v FROM moved GROUP BY ALL
  UNION ALL SELECT state, region, 'Gross Margin', sum(amount) FROM moved WHERE state <> 't' AND metric IN ('Revenue', 'COGS') GROUP BY ALL
  UNION ALL SELECT state, region, 'Operating Profit', sum(amount) FROM moved WHERE state <> 't' GROUP BY ALL),
wide AS (SELECT region, metric, coalesce(sum(v) FILTER (state = 'b'), 0) AS b, coalesce(sum(v) FILTER (state = 'a'), 0) AS a, coalesce(sum(v) FILTER (state = 't'), 0) AS t FROM summed GROUP BY ALL)
SELECT region, metric, round(CAST(b AS DOUBLE), 2) AS before_our_value, round(CAST(a AS DOUBLE), 2) AS after_our_value, round(CAST(t AS DOUBLE), 2) AS target_value,
  round(CAST(b - t AS DOUBLE), 2) AS gap_before, round(CAST(a - t AS DOUBLE), 2) AS gap_after, round(CAST(b - a AS DOUBLE), 2) AS gap_closed,
  CASE WHEN b <> t THEN round(abs(CAST(b - a AS DOUBLE) / CAST(b - t AS DOUBLE) * 100), 1) ELSE 0.0 END AS gap_closed_pct FROM wide
"""


@query(BY_REGION)
def preview_hierarchy_fix(spark, folder):
    """Three entities placed anew: gaps per region before and after."""
    v = Views(spark, folder)
    moves = v.hierarchy.where(F.col("entity_code").isin("NATION_3", "NATION_8", "NATION_5"))
    place = F.when(F.col("entity_code") == "NATION_5", "ASIA").otherwise("Corporate")
    updates = moves.select("entity_code", F.lit("region").alias("field"), place.alias("new_value"), F.lit(1).alias("seq"))
    reported = v.grouped_target.join(v.hierarchy.select("entity_code", "region"), "entity_code").select("region", "metric", "amount")
    rows = X.preview_fix("fix_hierarchy", updates, v.source("entity_code", *LINE), v.mapping, reported, v.hierarchy, ["region"])
    return as_report(rows, *PREVIEW)


@query(
    TOTAL_GAPS
    + """
    , fixed_mapping AS (SELECT * FROM recon_mapping),
    booked AS (SELECT 'Brand#' || (1 + s_suppkey % 25) AS account_code, CAST(s_acctbal AS DECIMAL(18,2)) AS amount, false AS is_intercompany FROM supplier)
    """
    + AFTER.replace("FROM recon_source JOIN fixed_mapping", "FROM (SELECT account_code, amount, is_intercompany FROM recon_source UNION ALL SELECT * FROM booked) JOIN fixed_mapping")
)
def preview_adjustment_fix(spark, folder):
    """One adjustment per supplier on the accounts in turn."""
    v = Views(spark, folder)
    account = F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string"))
    entries = v.table("supplier").select(account.alias("account_code"), F.col("s_acctbal").cast("decimal(18,2)").alias("amount"))
    return as_report(X.preview_fix("add_adjustment", entries, v.source(*LINE), v.mapping, v.target), *PREVIEW)


@query(
    PAIRS
    + """
    , half AS (SELECT DISTINCT least(entity, counterparty) AS entity, greatest(entity, counterparty) AS counterparty, net FROM open),
    after AS (SELECT least(entity_code, counterparty_entity) AS a, greatest(entity_code, counterparty_entity) AS b, amount FROM recon_source WHERE is_intercompany
      UNION ALL SELECT entity, counterparty, -net FROM half),
    left_open AS (SELECT a, b, sum(amount) AS net FROM after GROUP BY 1, 2 HAVING abs(sum(amount)) > 0.01)
    SELECT 'before' AS state, count(*) AS uneliminated_pair_count, round(CAST(sum(abs(net)) AS DOUBLE), 2) AS uneliminated_amount FROM open
    UNION ALL SELECT 'after', 2 * count(*), coalesce(round(CAST(2 * sum(abs(net)) AS DOUBLE), 2), 0.0) FROM left_open
    """
)
def elimination_effect(spark, folder):
    v = Views(spark, folder)
    source = v.source(*IC)
    entries = I.suggested_eliminations(I.pair_balances(I.intercompany_rows(source), directed=False))
    return as_report(X.elimination_effect(source, entries), "uneliminated_amount")


@query(
    PAIRS
    + """
    SELECT entity_code, account_code, round(CAST(amount AS DOUBLE), 2) AS amount, is_intercompany, adjustment_flag, adjustment_type FROM recon_source
    UNION ALL SELECT entity, '9999', round(CAST(-net AS DOUBLE), 2), true, true, 'IC_Elimination' FROM open
    """
)
def add_eliminations(spark, folder):
    v = Views(spark, folder)
    source = v.source("entity_code", "account_code", "amount", "is_intercompany", "counterparty_entity", "adjustment_flag", "adjustment_type")
    return as_report(X.add_eliminations(source, I.suggested_eliminations(I.intercompany_findings(source))).drop("counterparty_entity"), "amount")


@query(
    """
    SELECT entity_code, account_code, round(CAST(amount AS DOUBLE), 2) AS amount, is_intercompany, adjustment_flag, adjustment_type FROM recon_source
    UNION ALL SELECT entity_code, 'ADJ', round(CAST(-sum(amount) AS DOUBLE), 2), false, true, 'Manual' FROM recon_source WHERE adjustment_flag GROUP BY 1
    """
)
def add_adjustments(spark, folder):
    v = Views(spark, folder)
    source = v.source("entity_code", "account_code", "amount", "is_intercompany", "adjustment_flag", "adjustment_type")
    entries = source.filter("adjustment_flag").groupBy("entity_code").agg((-F.sum("amount")).cast("decimal(18,2)").alias("amount"))
    return as_report(X.add_adjustments(source, entries.withColumn("account_code", F.lit("ADJ"))), "amount")


@query(
    """
    SELECT entity_code, business_unit, CASE WHEN s_suppkey % 10 = 3 THEN 'Head Office' WHEN s_suppkey % 5 = 3 THEN 'Corporate' ELSE h.region END AS region,
      CASE WHEN s_suppkey % 7 = 0 THEN 'SEG_X' ELSE segment END AS segment
    FROM supplier_hierarchy h JOIN supplier ON entity_code = s_name
    """
)
def fix_hierarchy(spark, folder):
    v = Views(spark, folder)
    s = v.table("supplier")
    k = F.col("s_suppkey")

    def update(rows, field, value, seq):
        return rows.select(F.col("s_name").alias("entity_code"), F.lit(field).alias("field"), F.lit(value).alias("new_value"), F.lit(seq).alias("seq"))

    updates = update(s.filter(k % 5 == 3), "region", "Corporate", 1).unionByName(update(s.filter(k % 10 == 3), "region", "Head Office", 2))
    return X.fix_hierarchy(v.supplier_hierarchy, updates.unionByName(update(s.filter(k % 7 == 0), "segment", "SEG_X", 3)))


@query(
    """
    , fixed AS (SELECT entity_code, CASE WHEN entity_code = 'NATION_3' THEN 'Corporate' ELSE region END AS region FROM recon_hierarchy),
    ours AS (SELECT f.region, sum(amount) AS v FROM recon_source s JOIN recon_full_mapping ON account_code = source_account_code JOIN fixed f ON s.entity_code = f.entity_code
      WHERE NOT is_intercompany AND metric_category = 'Revenue' GROUP BY 1)
    SELECT 'Revenue' AS metric, group_by AS "group", round(CAST(ours.v AS DOUBLE), 2) AS our_value, round(CAST(t.amount AS DOUBLE), 2) AS target_value,
      round(CAST(ours.v - t.amount AS DOUBLE), 2) AS gap, round(CAST(ours.v - t.amount AS DOUBLE) / CAST(t.amount AS DOUBLE) * 100, 1) AS gap_pct
    FROM recon_target t JOIN ours ON t.group_by = ours.region WHERE row_type = 'detail'
    """
)
def regions_after_hierarchy_fix(spark, folder):
    v = Views(spark, folder)
    updates = v.hierarchy.filter("entity_code = 'NATION_3'").select(
        "entity_code", F.lit("region").alias("field"), F.lit("Corporate").alias("new_value"), F.lit(1).alias("seq")
    )
    rows = L.region_comparison(v.source("entity_code", *LINE), v.full_mapping, v.target, X.fix_hierarchy(v.hierarchy, updates))
    return as_report(rows, "our_value", "target_value", "gap")


# ---------------------------------------------------------------- notebook steps


@query(
    """
    , c AS (SELECT doc_id AS notebook_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l
      FROM documents)
    SELECT notebook_id, CAST(unnest(range(len(l))) AS INT) AS cell_index, 'code' AS cell_type, unnest(l) AS cell_source FROM c
    """
)
def notebook_cells(spark, folder):
    """Documents as exported notebooks with one cell per line."""
    content = F.replace("text", F.lit("\n"), F.lit("\n" + remote.CELL_DELIMITER + "\n"))
    docs = Views(spark, folder).table("documents")
    return remote.notebook_cells(docs.select(F.col("doc_id").alias("notebook_id"), content.alias("content")))


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"



def _first(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(cell_source, '{pattern}') THEN regexp_extract(cell_source, '{pattern}', 1) END"


def _split(matches: str, quotes: bool = True) -> str:
    part = STRIP.format("p")
    if quotes:
        part = f"""regexp_replace({part}, '^["'']+|["'']+$', '', 'g')"""
    return f"flatten(list_transform({matches}, lambda m: list_transform(string_split(m, ','), lambda p: {part})))"


def _unique(values: str) -> str:
    return f"array_to_string(list_filter({values}, lambda x, i: list_position({values}, x) = i), '|')"


NAME_SQL = "coalesce(" + ", ".join(_first(p.replace("'", "''")) for p in N.NAME_PATTERNS) + ")"
KIND_SQL = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(cell_source), $${w}$$)' for w in words)} THEN '{kind}'" for kind, words in N.STEP_KINDS
) + " ELSE 'unknown' END"
STEPS_SQL = f"""
, steps AS (SELECT notebook_id, cell_index AS step_index,
    coalesce(replace(lower({STRIP.format(NAME_SQL)}), ' ', '_'), 'step_' || cell_index) AS step_name, {KIND_SQL} AS transform_type, cell_source
  FROM cells WHERE cell_type = 'code' AND length({STRIP.format('cell_source')}) > 0)
"""


def _all(pattern: str) -> str:
    return "regexp_extract_all(cell_source, '" + pattern.replace("'", "''") + "', 1)"


@query(
    STEPS_SQL
    + f"""
    , lists AS (SELECT *, {_split(_all(N.JOIN_KEYS))} AS jk,
        list_transform({_all(N.FILTER_CALL)}, lambda t: {STRIP.format('t')}) ||
          list_transform({_all(N.WHERE_CLAUSE)}, lambda t: replace({STRIP.format('t')}, chr(10), ' ')) AS fc,
        {_split(_all(N.GROUP_CALL))} || {_split(_all(N.GROUP_CLAUSE), False)} AS ac,
        {_split(_all(N.SELECT_CALL))} AS s1, {_split(_all(N.SELECT_CLAUSE), False)} AS s2 FROM steps),
    chosen AS (SELECT *, CASE WHEN len(s1) > 0 THEN s1 ELSE s2 END AS os FROM lists)
    SELECT notebook_id, step_index, step_name, transform_type, {_unique('jk')} AS join_keys, {_unique('fc')} AS filter_conditions,
      {_unique('ac')} AS aggregation_columns, {_unique('os')} AS output_schema, CAST(length(cell_source) AS INT) AS cell_length_chars FROM chosen
    """
)
def notebook_steps(spark, folder):
    steps = N.notebook_steps(Views(spark, folder).cells)
    lists = ["join_keys", "filter_conditions", "aggregation_columns", "output_schema"]
    return steps.withColumns({c: F.array_join(c, "|") for c in lists})


@query(
    STEPS_SQL
    + """
    , e AS (SELECT notebook_id, step_index, step_name AS to_step, lag(step_name) OVER (PARTITION BY notebook_id ORDER BY step_index) AS from_step FROM steps)
    SELECT notebook_id, step_index, from_step, to_step, 'sequential' AS edge_type FROM e WHERE from_step IS NOT NULL
    """
)
def step_edges(spark, folder):
    return N.step_edges(N.notebook_steps(Views(spark, folder).cells))


@query(
    STEPS_SQL
    + """
    , r AS (SELECT 'step_' || (event_id % 400) AS task, ts, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY event_id % 400 ORDER BY ts DESC, event_type DESC) = 1)
    SELECT notebook_id, step_index, step_name, CAST(NULL AS TIMESTAMP) AS start_time, ts AS end_time, event_type AS status FROM steps LEFT JOIN r ON step_name = task
    """
)
def step_run_times(spark, folder):
    v = Views(spark, folder)
    log = v.table("events").select(
        F.concat(F.lit("step_"), (F.col("event_id") % 400).cast("string")).alias("task_name"), F.lit(None).cast("timestamp_ntz").alias("start_time"),
        F.col("ts").cast("timestamp_ntz").alias("end_time"), F.col("event_type").alias("status"),
    )
    steps = N.notebook_steps(v.cells).select("notebook_id", "step_index", "step_name")
    return R.with_run_times(steps, log)
