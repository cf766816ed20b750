"""Queries on enrichment, metrics and gaps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.functions import category, money
from tieout.operators import compare as C, enrich as E, metrics as M
from verification.registry import query
from verification.views import Views

LINE = ("account_code", "amount", "is_intercompany")
GROUP = ["entity_code", "period"]

# Total gaps: categories of mapped rows, derived metrics, and the reported headline rows.
TOTAL_GAPS = """
, ours AS (
  SELECT metric_category AS metric, sum(amount) AS v FROM recon_source JOIN recon_mapping ON account_code = source_account_code
  WHERE NOT is_intercompany GROUP BY 1),
ours_all AS (
  SELECT metric, v FROM ours
  UNION ALL SELECT 'Gross Margin', sum(v) FROM ours WHERE metric IN ('Revenue', 'COGS')
  UNION ALL SELECT 'Operating Profit', sum(v) FROM ours),
theirs AS (SELECT metric, sum(amount) AS v FROM recon_target WHERE regexp_matches(group_by, '(?i)Total|Group|All') GROUP BY 1),
gap_rows AS (
  SELECT coalesce(o.metric, t.metric) AS metric, coalesce(o.v, 0) AS our, coalesce(t.v, 0) AS target, coalesce(o.v, 0) - coalesce(t.v, 0) AS gap
  FROM ours_all o FULL JOIN theirs t ON o.metric = t.metric)
"""

# The same per entity and period; the grouped target has no headline or derived rows.
GROUPED_GAPS = """
, g_ours AS (
  SELECT entity_code, period, metric_category AS metric, sum(amount) AS v
  FROM recon_source JOIN recon_mapping ON account_code = source_account_code WHERE NOT is_intercompany GROUP BY ALL),
g_theirs AS (SELECT entity_code, period, metric, sum(amount) AS v FROM recon_grouped_target GROUP BY ALL),
grouped AS (
  SELECT coalesce(o.entity_code, t.entity_code) AS entity_code, coalesce(o.period, t.period) AS period,
    coalesce(o.metric, t.metric) AS metric, coalesce(o.v, 0) AS our, coalesce(t.v, 0) AS target, coalesce(o.v, 0) - coalesce(t.v, 0) AS gap
  FROM g_ours o FULL JOIN g_theirs t USING (entity_code, period, metric))
"""

GAP_COLUMNS = """round(CAST(our AS DOUBLE), 2) AS our_value, round(CAST(target AS DOUBLE), 2) AS target_value,
  round(CAST(gap AS DOUBLE), 2) AS gap,
  CASE WHEN target <> 0 THEN round(CAST(gap AS DOUBLE) / CAST(target AS DOUBLE) * 100, 2) END AS gap_pct, abs(gap) > 1000 AS has_gap"""


def total_gaps(v: Views):
    return M.gap_summary(v.source(*LINE), v.mapping, v.target)


def grouped_gaps(v: Views):
    ours = M.category_totals(v.source(*GROUP, *LINE), v.mapping, by=GROUP)
    return M.gaps(ours, M.target_metrics(v.grouped_target, GROUP), GROUP)


@query(TOTAL_GAPS + f"SELECT metric, {GAP_COLUMNS} FROM gap_rows")
def gap_summary(spark, folder):
    return M.as_report(total_gaps(Views(spark, folder)), "our_value", "target_value", "gap")


@query(GROUPED_GAPS + f"SELECT entity_code, period, metric, {GAP_COLUMNS} FROM grouped")
def gap_summary_by_entity_period(spark, folder):
    return M.as_report(grouped_gaps(Views(spark, folder)), "our_value", "target_value", "gap")


@query(
    """
    SELECT transaction_id, account_code, target_account_code, metric_category, target_account_code IS NOT NULL AS is_mapped
    FROM recon_source LEFT JOIN recon_mapping ON account_code = source_account_code
    """
)
def mapping_enrichment(spark, folder):
    v = Views(spark, folder)
    rows = E.map_accounts(v.source("transaction_id", "account_code"), v.mapping)
    return rows.select("transaction_id", "account_code", "target_account_code", "metric_category", "is_mapped")


@query(
    """
    SELECT s.transaction_id, s.entity_code, h.business_unit, h.region, h.segment
    FROM recon_source s LEFT JOIN recon_hierarchy h ON s.entity_code = h.entity_code
    """
)
def hierarchy_enrichment(spark, folder):
    v = Views(spark, folder)
    return E.place_entities(v.source("transaction_id", "entity_code", "business_unit", "region"), v.hierarchy).select(
        "transaction_id", "entity_code", "business_unit", "region", "segment"
    )


@query(
    """
    SELECT transaction_id, metric_category, round(CAST(amount AS DOUBLE), 2) AS amount
    FROM recon_source JOIN recon_mapping ON account_code = source_account_code WHERE NOT is_intercompany
    """
)
def reportable_rows(spark, folder):
    v = Views(spark, folder)
    rows = E.reportable(E.map_accounts(v.source("transaction_id", *LINE), v.mapping))
    return rows.select("transaction_id", "metric_category", money(F.col("amount")).alias("amount"))


@query(
    """
    SELECT transaction_id, account_code FROM recon_source
    WHERE account_code NOT IN (SELECT source_account_code FROM recon_mapping)
    """
)
def unmapped_transactions(spark, folder):
    v = Views(spark, folder)
    return E.unmapped_rows(v.source("transaction_id", "account_code"), v.mapping)


@query(
    """
    SELECT transaction_id, account_code FROM recon_source
    WHERE account_code IN (SELECT source_account_code FROM recon_mapping)
    """
)
def mapped_transactions(spark, folder):
    v = Views(spark, folder)
    return E.mapped_rows(v.source("transaction_id", "account_code"), v.mapping)


@query(
    """
    , big AS (SELECT account_code FROM recon_source GROUP BY 1 HAVING abs(sum(amount)) > (
        SELECT avg(t) FROM (SELECT abs(sum(amount)) AS t FROM recon_source GROUP BY account_code)))
    SELECT transaction_id, account_code FROM recon_source WHERE account_code NOT IN (SELECT account_code FROM big)
    """
)
def rows_without_accounts(spark, folder):
    v = Views(spark, folder)
    totals = v.source("account_code", "amount").groupBy("account_code").agg(F.abs(F.sum("amount")).alias("t"))
    big = totals.filter(F.col("t") > totals.agg(F.avg("t")).scalar())
    return E.without_accounts(v.source("transaction_id", "account_code"), big)


@query("SELECT metric, group_by, round(CAST(amount AS DOUBLE), 2) AS amount FROM recon_target WHERE regexp_matches(group_by, '(?i)Total|Group|All')")
def headline_target_rows(spark, folder):
    rows = M.headline_rows(Views(spark, folder).target)
    return M.as_report(rows.select("metric", "group_by", "amount"), "amount")


@query(
    """
    , labelled AS (
      SELECT period, metric, entity_code AS group_by, amount FROM recon_grouped_target
      UNION ALL SELECT period, metric, 'Group Total', sum(amount) FROM recon_grouped_target WHERE period LIKE '%Q1' GROUP BY 1, 2)
    SELECT period, metric, group_by, round(CAST(amount AS DOUBLE), 2) AS amount FROM labelled
    WHERE regexp_matches(group_by, '(?i)Total|Group|All') OR period NOT IN (
      SELECT period FROM labelled WHERE regexp_matches(group_by, '(?i)Total|Group|All'))
    """
)
def headline_rows_by_period(spark, folder):
    t = Views(spark, folder).grouped_target
    details = t.select("period", "metric", F.col("entity_code").alias("group_by"), "amount")
    heads = t.filter(F.col("period").endswith("Q1")).groupBy("period", "metric").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"))
    rows = details.unionByName(heads.withColumn("group_by", F.lit("Group Total")))
    return M.as_report(M.headline_rows(rows, ["period"]), "amount")


@query("SELECT metric, group_by, round(CAST(amount AS DOUBLE), 2) AS amount FROM recon_target WHERE row_type = 'detail'")
def detail_target_rows(spark, folder):
    rows = M.detail_rows(Views(spark, folder).target)
    return M.as_report(rows.select("metric", "group_by", "amount"), "amount")


RULES = """
CASE WHEN contains(t, 'rev') THEN 'Revenue' WHEN contains(t, 'sales') THEN 'Revenue'
  WHEN contains(t, 'cogs') OR contains(t, 'cost of goods') OR contains(t, 'cost of sales') OR contains(t, 'cost of revenue') THEN 'COGS'
  WHEN contains(t, 'opex') OR contains(t, 'operating expense') OR contains(t, 'g&a') OR contains(t, 'sga') OR contains(t, 'overhead') THEN 'OpEx'
  WHEN contains(t, 'interco') OR contains(t, 'ic') THEN 'Intercompany'
  ELSE array_to_string(list_transform(string_split(t, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END
"""


@query(
    f"""
    , raw AS (SELECT p_partkey, trim(CASE p_partkey % 9 WHEN 0 THEN ' Cost of Revenue ' WHEN 1 THEN 'G&A costs' WHEN 2 THEN 'SGA'
      WHEN 3 THEN 'cost of goods sold' WHEN 4 THEN 'Net SALES' ELSE p_type || ' ' || p_name END) AS raw FROM part),
    low AS (SELECT p_partkey, lower(raw) AS t FROM raw)
    SELECT p_partkey, {RULES} AS category FROM low
    """
)
def category_names(spark, folder):
    k = F.col("p_partkey") % 9
    raw = F.when(k == 0, " Cost of Revenue ").when(k == 1, "G&A costs").when(k == 2, "SGA").when(k == 3, "cost of goods sold")
    raw = raw.when(k == 4, "Net SALES").otherwise(F.concat_ws(" ", "p_type", "p_name"))
    return Views(spark, folder).table("part").select("p_partkey", category(raw).alias("category"))


@query(
    """
    SELECT metric_category AS metric, round(CAST(sum(amount) AS DOUBLE), 2) AS our_value
    FROM recon_source JOIN recon_mapping ON account_code = source_account_code WHERE NOT is_intercompany GROUP BY 1
    """
)
def category_totals(spark, folder):
    v = Views(spark, folder)
    return M.as_report(M.category_totals(v.source(*LINE), v.mapping), "our_value")


@query(
    """
    , c AS (SELECT region, metric_category AS metric, sum(amount) AS v
      FROM recon_source JOIN recon_mapping ON account_code = source_account_code WHERE NOT is_intercompany GROUP BY 1, 2),
    m AS (SELECT region, metric, v FROM c
      UNION ALL SELECT region, 'Gross Margin', sum(CASE WHEN metric IN ('Revenue', 'COGS') THEN v ELSE 0 END) FROM c GROUP BY 1
      UNION ALL SELECT region, 'Operating Profit', sum(CASE WHEN metric IN ('Revenue', 'COGS', 'OpEx') THEN v ELSE 0 END) FROM c GROUP BY 1)
    SELECT region, metric, round(CAST(v AS DOUBLE), 2) AS our_value FROM m
    """
)
def derived_metrics_by_region(spark, folder):
    v = Views(spark, folder)
    rows = M.our_metrics(v.source("entity_code", *LINE), v.mapping, v.hierarchy, ["region"])
    return M.as_report(rows, "our_value")


@query(
    """
    SELECT s.entity_code, h.business_unit, h.region, metric_category, round(CAST(sum(amount) AS DOUBLE), 2) AS our_amount
    FROM recon_source s JOIN recon_mapping ON account_code = source_account_code JOIN recon_hierarchy h ON s.entity_code = h.entity_code
    WHERE NOT is_intercompany GROUP BY ALL
    """
)
def entity_breakdown(spark, folder):
    v = Views(spark, folder)
    return M.as_report(M.entity_breakdown(v.source("entity_code", *LINE), v.mapping, v.hierarchy), "our_amount")


@query(
    """
    SELECT metric, round(CAST(sum(amount) AS DOUBLE), 2) AS target_value FROM recon_target
    WHERE regexp_matches(group_by, '(?i)Total|Group|All') GROUP BY 1
    """
)
def target_totals(spark, folder):
    return M.as_report(M.target_metrics(Views(spark, folder).target), "target_value")


@query(
    """
    , a AS (SELECT entity_code, metric_category AS metric, sum(amount) AS v FROM recon_source JOIN recon_mapping ON account_code = source_account_code
      WHERE NOT is_intercompany AND period LIKE '%Q1' GROUP BY ALL),
    b AS (SELECT entity_code, metric, sum(amount) AS v FROM recon_grouped_target WHERE period LIKE '%Q2' GROUP BY ALL)
    SELECT coalesce(a.entity_code, b.entity_code) AS entity_code, coalesce(a.metric, b.metric) AS metric,
      round(CAST(coalesce(a.v, 0) AS DOUBLE), 2) AS our_value, round(CAST(coalesce(b.v, 0) AS DOUBLE), 2) AS target_value
    FROM a FULL JOIN b ON a.entity_code = b.entity_code AND a.metric = b.metric
    """
)
def metric_outer_join(spark, folder):
    v = Views(spark, folder)
    first = v.source("entity_code", "period", *LINE).filter(F.col("period").endswith("Q1"))
    ours = M.category_totals(first, v.mapping, by=["entity_code"])
    theirs = M.target_metrics(v.grouped_target.filter(F.col("period").endswith("Q2")), ["entity_code"])
    return M.as_report(M.compare_totals(ours, theirs, ["entity_code"]), "our_value", "target_value")


@query(
    GROUPED_GAPS
    + """
    SELECT entity_code, period, metric, round(CAST(gap AS DOUBLE), 2) AS gap,
      CASE WHEN abs(gap) <= 1000 THEN 'Match' WHEN abs(gap) > 1000000 THEN 'Gap' ELSE 'Minor' END AS status FROM grouped
    """
)
def gap_statuses(spark, folder):
    rows = M.gap_statuses(grouped_gaps(Views(spark, folder)))
    return M.as_report(rows.select(*GROUP, "metric", "gap", "status"), "gap")


@query(
    GROUPED_GAPS
    + """
    , ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_code, period ORDER BY
        CASE WHEN abs(gap) > 1000 AND contains(lower(metric), 'revenue') THEN 0 WHEN abs(gap) > 1000 THEN 1 ELSE 2 END,
        CASE WHEN abs(gap) > 1000 AND NOT contains(lower(metric), 'revenue') THEN -abs(gap) ELSE 0 END, metric) AS rn FROM grouped)
    SELECT entity_code, period, metric AS primary_metric,
      round(CAST(CASE WHEN abs(gap) > 1000 THEN gap ELSE 0 END AS DOUBLE), 2) AS primary_gap FROM ranked WHERE rn = 1
    """
)
def primary_metric_by_group(spark, folder):
    return M.as_report(M.primary_metric(grouped_gaps(Views(spark, folder)), GROUP), "primary_gap")


DIFF_COLUMNS = """round(CAST(our AS DOUBLE), 2) AS source_val, round(CAST(target AS DOUBLE), 2) AS target_val, round(CAST(gap AS DOUBLE), 2) AS delta,
  CASE WHEN target <> 0 THEN round(CAST(gap AS DOUBLE) / CAST(target AS DOUBLE) * 100, 2) WHEN gap = 0 THEN 0.0 END AS delta_pct,
  CASE WHEN target = 0 THEN CASE WHEN gap = 0 THEN 'pass' ELSE 'fail' END
    WHEN abs(CAST(gap AS DOUBLE) / CAST(target AS DOUBLE)) <= 0.01 THEN 'pass'
    WHEN abs(CAST(gap AS DOUBLE) / CAST(target AS DOUBLE)) <= 0.05 THEN 'warn' ELSE 'fail' END AS status,
  md5(metric || ':' || CAST(our AS DECIMAL(28,2))) = md5(metric || ':' || CAST(target AS DECIMAL(28,2))) AS checksum_match"""


@query(GROUPED_GAPS + f"SELECT entity_code, period, metric, {DIFF_COLUMNS} FROM grouped")
def value_diff_by_group(spark, folder):
    v = Views(spark, folder)
    ours = M.category_totals(v.source(*GROUP, *LINE), v.mapping, by=GROUP)
    rows = C.value_diff(ours, M.target_metrics(v.grouped_target, GROUP), GROUP)
    return M.as_report(rows.drop("schema_match"), "source_val", "target_val", "delta")


@query(TOTAL_GAPS + f"SELECT metric, {DIFF_COLUMNS}, true AS schema_match FROM gap_rows")
def value_diff(spark, folder):
    v = Views(spark, folder)
    ours = M.our_metrics(v.source(*LINE), v.mapping)
    rows = C.value_diff(ours, M.target_metrics(v.target), schema_match=True)
    return M.as_report(rows, "source_val", "target_val", "delta")


@query(
    TOTAL_GAPS
    + """
    , w AS (SELECT max(CASE WHEN metric = 'Revenue' THEN gap END) AS r, max(CASE WHEN metric = 'COGS' THEN gap END) AS c,
        max(CASE WHEN metric = 'OpEx' THEN gap END) AS o, max(CASE WHEN metric = 'Gross Margin' THEN gap END) AS g,
        max(CASE WHEN metric = 'Operating Profit' THEN gap END) AS p FROM gap_rows),
    x AS (SELECT 'Gross Margin' AS derived_metric, g AS a, r + c AS e FROM w UNION ALL SELECT 'Operating Profit', p, g + o FROM w)
    SELECT derived_metric, round(CAST(a AS DOUBLE), 2) AS actual_gap, round(CAST(e AS DOUBLE), 2) AS expected_gap,
      round(CAST(a - e AS DOUBLE), 2) AS discrepancy FROM x WHERE abs(a - e) > 1000
    """
)
def inconsistent_metrics(spark, folder):
    rows = C.inconsistent_metrics(total_gaps(Views(spark, folder)))
    return M.as_report(rows, "actual_gap", "expected_gap", "discrepancy")


@query(
    """
    , theirs AS (SELECT region, category AS metric, sum(amount) + CASE WHEN region = 'ASIA' AND category = 'OpEx' THEN 5000 ELSE 0 END AS v
      FROM recon_source s JOIN (SELECT source_account_code, metric_category AS category FROM recon_full_mapping) f ON account_code = f.source_account_code
      WHERE NOT is_intercompany GROUP BY region, category),
    t_all AS (SELECT region, metric, v FROM theirs
      UNION ALL SELECT region, 'Gross Margin', sum(v) FROM theirs WHERE metric IN ('Revenue', 'COGS') GROUP BY 1
      UNION ALL SELECT region, 'Operating Profit', sum(v) + CASE WHEN region = 'EUROPE' THEN 700000 ELSE 0 END FROM theirs GROUP BY 1),
    c AS (SELECT region, metric_category AS metric, sum(amount) AS v
      FROM recon_source JOIN recon_mapping ON account_code = source_account_code WHERE NOT is_intercompany GROUP BY 1, 2),
    o_all AS (SELECT region, metric, v FROM c
      UNION ALL SELECT region, 'Gross Margin', sum(v) FROM c WHERE metric IN ('Revenue', 'COGS') GROUP BY 1
      UNION ALL SELECT region, 'Operating Profit', sum(v) FROM c GROUP BY 1),
    g AS (SELECT region, metric, coalesce(o_all.v, 0) - coalesce(t_all.v, 0) AS gap FROM o_all FULL JOIN t_all USING (region, metric)),
    w AS (SELECT region, max(CASE WHEN metric = 'Revenue' THEN gap END) AS r, max(CASE WHEN metric = 'COGS' THEN gap END) AS c,
        max(CASE WHEN metric = 'OpEx' THEN gap END) AS o, max(CASE WHEN metric = 'Gross Margin' THEN gap END) AS g,
        max(CASE WHEN metric = 'Operating Profit' THEN gap END) AS p FROM g GROUP BY 1),
    x AS (SELECT region, 'Gross Margin' AS derived_metric, g AS a, r + c AS e FROM w UNION ALL SELECT region, 'Operating Profit', p, g + o FROM w)
    SELECT region, derived_metric, round(CAST(a AS DOUBLE), 2) AS actual_gap, round(CAST(e AS DOUBLE), 2) AS expected_gap,
      round(CAST(a - e AS DOUBLE), 2) AS discrepancy FROM x WHERE abs(a - e) > 1000
    """
)
def inconsistent_metrics_by_region(spark, folder):
    v = Views(spark, folder)
    source = v.source("region", *LINE)
    extra = F.when((F.col("region") == "ASIA") & (F.col("metric") == "OpEx"), 5000).otherwise(0)
    theirs = M.category_totals(source, v.full_mapping, by=["region"]).withColumn("our_value", F.col("our_value") + extra)
    top = F.when((F.col("region") == "EUROPE") & (F.col("metric") == "Operating Profit"), 700000).otherwise(0)
    target = M.with_derived(theirs, ["region"]).select("region", "metric", (F.col("our_value") + top).alias("target_value"))
    gaps = M.gaps(M.our_metrics(source, v.mapping, by=["region"]), target, ["region"])
    return M.as_report(C.inconsistent_metrics(gaps, ["region"]), "actual_gap", "expected_gap", "discrepancy")
