"""Queries on profiles, coverage and the checks that look for causes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieout.operators import (
    adjustments as A,
    control_totals as T,
    enrich as E,
    intercompany as I,
    mapping_checks as K,
    profile as P,
    rollup as R,
    schema_diff as S,
    sketches,
    validation as V,
)
from tieout.operators.metrics import as_report
from tieout.scale import pin
from verification.registry import query
from verification.views import Views


@query(
    """
    SELECT count(*) AS row_count, round(CAST(sum(amount) AS DOUBLE), 2) AS total_amount, count(DISTINCT account_code) AS unique_accounts,
      count(DISTINCT entity_code) AS unique_entities, CAST(CAST(min(date) AS DATE) AS VARCHAR) AS date_min,
      CAST(CAST(max(date) AS DATE) AS VARCHAR) AS date_max, count(*) FILTER (is_intercompany) AS intercompany_count,
      count(*) FILTER (adjustment_flag) AS adjustment_count FROM recon_source
    """
)
def source_profile(spark, folder):
    v = Views(spark, folder)
    rows = P.source_profile(v.source("account_code", "entity_code", "amount", "date", "is_intercompany", "adjustment_flag"))
    return as_report(rows, "total_amount")


@query(
    """
    SELECT 'counterparty_entity' AS column_name, round(avg(CASE WHEN counterparty_entity IS NULL THEN 1.0 ELSE 0.0 END), 3) AS null_rate FROM recon_source
    UNION ALL SELECT 'adjustment_type', round(avg(CASE WHEN adjustment_type IS NULL THEN 1.0 ELSE 0.0 END), 3) FROM recon_source
    """
)
def null_rates(spark, folder):
    return P.null_rates(Views(spark, folder).source())


@query(
    """
    , c AS (SELECT 'currency' AS column_name, currency AS value, count(*) AS row_count FROM recon_source GROUP BY 2
      UNION ALL SELECT 'period', period, count(*) FROM recon_source GROUP BY 2)
    SELECT column_name, value, row_count FROM c
    """
)
def value_counts(spark, folder):
    return P.value_counts(Views(spark, folder).source("currency", "period"), ["currency", "period"])


@query(
    """
    , c AS (SELECT 'currency' AS column_name, currency AS value, count(*) AS row_count FROM recon_source GROUP BY 2
      UNION ALL SELECT 'period', period, count(*) FROM recon_source GROUP BY 2)
    SELECT column_name, value, row_count FROM c
    QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY row_count DESC, value) <= 10
    """
)
def top_value_counts(spark, folder):
    return P.value_counts(Views(spark, folder).source("currency", "period"), ["currency", "period"], 10)


@query(
    """
    SELECT 'metric_category' AS column_name, metric_category AS value, count(*) AS row_count FROM recon_mapping GROUP BY 2
    """
)
def mapping_categories(spark, folder):
    return P.value_counts(Views(spark, folder).mapping, ["metric_category"])


@query("SELECT account_code, count(*) AS row_count FROM recon_source GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_accounts_by_rows(spark, folder):
    return P.top_by_rows(Views(spark, folder).source("account_code"), "account_code")


@query(
    """
    SELECT account_code, round(CAST(abs(sum(amount)) AS DOUBLE), 2) AS amount FROM recon_source GROUP BY 1 ORDER BY abs(sum(amount)) DESC, 1 LIMIT 10
    """
)
def top_accounts_by_amount(spark, folder):
    return as_report(P.top_by_amount(Views(spark, folder).source("account_code", "amount"), "account_code"), "amount")


@query(
    """
    SELECT entity_code, round(CAST(abs(sum(amount)) AS DOUBLE), 2) AS amount FROM recon_source GROUP BY 1 ORDER BY abs(sum(amount)) DESC, 1 LIMIT 10
    """
)
def top_entities_by_amount(spark, folder):
    return as_report(P.top_by_amount(Views(spark, folder).source("entity_code", "amount"), "entity_code"), "amount")


@query(
    """
    SELECT count(*) AS row_count, count(DISTINCT source_account_code) AS unique_source_accounts,
      count(DISTINCT target_account_code) AS unique_target_accounts FROM recon_mapping
    """
)
def mapping_profile(spark, folder):
    return P.mapping_profile(Views(spark, folder).mapping)


@query("SELECT metric, count(*) AS row_count, round(CAST(sum(amount) AS DOUBLE), 2) AS total_amount FROM recon_target GROUP BY 1")
def target_profile(spark, folder):
    return as_report(P.target_profile(Views(spark, folder).target), "total_amount")


@query("SELECT count(*) AS row_count, count(DISTINCT s_name) AS unique_entities FROM supplier")
def hierarchy_profile(spark, folder):
    return P.hierarchy_profile(Views(spark, folder).supplier_hierarchy)


COVERAGE = """
  count(*) AS total_transactions, count(*) FILTER (m.source_account_code IS NULL) AS unmapped_count,
  round(CAST(coalesce(sum(amount) FILTER (m.source_account_code IS NULL), 0) AS DOUBLE), 2) AS unmapped_amount,
  round((1 - count(*) FILTER (m.source_account_code IS NULL) / count(*)) * 100, 1) AS coverage_pct,
  round(count(*) FILTER (m.source_account_code IS NULL) / count(*), 4) AS unmapped_ratio
FROM recon_source s LEFT JOIN recon_mapping m ON s.account_code = m.source_account_code
"""


@query(f"SELECT {COVERAGE}")
def mapping_coverage(spark, folder):
    v = Views(spark, folder)
    return as_report(P.mapping_coverage(v.source("account_code", "amount"), v.mapping), "unmapped_amount")


@query(f"SELECT entity_code, {COVERAGE} GROUP BY entity_code")
def mapping_coverage_by_entity(spark, folder):
    v = Views(spark, folder)
    return as_report(P.mapping_coverage(v.source("entity_code", "account_code", "amount"), v.mapping, ["entity_code"]), "unmapped_amount")


@query(
    """
    SELECT account_code, count(*) AS row_count FROM recon_source
    WHERE account_code NOT IN (SELECT source_account_code FROM recon_mapping) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20
    """
)
def top_unmapped_codes(spark, folder):
    v = Views(spark, folder)
    return P.top_unmapped(v.source("account_code"), v.mapping, 20)


UNMAPPED = """
, u AS (SELECT entity_code, account_code, count(*) AS n, sum(amount) AS t FROM recon_source
  WHERE account_code NOT IN (SELECT source_account_code FROM recon_mapping) GROUP BY 1, 2),
ua AS (SELECT account_code, CAST(sum(n) AS BIGINT) AS n, sum(t) AS t FROM u GROUP BY 1)
"""


@query(
    UNMAPPED
    + """
    SELECT account_code, n AS transaction_count, round(CAST(t AS DOUBLE), 2) AS total_amount, round(CAST(t AS DOUBLE) / n, 2) AS avg_amount FROM ua
    """
)
def unmapped_codes(spark, folder):
    v = Views(spark, folder)
    return as_report(K.unmapped_codes(K.unmapped_totals(v.source("account_code", "amount"), v.mapping)), "total_amount")


HALVES = " || ':' || ".join(
    f"sum(CAST(CAST('0x' || substr(md5(account_code || ':' || CAST(t AS DECIMAL(28,2))), {first}, 16) AS UBIGINT) AS DECIMAL(28,0)))" for first in (1, 17)
)
CHECKSUM = f"md5(count(*) || ':' || {HALVES})"


@query(
    UNMAPPED
    + f"""
    SELECT entity_code, count(*) AS unmapped_account_count, CAST(sum(n) AS BIGINT) AS unmapped_transaction_count,
      round(CAST(sum(t) AS DOUBLE), 2) AS unmapped_amount, {CHECKSUM} AS checksum FROM u GROUP BY 1
    """
)
def mapping_gap_by_entity(spark, folder):
    v = Views(spark, folder)
    totals = K.unmapped_totals(v.source("entity_code", "account_code", "amount"), v.mapping, by=["entity_code"])
    return as_report(K.mapping_gap(totals, ["entity_code"]), "unmapped_amount")


@query(
    UNMAPPED
    + f"""
    SELECT count(*) AS unmapped_account_count, CAST(sum(n) AS BIGINT) AS unmapped_transaction_count,
      round(CAST(sum(t) AS DOUBLE), 2) AS unmapped_amount, {CHECKSUM} AS checksum FROM ua
    """
)
def mapping_gap(spark, folder):
    v = Views(spark, folder)
    return as_report(K.mapping_gap(K.unmapped_totals(v.source("account_code", "amount"), v.mapping)), "unmapped_amount")


@query(UNMAPPED + "SELECT account_code, md5(account_code || ':' || CAST(t AS DECIMAL(28,2))) AS checksum FROM ua")
def finding_checksums(spark, folder):
    v = Views(spark, folder)
    rows = K.unmapped_codes(K.unmapped_totals(v.source("account_code", "amount"), v.mapping))
    return rows.select("account_code", K.finding_checksum().alias("checksum"))


@query(
    UNMAPPED
    + """
    SELECT account_code AS source_account_code, 'TGT_' || account_code AS target_account_code, 'Revenue' AS metric_category FROM ua
    """
)
def suggested_mapping(spark, folder):
    v = Views(spark, folder)
    return K.suggested_mapping(K.unmapped_codes(K.unmapped_totals(v.source("account_code", "amount"), v.mapping)))


@query(
    f"""
    , c AS (SELECT entity_code, {COVERAGE} GROUP BY entity_code),
    f AS (SELECT entity_code, unmapped_ratio, entity_code IN ('NATION_1', 'NATION_2') AS has_schema_drift,
      unmapped_count > 250 AS has_fuzzy_match FROM c)
    SELECT entity_code, round(greatest(1.0 - CASE WHEN unmapped_ratio > 0.05 THEN 0.3 ELSE 0.0 END - CASE WHEN has_schema_drift THEN 0.2 ELSE 0.0 END
      - CASE WHEN NOT has_fuzzy_match THEN 0.1 ELSE 0.0 END, 0.0)::DOUBLE, 3) AS data_confidence FROM f
    """
)
def data_confidence(spark, folder):
    v = Views(spark, folder)
    rows = P.mapping_coverage(v.source("entity_code", "account_code", "amount"), v.mapping, ["entity_code"])
    rows = rows.withColumns(
        {"has_schema_drift": F.col("entity_code").isin("NATION_1", "NATION_2"), "has_fuzzy_match": F.col("unmapped_count") > 250}
    )
    return K.data_confidence(rows).select("entity_code", "data_confidence")


IC = ("entity_code", "counterparty_entity", "amount", "is_intercompany")
PAIRS = """
, p AS (SELECT entity_code, counterparty_entity, sum(amount) AS t FROM recon_source
  WHERE is_intercompany AND entity_code IS NOT NULL AND counterparty_entity IS NOT NULL GROUP BY 1, 2),
net AS (SELECT a.entity_code AS entity, a.counterparty_entity AS counterparty, a.t AS debit, coalesce(b.t, 0) AS credit, a.t + coalesce(b.t, 0) AS net
  FROM p a LEFT JOIN p b ON a.entity_code = b.counterparty_entity AND a.counterparty_entity = b.entity_code),
open AS (SELECT * FROM net WHERE abs(net) > 0.01)
"""


@query(
    PAIRS
    + """
    SELECT entity, counterparty, round(CAST(debit AS DOUBLE), 2) AS debit_amount, round(CAST(credit AS DOUBLE), 2) AS credit_amount,
      round(CAST(net AS DOUBLE), 2) AS net_uneliminated FROM open
    """
)
def intercompany_pairs(spark, folder):
    rows = I.intercompany_findings(Views(spark, folder).source(*IC))
    return as_report(rows, "debit_amount", "credit_amount", "net_uneliminated")


@query(
    PAIRS
    + """
    SELECT entity, counterparty, round(CAST(debit AS DOUBLE), 2) AS debit_amount, round(CAST(credit AS DOUBLE), 2) AS credit_amount,
      round(CAST(net AS DOUBLE), 2) AS net_uneliminated
    FROM (SELECT least(entity, counterparty) AS entity, greatest(entity, counterparty) AS counterparty,
        max(CASE WHEN entity <= counterparty THEN debit ELSE credit END) AS debit, max(CASE WHEN entity <= counterparty THEN credit ELSE debit END) AS credit,
        max(net) AS net FROM open GROUP BY 1, 2)
    """
)
def intercompany_pairs_undirected(spark, folder):
    rows = I.pair_balances(I.intercompany_rows(Views(spark, folder).source(*IC)), directed=False)
    return as_report(rows, "debit_amount", "credit_amount", "net_uneliminated")


@query(
    """
    , p AS (SELECT period, entity_code, counterparty_entity, sum(amount) AS t FROM recon_source WHERE is_intercompany GROUP BY 1, 2, 3)
    SELECT a.period, a.entity_code AS entity, a.counterparty_entity AS counterparty, round(CAST(a.t AS DOUBLE), 2) AS debit_amount,
      round(CAST(coalesce(b.t, 0) AS DOUBLE), 2) AS credit_amount, round(CAST(a.t + coalesce(b.t, 0) AS DOUBLE), 2) AS net_uneliminated
    FROM p a LEFT JOIN p b ON a.period = b.period AND a.entity_code = b.counterparty_entity AND a.counterparty_entity = b.entity_code
    WHERE abs(a.t + coalesce(b.t, 0)) > 0.01
    """
)
def intercompany_pairs_by_period(spark, folder):
    rows = I.intercompany_findings(Views(spark, folder).source("period", *IC), by=["period"])
    return as_report(rows, "debit_amount", "credit_amount", "net_uneliminated")


@query(
    PAIRS
    + """
    SELECT (SELECT count(*) FROM recon_source WHERE is_intercompany) AS ic_transaction_count,
      (SELECT round(CAST(sum(amount) AS DOUBLE), 2) FROM recon_source WHERE is_intercompany) AS total_ic_amount,
      count(*) AS uneliminated_pair_count, round(CAST(sum(abs(net)) AS DOUBLE), 2) AS uneliminated_amount FROM open
    """
)
def intercompany_summary(spark, folder):
    rows = I.intercompany_summary(Views(spark, folder).source(*IC))
    return as_report(rows, "total_ic_amount", "uneliminated_amount")


@query(
    """
    SELECT entity_code AS entity, 'Unknown' AS counterparty, round(CAST(sum(amount) AS DOUBLE), 2) AS net_uneliminated
    FROM recon_source WHERE is_intercompany GROUP BY 1
    """
)
def intercompany_by_entity(spark, folder):
    rows = I.intercompany_findings(Views(spark, folder).source("entity_code", "amount", "is_intercompany"))
    return as_report(rows, "net_uneliminated")


@query(
    """
    SELECT entity_code AS entity, counterparty_entity AS counterparty, transaction_id,
      CAST(row_number() OVER (PARTITION BY entity_code, counterparty_entity ORDER BY transaction_id) AS INT) AS place
    FROM recon_source WHERE is_intercompany QUALIFY place <= 5
    """
)
def intercompany_samples(spark, folder):
    return I.pair_samples(I.intercompany_rows(Views(spark, folder).source("transaction_id", *IC)))


@query(
    PAIRS
    + """
    SELECT entity AS entity_code, '9999' AS account_code, round(CAST(-net AS DOUBLE), 2) AS amount, counterparty AS counterparty_entity FROM open
    """
)
def suggested_eliminations(spark, folder):
    return as_report(I.suggested_eliminations(I.intercompany_findings(Views(spark, folder).source(*IC))), "amount")


ADJ = ("entity_code", "amount", "adjustment_flag", "adjustment_type")


@query(
    """
    SELECT count(*) AS adjustment_count, round(CAST(sum(amount) AS DOUBLE), 2) AS adjustment_amount, count(DISTINCT entity_code) AS entities_affected,
      round(CAST(sum(amount) AS DOUBLE), 2) AS implied_target_adjustment FROM recon_source WHERE adjustment_flag
    """
)
def adjustment_summary(spark, folder):
    rows = A.adjustment_summary(Views(spark, folder).source(*ADJ))
    return as_report(rows, "adjustment_amount", "implied_target_adjustment")


@query(
    """
    SELECT adjustment_type, count(*) AS adjustment_count, round(CAST(sum(amount) AS DOUBLE), 2) AS adjustment_amount
    FROM recon_source WHERE adjustment_flag AND adjustment_type IS NOT NULL GROUP BY 1
    """
)
def adjustments_by_type(spark, folder):
    return as_report(A.adjustments_by_type(Views(spark, folder).source(*ADJ)), "adjustment_amount")


@query(
    """
    SELECT entity_code, count(*) AS adjustment_count, round(CAST(sum(amount) AS DOUBLE), 2) AS adjustment_amount
    FROM recon_source WHERE adjustment_flag GROUP BY 1
    """
)
def adjusted_entities(spark, folder):
    return as_report(A.adjusted_entities(Views(spark, folder).source(*ADJ)), "adjustment_amount")


REGIONS = """
, theirs AS (SELECT group_by, sum(amount) AS t FROM recon_target WHERE row_type = 'detail' AND metric = 'Revenue' GROUP BY 1),
ours AS (SELECT h.region, sum(amount) AS t FROM recon_source s JOIN recon_mapping ON account_code = source_account_code
  JOIN recon_hierarchy h ON s.entity_code = h.entity_code WHERE NOT is_intercompany AND metric_category = 'Revenue' GROUP BY 1),
c AS (SELECT group_by, coalesce(o.t, 0) AS our, theirs.t AS target, coalesce(o.t, 0) - theirs.t AS gap FROM theirs LEFT JOIN ours o ON group_by = region)
SELECT 'Revenue' AS metric, group_by AS "group", round(CAST(our AS DOUBLE), 2) AS our_value, round(CAST(target AS DOUBLE), 2) AS target_value,
  round(CAST(gap AS DOUBLE), 2) AS gap, CASE WHEN target <> 0 THEN round(CAST(gap AS DOUBLE) / CAST(target AS DOUBLE) * 100, 1) END AS gap_pct FROM c
"""
PLACED = ("entity_code", "account_code", "amount", "is_intercompany")


@query(REGIONS)
def region_comparison(spark, folder):
    v = Views(spark, folder)
    rows = R.region_comparison(v.source(*PLACED), v.mapping, v.target, v.hierarchy)
    return as_report(rows, "our_value", "target_value", "gap")


@query(REGIONS + "WHERE abs(gap) > 1000")
def region_mismatches(spark, folder):
    v = Views(spark, folder)
    rows = R.region_mismatches(v.source(*PLACED), v.mapping, v.target, v.hierarchy)
    return as_report(rows, "our_value", "target_value", "gap")


SIDES = """
, sides AS (SELECT coalesce(o.table_name, n.table_name) AS table_name, coalesce(o.column_name, n.column_name) AS column_name,
    o.data_type AS old_type, n.data_type AS new_type
  FROM (SELECT * FROM inventory WHERE version = 'old') o FULL JOIN (SELECT * FROM inventory WHERE version = 'new') n
    ON o.table_name = n.table_name AND o.column_name = n.column_name)
"""


@query(SIDES + "SELECT table_name, column_name, CASE WHEN old_type IS NULL THEN 'old' ELSE 'new' END AS missing_in FROM sides WHERE old_type IS NULL OR new_type IS NULL")
def missing_columns(spark, folder):
    return S.missing_columns(Views(spark, folder).inventory, "old", "new")


@query(SIDES + "SELECT table_name, column_name, old_type, new_type FROM sides WHERE old_type <> new_type")
def type_drift(spark, folder):
    return S.type_drift(Views(spark, folder).inventory, "old", "new")


@query(
    SIDES
    + """
    , d AS (SELECT table_name, count(*) FILTER (old_type IS NULL OR new_type IS NULL) AS missing_columns,
        count(*) FILTER (old_type <> new_type) AS changed_types FROM sides GROUP BY 1)
    SELECT table_name, missing_columns, changed_types, missing_columns > 0 OR changed_types > 0 AS has_schema_drift FROM d
    """
)
def schema_drift(spark, folder):
    return S.schema_drift(Views(spark, folder).inventory, "old", "new")


HASHES = """
, hashes AS (SELECT table_name, version, substr(md5(string_agg(column_name || ':' || data_type, ',' ORDER BY column_name || ':' || data_type)), 1, 8) AS schema_hash
  FROM inventory GROUP BY 1, 2)
"""


@query(HASHES + "SELECT * FROM hashes")
def schema_hashes(spark, folder):
    return P.schema_hashes(Views(spark, folder).inventory)


@query(
    HASHES
    + f"""
    , h AS (SELECT table_name, max(CASE WHEN version = 'old' THEN schema_hash END) AS src_hash, max(CASE WHEN version = 'new' THEN schema_hash END) AS map_hash,
        max(CASE WHEN version = 'none' THEN schema_hash END) AS tgt_hash FROM hashes GROUP BY 1),
    cov AS (SELECT {COVERAGE})
    SELECT table_name, substr(md5(coalesce(src_hash, '') || '|' || coalesce(map_hash, '') || '|' || coalesce(tgt_hash, '') || '|' || printf('%.1f', coverage_pct)), 1, 12)
      AS fingerprint_hash FROM h, cov
    """
)
def fingerprints(spark, folder):
    v = Views(spark, folder)
    hashes = P.schema_hashes(v.inventory).groupBy("table_name").agg(
        F.max(F.when(F.col("version") == "old", F.col("schema_hash"))).alias("src_hash"),
        F.max(F.when(F.col("version") == "new", F.col("schema_hash"))).alias("map_hash"),
        F.max(F.when(F.col("version") == "none", F.col("schema_hash"))).alias("tgt_hash"),  # missing: keeps its place
    )
    coverage = P.mapping_coverage(v.source("account_code", "amount"), v.mapping)
    return P.fingerprints(hashes, coverage).select("table_name", "fingerprint_hash")


@query(
    """
    SELECT source_account_code, count(*) AS row_count FROM (
      SELECT p_brand || '/' || p_size AS source_account_code FROM part) GROUP BY 1 HAVING count(*) > 1
    """
)
def repeated_mapping_keys(spark, folder):
    part = Views(spark, folder).table("part")
    return V.repeated_mapping_keys(part.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("source_account_code")))


RAW_AMOUNT = "CASE WHEN l_partkey % 50 = 0 THEN 'n/a' WHEN l_partkey % 50 = 1 THEN '1,000' WHEN l_partkey % 50 = 2 THEN NULL ELSE printf('%.2f', l_extendedprice) END"


def raw_amount():
    k = F.col("l_partkey") % 50
    given = F.format_string("%.2f", F.col("l_extendedprice"))
    return F.when(k == 0, "n/a").when(k == 1, "1,000").when(k != 2, given)


@query(
    f"""
    , r AS (SELECT nullif(l_returnflag, 'R') AS account_code, CAST(l_suppkey AS VARCHAR) AS entity_code, {RAW_AMOUNT} AS amount,
        CASE WHEN l_linenumber = 7 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date FROM lineitem)
    SELECT 'null_account_code' AS "check", count(*) FILTER (account_code IS NULL) AS row_count FROM r
    UNION ALL SELECT 'null_entity_code', count(*) FILTER (entity_code IS NULL) FROM r
    UNION ALL SELECT 'unreadable_amount', count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DECIMAL(18,2)) IS NULL) FROM r
    UNION ALL SELECT 'unreadable_date', count(*) FILTER (date IS NOT NULL AND TRY_CAST(date AS TIMESTAMP) IS NULL) FROM r
    UNION ALL SELECT 'repeated_mapping_key', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)
    """
)
def quality_report(spark, folder):
    v = Views(spark, folder)
    raw = v.table("lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("account_code"),
        F.col("l_suppkey").cast("string").alias("entity_code"),
        raw_amount().alias("amount"),
        F.when(F.col("l_linenumber") == 7, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
    )
    return V.quality_report(raw, v.table("part").select(F.col("p_name").alias("source_account_code")))


@query(
    """
    , e AS (SELECT s.*, target_account_code FROM recon_source s LEFT JOIN recon_mapping ON account_code = source_account_code),
    t AS (SELECT 1 AS step, 'load' AS step_name, count(*) AS row_count, sum(amount) AS total FROM recon_source
      UNION ALL SELECT 2, 'without_intercompany', count(*), sum(amount) FROM recon_source WHERE NOT is_intercompany
      UNION ALL SELECT 3, 'mapped', count(*), sum(amount) FROM e WHERE NOT is_intercompany AND target_account_code IS NOT NULL),
    x AS (SELECT sum(amount) AS a, (SELECT sum(amount) FROM recon_source WHERE NOT is_intercompany) AS b FROM recon_source),
    j AS (SELECT t.*, CASE WHEN step = 1 THEN a ELSE b END AS expected_total FROM t, x)
    SELECT step, step_name, row_count, round(CAST(total AS DOUBLE), 2) AS total, round(CAST(expected_total AS DOUBLE), 2) AS expected_total,
      round(CAST(total - expected_total AS DOUBLE), 2) AS delta, abs(total - expected_total) > 1000 AS is_off,
      step = (SELECT min(step) FROM j WHERE abs(total - expected_total) > 1000) AS first_off FROM j
    """
)
def step_control_totals(spark, folder):
    v = Views(spark, folder)
    source = v.source("account_code", "amount", "is_intercompany")
    steps = [
        ("load", lambda df: df),
        ("without_intercompany", E.not_intercompany),
        ("mapped", lambda df: E.map_accounts(df, v.mapping).filter("is_mapped")),
    ]
    totals = T.step_totals(source, steps)
    sums = source.agg(F.sum("amount").alias("a"), F.sum(F.when(~F.col("is_intercompany"), F.col("amount"))).alias("b"))
    wanted = [("load", "a"), ("without_intercompany", "b"), ("mapped", "b")]
    names = F.array(*[F.struct(F.lit(n).alias("step_name"), F.col(c).alias("expected_total")) for n, c in wanted])
    return as_report(T.step_checks(totals, sums.select(F.inline(names))), "total", "expected_total", "delta")


# ---------------------------------------------------------------- sketches

SKETCHED = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice"]


def counts_sql(column: str) -> str:
    median = "NULL::DOUBLE" if column == "l_returnflag" else f"median({column})::DOUBLE"
    return f"SELECT year, '{column}' AS column_name, count(*) AS row_count, count(*) FILTER ({column} IS NULL) AS null_count, count(DISTINCT {column}) AS distinct_count, {median} AS m FROM l GROUP BY 1"


@query(
    ", l AS (SELECT year(l_shipdate)::INTEGER AS year, * FROM lineitem), c AS ("
    + " UNION ALL ".join(counts_sql(c) for c in SKETCHED)
    + ") SELECT year, column_name, row_count, null_count, distinct_count, true AS distinct_is_within, m IS NOT NULL AS has_median, true AS median_is_within FROM c"
)
def sketched_profile(spark, folder):
    """Sketches of every quarter, stored, read again and merged per year, beside exact counts."""
    lines = Views(spark, folder).table("lineitem").withColumn("quarter", F.quarter("l_shipdate")).withColumn("year", F.year("l_shipdate"))
    stored = pin(sketches.column_sketches(lines, SKETCHED, ["year", "quarter"]))
    found = sketches.merged_profile(stored, ["year"])
    exact = sketches.exact_profile(lines, SKETCHED, ["year"]).withColumnsRenamed({"year": "_year", "column_name": "_column", "row_count": "_rows", "null_count": "_nulls", "distinct_count": "exact"})
    both = found.join(exact, (F.col("year") == F.col("_year")) & (F.col("column_name") == F.col("_column")))
    # ranks of the approximate medians among the exact values
    medians = found.where("q50 IS NOT NULL").select(F.col("year").alias("_of"), F.col("column_name").alias("_name"), F.col("q50").alias("_q50"))
    values = lines.select("year", F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in SKETCHED if c != "l_returnflag"])))
    ranks = values.join(F.broadcast(medians), (F.col("year") == F.col("_of")) & (F.col("c") == F.col("_name"))).groupBy(F.col("year").alias("_of"), F.col("c").alias("_name")).agg(
        (F.count_if(F.col("v") < F.col("_q50")) / F.count(F.lit(1))).alias("low"), (F.count_if(F.col("v") <= F.col("_q50")) / F.count(F.lit(1))).alias("high")
    )
    both = both.join(ranks, (F.col("year") == F.col("_of")) & (F.col("column_name") == F.col("_name")), "left")
    near = F.coalesce((F.col("low") <= 0.5 + sketches.RANK_ERROR) & (F.col("high") >= 0.5 - sketches.RANK_ERROR), F.lit(True))
    inside = (F.col("exact") >= F.col("distinct_low")) & (F.col("exact") <= F.col("distinct_high"))
    return both.select("year", "column_name", "row_count", "null_count", F.col("exact").alias("distinct_count"), inside.alias("distinct_is_within"), F.col("q50").isNotNull().alias("has_median"), near.alias("median_is_within"))
