"""Reconciliation tables derived from the given tables, in Spark and in SQL.

``Views`` builds only the joins that the requested columns need. ``PRELUDE`` holds the same tables as
common table expressions for the comparison engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieout.scale import pin, small_side

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OMITTED = ["Brand#11", "Brand#15", "Brand#22"]


def brand_number(brand):
    return F.substring_index(brand, "#", -1).cast("int")


def brand_category(brand):
    k = brand_number(brand) % 5
    return F.when(k.isin(0, 1), "Revenue").when(k.isin(2, 3), "COGS").otherwise("OpEx")


def joined_side(df: DataFrame) -> DataFrame:
    """``df`` for a join with more rows: broadcast if counted small, else the hashed side of a shuffle join, so that the rows are not sorted."""
    side = small_side(df)
    return df.hint("shuffle_hash") if side is df else side


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def places(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def _orders(self, with_customers: bool) -> DataFrame:
        """Orders, on request with the nation of their customer, so that transactions are exchanged once for both."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        if with_customers:
            orders = orders.join(self._customers, F.col("o_custkey") == F.col("c_custkey"))
        return orders.hint("shuffle_hash")

    @cached_property
    def _customers(self) -> DataFrame:
        return joined_side(self.table("customer").select("c_custkey", "c_nationkey"))

    @cached_property
    def _parts(self) -> DataFrame:
        return joined_side(self.table("part").select("p_partkey", "p_brand"))

    @cached_property
    def _suppliers(self) -> DataFrame:
        return joined_side(self.table("supplier").select("s_suppkey", "s_nationkey"))

    def source(self, *columns: str) -> DataFrame:
        """Transactions with the named columns (all when none is named)."""
        names = list(columns) or [
            "transaction_id", "date", "period", "account_code", "entity_code", "business_unit", "region",
            "segment", "amount", "currency", "is_intercompany", "counterparty_entity", "adjustment_flag",
            "adjustment_type",
        ]
        need = set(names)
        own = need & {"is_intercompany", "counterparty_entity"}
        df = self.table("lineitem").withColumns({
            "_flagged": F.expr("l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1"), "_regular": F.col("l_returnflag") == "N",
        })
        if own or "adjustment_type" in need:
            df = df.join(self._orders(bool(own)), F.col("l_orderkey") == F.col("o_orderkey"))
        if need & {"account_code", "amount"}:
            df = df.join(self._parts, F.col("l_partkey") == F.col("p_partkey"))
        if own or need & {"entity_code", "business_unit", "region", "segment"}:
            df = df.join(self._suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            df = df.join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
        if own:
            partners = self.table("nation").select(
                F.col("n_nationkey").alias("cn_key"),
                F.col("n_name").alias("cn_name"),
                F.col("n_regionkey").alias("cn_region"),
            )
            df = df.join(partners, F.col("c_nationkey") == F.col("cn_key"))
        brand = "CAST(substring_index(p_brand, '#', -1) AS INT)"
        between = "n_regionkey = cn_region AND n_nationkey != cn_key AND _regular"
        made = {
            "transaction_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
            "date": "CAST(l_shipdate AS TIMESTAMP)",
            "period": "concat(year(l_shipdate), 'Q', quarter(l_shipdate))",
            "account_code": "p_brand",
            "entity_code": "n_name",
            "business_unit": "concat('BU_', n_nationkey % 4)",
            "region": "r_name",
            "segment": "concat('SEG_', n_nationkey % 3)",
            "amount": f"CAST(if({brand} % 5 IN (0, 1), 1, -1) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2))",
            "currency": "'USD'",
            "is_intercompany": between,
            "counterparty_entity": f"if({between}, cn_name, NULL)",
            "adjustment_flag": "_flagged",
            "adjustment_type": "if(_flagged, o_orderpriority, NULL)",
        }
        return df.selectExpr(*[f"{made[n]} AS {n}" for n in names])

    @cached_property
    def full_mapping(self) -> DataFrame:
        brands = self.table("part").select(F.col("p_brand").alias("source_account_code")).distinct()
        return brands.select(
            "source_account_code",
            F.concat(F.lit("TGT_"), F.col("source_account_code")).alias("target_account_code"),
            brand_category(F.col("source_account_code")).alias("metric_category"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        return self.full_mapping.filter(~F.col("source_account_code").isin(*OMITTED))

    @cached_property
    def hierarchy(self) -> DataFrame:
        return self.places.select(
            F.col("n_name").alias("entity_code"),
            F.concat(F.lit("BU_"), (F.col("n_nationkey") % 4).cast("string")).alias("business_unit"),
            F.col("r_name").alias("region"),
            F.concat(F.lit("SEG_"), (F.col("n_nationkey") % 3).cast("string")).alias("segment"),
        )

    @cached_property
    def supplier_hierarchy(self) -> DataFrame:
        """One entity per supplier."""
        s = self.table("supplier").join(self.places, F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            F.col("s_name").alias("entity_code"),
            F.concat(F.lit("BU_"), (F.col("n_nationkey") % 4).cast("string")).alias("business_unit"),
            F.col("r_name").alias("region"),
            F.concat(F.lit("SEG_"), (F.col("n_nationkey") % 3).cast("string")).alias("segment"),
        )

    @cached_property
    def _reported(self) -> DataFrame:
        """What both reports are sums of, from one pass over the transactions; written once, as queries use reports several times."""
        keys = ["entity_code", "region", "period", "account_code"]
        rows = self.source(*keys, "amount", "is_intercompany").filter(~F.col("is_intercompany"))
        totals = pin(rows.groupBy(*keys).agg(F.sum("amount").alias("amount")))
        return totals.withColumn("metric", brand_category(F.col("account_code")))

    @cached_property
    def target(self) -> DataFrame:
        """Headline rows for five metrics and regional revenue rows, from one pass over the transactions."""
        totals = self._reported
        metrics = F.when(F.col("metric") == "Revenue", F.array(*[F.lit(m) for m in ("Revenue", "Gross Margin", "Operating Profit")]))
        metrics = metrics.when(F.col("metric") == "COGS", F.array(*[F.lit(m) for m in ("COGS", "Gross Margin", "Operating Profit")]))
        metrics = metrics.otherwise(F.array(F.lit("OpEx"), F.lit("Operating Profit")))
        reported_region = F.when(F.col("entity_code") == "NATION_3", "Corporate").otherwise(F.col("region"))
        headline = F.transform(metrics, lambda m: F.struct(m.alias("metric"), F.lit("Group Total").alias("group_by"), F.lit("headline").alias("row_type")))
        detail = F.when(
            F.col("metric") == "Revenue",
            F.array(F.struct(F.lit("Revenue").alias("metric"), reported_region.alias("group_by"), F.lit("detail").alias("row_type"))),
        )
        rows = totals.select("amount", F.inline(F.concat(headline, F.coalesce(detail, F.filter(headline, lambda x: F.lit(False))))))
        sums = rows.groupBy("metric", "group_by", "row_type").agg(F.sum("amount").alias("amount"))
        extra = F.when((F.col("metric") == "Operating Profit") & (F.col("row_type") == "headline"), F.lit(500000)).otherwise(F.lit(0))
        return sums.select(
            "metric", "group_by", F.lit("ALL").alias("period"),
            (F.col("amount") + extra).cast("decimal(18,2)").alias("amount"),
            F.lit("USD").alias("currency"), "row_type",
        )

    @cached_property
    def grouped_target(self) -> DataFrame:
        """Reported category totals per entity and period, without headline rows."""
        totals = self._reported.groupBy("entity_code", "period", "metric")
        return totals.agg(F.sum("amount").cast("decimal(18,2)").alias("amount"))

    @cached_property
    def run_log(self) -> DataFrame:
        """Runs of both sides of every user's feed, one per event."""
        e = self.table("events")
        status = F.create_map(*[F.lit(x) for pair in [
            ("click", "Succeeded"), ("view", "success"), ("purchase", "completed"), ("error", "FAILED"), ("signup", "RUNNING"),
        ] for x in pair])
        return e.select(
            F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("pipeline_id"),
            F.when(F.col("event_id") % 2 == 0, "source").otherwise("target").alias("side"),
            F.concat(F.lit("task_"), F.col("event_id").cast("string")).alias("task_name"),
            F.lit(None).cast("timestamp").alias("start_time"),
            F.col("ts").cast("timestamp").alias("end_time"),
            status[F.col("event_type")].alias("status"),
            F.from_json("props", "map<string,string>").alias("parameters"),
            F.col("value").alias("high_watermark"),
        )

    @cached_property
    def timed_runs(self) -> DataFrame:
        """The runs with a start up to 71 hours before their end."""
        hours = F.regexp_extract("pipeline_id", "[0-9]+", 0).cast("int") % 72
        return self.run_log.withColumn("start_time", F.col("end_time") - F.make_dt_interval(F.lit(0), hours))

    @cached_property
    def feeds(self) -> DataFrame:
        """Feeds of some nations; one feed may serve several of them."""
        n = self.table("nation").where("n_nationkey < 18").withColumn("k", F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") % 7 + 60)))
        return n.select(F.concat(F.lit("P"), F.col("k").cast("string")).alias("pipeline_id"), F.col("n_name").alias("entity_code"))

    @cached_property
    def fed_tables(self) -> DataFrame:
        """Tables of some nations."""
        n = self.table("nation").where("n_nationkey % 4 = 1")
        return n.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("table_name"), F.col("n_name").alias("entity_code"))

    @cached_property
    def inventory(self) -> DataFrame:
        """Columns of two versions of many tables."""
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("int")
        rows = e.select(
            F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("table_name"),
            F.when(F.col("event_id") % 2 == 0, "old").otherwise("new").alias("version"),
            F.concat(F.lit("c"), (k % 25).cast("string")).alias("column_name"),
            F.when(k % 3 == 0, "string").when(k % 3 == 1, "double").otherwise("bigint").alias("data_type"),
        )
        return rows.groupBy("table_name", "version", "column_name").agg(F.min("data_type").alias("data_type"))

    @cached_property
    def cells(self) -> DataFrame:
        """Code cells written from the parts, and every document as a cell of its source."""
        p = self.table("part")
        name, kind, brand, size = F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string")
        made = [
            F.concat(F.lit("# Step 3: Load "), name, F.lit("\ndf = spark.read.parquet('x')")),
            F.concat(F.lit("def clean_"), size, F.lit("(df):\n    return df.filter(df.p_size > "), size, F.lit(").select(['p_brand', 'p_name'])")),
            F.concat(F.lit("# ===== Match "), kind, F.lit(" =====\nout = a.merge(b, on='p_partkey, p_brand', left_on=[\"x\"])")),
            F.concat(F.lit("SELECT p_brand, sum(x) AS "), F.lower(kind), F.lit("\nFROM t WHERE p_size > "), size, F.lit("\nGROUP BY p_brand, p_type, p_brand")),
            F.concat(F.lit("x.groupby(['p_type', \"p_brand\"]).agg(total).where('"), brand, F.lit("')")),
            F.lit("   "),
            F.concat(F.lit("some notes on "), name),
            F.concat(F.lit("out.write.save('"), name, F.lit("')")),
        ]
        source = F.coalesce(*[F.when(F.col("p_partkey") % 8 == i, m) for i, m in enumerate(made)])
        code = p.select(
            F.concat(F.lit("nb_"), (F.col("p_partkey") % 50).cast("string")).alias("notebook_id"),
            F.col("p_partkey").alias("cell_index"),
            F.when(F.col("p_partkey") % 8 == 6, "markdown").otherwise("code").alias("cell_type"),
            source.alias("cell_source"),
        )
        texts = self.table("documents").select(
            F.coalesce("source", F.lit("none")).alias("notebook_id"), F.col("doc_id").alias("cell_index"),
            F.lit("code").alias("cell_type"), F.col("text").alias("cell_source"),
        )
        return code.unionByName(texts)

    @cached_property
    def names(self) -> DataFrame:
        """Part names as mapped codes."""
        return self.table("part").select(F.col("p_name").alias("source_account_code")).distinct().select(
            "source_account_code",
            F.concat(F.lit("TGT_"), F.col("source_account_code")).alias("target_account_code"),
            F.initcap(F.substring_index("source_account_code", " ", 1)).alias("metric_category"),
        )

    @cached_property
    def odd_names(self) -> DataFrame:
        """Every part twice: its name with the words swapped, and with the third letter dropped."""
        n = F.col("p_name")
        swapped = F.concat_ws(" ", F.substring_index(n, " ", -1), F.substring_index(n, " ", 1))
        dropped = F.concat(F.substring(n, 1, 2), F.substring(n, 4, 100))
        return self.table("part").select(
            F.explode(F.array(swapped, dropped)).alias("account_code"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("amount"),
        )


PRELUDE = """
supplier_hierarchy AS (
  SELECT s_name AS entity_code, 'BU_' || (n_nationkey % 4) AS business_unit, r_name AS region, 'SEG_' || (n_nationkey % 3) AS segment
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
recon_full_mapping AS (
  SELECT DISTINCT p_brand AS source_account_code, 'TGT_' || p_brand AS target_account_code,
    CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) % 5 IN (0, 1) THEN 'Revenue'
         WHEN CAST(split_part(p_brand, '#', 2) AS INT) % 5 IN (2, 3) THEN 'COGS' ELSE 'OpEx' END AS metric_category
  FROM part),
recon_mapping AS (
  SELECT * FROM recon_full_mapping WHERE source_account_code NOT IN ('Brand#11', 'Brand#15', 'Brand#22')),
recon_hierarchy AS (
  SELECT n_name AS entity_code, 'BU_' || (n_nationkey % 4) AS business_unit, r_name AS region,
    'SEG_' || (n_nationkey % 3) AS segment
  FROM nation JOIN region ON n_regionkey = r_regionkey),
recon_source AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
    l_shipdate AS date, year(l_shipdate) || 'Q' || quarter(l_shipdate) AS period,
    p_brand AS account_code, sn.n_name AS entity_code, 'BU_' || (sn.n_nationkey % 4) AS business_unit,
    r_name AS region, 'SEG_' || (sn.n_nationkey % 3) AS segment,
    CAST(CASE WHEN m.metric_category = 'Revenue' THEN CAST(l_extendedprice AS DECIMAL(18,2))
         ELSE -CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount,
    'USD' AS currency,
    (sn.n_regionkey = cn.n_regionkey AND sn.n_nationkey <> cn.n_nationkey AND l_returnflag = 'N') AS is_intercompany,
    CASE WHEN sn.n_regionkey = cn.n_regionkey AND sn.n_nationkey <> cn.n_nationkey AND l_returnflag = 'N'
         THEN cn.n_name END AS counterparty_entity,
    (l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1) AS adjustment_flag,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1 THEN o_orderpriority END AS adjustment_type
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey
    JOIN region ON sn.n_regionkey = r_regionkey
    JOIN recon_full_mapping m ON p_brand = m.source_account_code),
recon_reported AS (
  SELECT s.*, m.metric_category AS category FROM recon_source s
  JOIN recon_full_mapping m ON s.account_code = m.source_account_code WHERE NOT is_intercompany),
recon_target AS (
  SELECT metric, 'Group Total' AS group_by, 'ALL' AS period, CAST(sum(amount) + any_value(extra) AS DECIMAL(18,2)) AS amount,
    'USD' AS currency, 'headline' AS row_type
  FROM (SELECT category AS metric, amount, 0 AS extra FROM recon_reported
        UNION ALL SELECT 'Gross Margin', amount, 0 FROM recon_reported WHERE category IN ('Revenue', 'COGS')
        UNION ALL SELECT 'Operating Profit', amount, 500000 FROM recon_reported) GROUP BY metric
  UNION ALL
  SELECT 'Revenue', CASE WHEN entity_code = 'NATION_3' THEN 'Corporate' ELSE region END, 'ALL',
    CAST(sum(amount) AS DECIMAL(18,2)), 'USD', 'detail'
  FROM recon_reported WHERE category = 'Revenue' GROUP BY 1, 2),
recon_grouped_target AS (
  SELECT entity_code, period, category AS metric, CAST(sum(amount) AS DECIMAL(18,2)) AS amount
  FROM recon_reported GROUP BY ALL),
run_log AS (
  SELECT 'P' || user_id AS pipeline_id, CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'target' END AS side,
    'task_' || event_id AS task_name, CAST(NULL AS TIMESTAMP) AS start_time, ts AS end_time,
    CASE event_type WHEN 'click' THEN 'Succeeded' WHEN 'view' THEN 'success' WHEN 'purchase' THEN 'completed'
      WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status,
    json_extract_string(props, '$.k') AS param_k, value AS high_watermark
  FROM events),
timed_runs AS (
  SELECT *, end_time - to_hours((CAST(substr(pipeline_id, 2) AS INT) % 72)::INT) AS begun FROM run_log),
feeds AS (
  SELECT DISTINCT 'P' || k AS pipeline_id, n_name AS entity_code FROM nation, unnest([n_nationkey, n_nationkey % 7 + 60]) AS t(k) WHERE n_nationkey < 18),
fed_tables AS (SELECT 'T' || n_nationkey AS table_name, n_name AS entity_code FROM nation WHERE n_nationkey % 4 = 1),
inventory AS (
  SELECT 'T' || user_id AS table_name, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS version,
    'c' || (CAST(json_extract_string(props, '$.k') AS INT) % 25) AS column_name,
    min(CASE CAST(json_extract_string(props, '$.k') AS INT) % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'double' ELSE 'bigint' END) AS data_type
  FROM events GROUP BY 1, 2, 3),
cells AS (
  SELECT 'nb_' || (p_partkey % 50) AS notebook_id, p_partkey AS cell_index, CASE WHEN p_partkey % 8 = 6 THEN 'markdown' ELSE 'code' END AS cell_type,
    CASE p_partkey % 8
      WHEN 0 THEN '# Step 3: Load ' || p_name || chr(10) || 'df = spark.read.parquet(''x'')'
      WHEN 1 THEN 'def clean_' || p_size || '(df):' || chr(10) || '    return df.filter(df.p_size > ' || p_size || ').select([''p_brand'', ''p_name''])'
      WHEN 2 THEN '# ===== Match ' || p_type || ' =====' || chr(10) || 'out = a.merge(b, on=''p_partkey, p_brand'', left_on=["x"])'
      WHEN 3 THEN 'SELECT p_brand, sum(x) AS ' || lower(p_type) || chr(10) || 'FROM t WHERE p_size > ' || p_size || chr(10) || 'GROUP BY p_brand, p_type, p_brand'
      WHEN 4 THEN 'x.groupby([''p_type'', "p_brand"]).agg(total).where(''' || p_brand || ''')'
      WHEN 5 THEN '   ' WHEN 6 THEN 'some notes on ' || p_name ELSE 'out.write.save(''' || p_name || ''')' END AS cell_source
  FROM part
  UNION ALL SELECT coalesce(source, 'none'), doc_id, 'code', text FROM documents),
name_mapping AS (
  SELECT DISTINCT p_name AS source_account_code, 'TGT_' || p_name AS target_account_code,
    upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS metric_category FROM part),
odd_names AS (
  SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS account_code, CAST(p_retailprice AS DECIMAL(18,2)) AS amount FROM part
  UNION ALL SELECT substr(p_name, 1, 2) || substr(p_name, 4), CAST(p_retailprice AS DECIMAL(18,2)) FROM part)
"""


def sql(body: str) -> str:
    """The body with the shared tables in front; a body may start with further expressions (``, x AS (...)``)."""
    body = body.strip()
    if body.startswith(","):
        return "WITH RECURSIVE " + PRELUDE.strip() + body
    return "WITH RECURSIVE " + PRELUDE.strip() + "\n" + body
