"""Queries on reading, inventories, reports, the audit trail and warnings, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tieout.operators import schema_diff, validation as V
from tieout.scale import application_folder
from tieout.sources import files, footers, remote, sinks
from verification.registry import query
from verification.views import TABLES


def _scratch(spark) -> str:
    return f"{application_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, value FROM events", raw=True)
def read_table(spark, folder):
    """A table read from its files."""
    return files.read_table(spark, f"{folder}/events.parquet").select("event_id", "user_id", "event_type", "value")


@query(
    """
    SELECT table_name, 'v1' AS version, column_name,
      CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
        WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS data_type
    FROM duckdb_columns() WHERE table_name IN ('orders', 'customer', 'events', 'embeddings') AND NOT internal
    """,
    raw=True,
)
def column_inventory(spark, folder):
    """Columns and types of several given tables."""
    names = ("orders", "customer", "events", "embeddings")
    return remote.inventory({name: files.read_table(spark, f"{folder}/{name}.parquet") for name in names}, "v1")


TYPES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
        WHEN 'FLOAT[]' THEN 'float' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date' ELSE data_type END"""


@query(
    f"""
    SELECT table_name, 'v1' AS version, column_name || CASE WHEN data_type LIKE '%[]' THEN '[]' ELSE '' END AS column_name, {TYPES} AS data_type, 1::BIGINT AS file_count
    FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings',
      'pages', 'benchmark', 'labels', 'conversations') AND NOT internal
    """,
    raw=True,
)
def footer_inventory(spark, folder):
    """Columns of all given tables, from footers that tasks read."""
    return footers.file_inventory(spark, {name: f"{folder}/{name}.parquet" for name in TABLES}, "v1", per_task=4)


def _two_versions(spark, folder):
    """Orders and embeddings in two versions that differ deep in a struct, in an array of structs and in a plain column."""
    orders, vectors = (files.read_table(spark, f"{folder}/{name}.parquet") for name in ("orders", "embeddings"))
    price = F.struct(F.col("o_totalprice").alias("amount"), F.lit("USD").alias("currency"))
    more = F.struct(F.col("o_totalprice").cast("string").alias("amount"), F.lit("USD").alias("currency"), F.lit(1).alias("scale"))
    line = lambda p: F.struct("o_orderkey", F.struct("o_orderpriority", p.alias("price")).alias("detail"), F.array(F.struct(p.alias("p"))).alias("parts"))
    old = {"orders": orders.select(line(price).alias("o")), "embeddings": vectors.select(F.struct(*vectors.columns).alias("v"))}
    new = {"orders": orders.select(line(more).alias("o")), "embeddings": vectors.select(F.struct(*vectors.columns[:-1]).alias("v"), F.lit(True).alias("checked"))}
    return remote.inventory(old, "old", nested=True).unionByName(remote.inventory(new, "new", nested=True))


@query(
    """
    WITH last AS (SELECT column_name, data_type FROM duckdb_columns() WHERE table_name = 'embeddings' AND NOT internal ORDER BY column_index DESC LIMIT 1)
    SELECT 'embeddings' AS table_name, 'v.' || column_name || CASE WHEN data_type LIKE '%[]' THEN '[]' ELSE '' END AS column_name, 'new' AS missing_in FROM last
    UNION ALL SELECT 'embeddings', 'checked', 'old'
    UNION ALL SELECT 'orders', 'o.detail.price.scale', 'old' FROM (SELECT 1 FROM duckdb_columns() WHERE table_name = 'orders' AND column_name = 'o_totalprice')
    UNION ALL SELECT 'orders', 'o.parts[].p.scale', 'old'
    """,
    raw=True,
)
def nested_missing_columns(spark, folder):
    """Leaves that only one of two versions has."""
    return schema_diff.missing_columns(_two_versions(spark, folder), "old", "new")


@query(
    """
    SELECT 'orders' AS table_name, p || '.amount' AS column_name, lower(data_type) AS old_type, 'string' AS new_type
    FROM duckdb_columns(), (SELECT unnest(['o.detail.price', 'o.parts[].p']) AS p) WHERE table_name = 'orders' AND column_name = 'o_totalprice'
    """,
    raw=True,
)
def nested_type_drift(spark, folder):
    """Leaves whose type differs between two versions."""
    return schema_diff.type_drift(_two_versions(spark, folder), "old", "new")


@query(
    """
    WITH lines AS (
      SELECT o_orderkey AS k, 'part_' || (o_orderkey % 3) AS f, CASE WHEN o_orderkey % 11 = 0 THEN 'short' WHEN o_orderkey % 13 = 0 THEN 'long' WHEN o_orderkey % 17 = 0 THEN 'not a number' ELSE 'good' END AS kind FROM orders)
    SELECT f AS file, count(*) FILTER (kind = 'good') AS good, count(*) FILTER (kind <> 'good') AS bad, sum(k) FILTER (kind = 'good')::BIGINT AS key_sum,
      count(*) FILTER (kind = 'short') AS short, count(*) FILTER (kind = 'long') AS long FROM lines GROUP BY f
    """,
    raw=True,
)
def broken_lines(spark, folder):
    """Orders as text files in which some lines are short, long or hold a word for a number; counts per file from both tables."""
    orders = files.read_table(spark, f"{folder}/orders.parquet")
    key = F.col("o_orderkey")
    plain = F.concat_ws(",", key, F.col("o_totalprice").cast("string"), "o_orderpriority")
    line = F.when(key % 11 == 0, key.cast("string")).when(key % 13 == 0, F.concat(plain, F.lit(",x,y")))
    line = line.when(key % 17 == 0, F.concat_ws(",", key, F.lit("many"), "o_orderpriority")).otherwise(plain)
    path = _scratch(spark)
    orders.select(line.alias("value"), F.concat(F.lit("part_"), (key % 3).cast("string")).alias("file")).write.partitionBy("file").text(path)
    read = files.read_checked(spark, f"{path}/file=*", "o_orderkey long, o_totalprice double, o_orderpriority string", header=False)
    files.write_quarantine(read.bad, f"{path}-bad")
    bad = spark.read.parquet(f"{path}-bad")
    name = lambda c: F.regexp_extract(c, "file=([^/]+)", 1).alias("file")
    fields = F.size(F.split("line", ","))
    counts = read.good.groupBy(name("source_file")).agg(F.count(F.lit(1)).alias("good"), F.lit(0).cast("long").alias("bad"), F.sum("o_orderkey").alias("key_sum"), F.lit(0).cast("long").alias("short"), F.lit(0).cast("long").alias("long"))
    broken = bad.groupBy(name("source_file")).agg(F.lit(0).cast("long").alias("good"), F.count(F.lit(1)).alias("bad"), F.lit(None).cast("long").alias("key_sum"), F.count_if(fields < 3).alias("short"), F.count_if(fields > 3).alias("long"))
    return counts.unionByName(broken).groupBy("file").agg(*[F.sum(c).alias(c) for c in ("good", "bad", "key_sum", "short", "long")])


@query(
    """
    SELECT o_orderpriority AS priority, count(*) AS row_count, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
      count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1
    """,
    raw=True,
)
def written_report(spark, folder):
    """All orders written as a text report into the shared folder and read back."""
    orders = files.read_table(spark, f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    path = _scratch(spark)
    sinks.write_report({"orders.csv": orders}, path, kind="csv")
    price = F.col("o_totalprice").cast("double")
    return files.read_table(spark, f"{path}/orders.csv").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(price).alias("lowest"), F.max(price).alias("highest"), F.count_distinct("o_custkey").alias("customers")
    )


@query(
    """
    WITH steps AS (
      SELECT o_orderpriority AS step_name, o_orderstatus AS method_used, strftime(max(o_orderdate), '%Y-%m-%d') AS recorded_on,
        max(o_totalprice) AS delta_before, min(o_totalprice) AS delta_after FROM orders GROUP BY 1, 2)
    SELECT *, delta_before - delta_after AS gap_closed, method_used || ',' || step_name AS suggestions FROM steps
    """,
    raw=True,
)
def audit_trail(spark, folder):
    """One audit entry per priority and status of all orders, appended in two runs and read back."""
    steps = files.read_table(spark, f"{folder}/orders.parquet").groupBy(F.col("o_orderpriority").alias("step_name"), F.col("o_orderstatus").alias("method_used")).agg(
        F.max("o_orderdate").alias("recorded_at"), F.max("o_totalprice").alias("delta_before"), F.min("o_totalprice").alias("delta_after")
    )
    entries = steps.withColumns(
        {"gap_closed": F.col("delta_before") - F.col("delta_after"), "confidence": F.lit(1.0), "fuzzy_suggestions_applied": F.array("method_used", "step_name")}
    )
    path = _scratch(spark)
    sinks.reset_audit(spark, path)
    sinks.append_audit(entries.where("method_used = 'O'"), path)
    sinks.append_audit(entries.where("method_used IS DISTINCT FROM 'O'"), path)
    return sinks.read_audit(spark, path).select(
        "step_name", "method_used", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_on"), "delta_before", "delta_after", "gap_closed",
        F.array_join("fuzzy_suggestions_applied", ",").alias("suggestions"),
    )


@query(
    """
    SELECT 'not_numeric' AS "check", 'source' AS table_name, 'source amount is not a number' AS message
    UNION ALL SELECT 'empty', 'source', 'source has no rows' WHERE NOT EXISTS (SELECT 1 FROM orders)
    UNION ALL SELECT 'empty', 'mapping', 'mapping has no rows' WHERE NOT EXISTS (SELECT 1 FROM events WHERE value > 1e300)
    UNION ALL SELECT 'empty', 'target', 'target has no rows' WHERE NOT EXISTS (SELECT 1 FROM lineitem)
    UNION ALL SELECT 'missing_column', 'mapping', 'mapping has no column source_account_code'
    UNION ALL SELECT 'missing_column', 'target', 'target has no column metric'
    """,
    raw=True,
)
def table_warnings(spark, folder):
    """Warnings on a source whose amounts are text, a mapping without rows and keys, and a target without metrics."""
    source = files.read_table(spark, f"{folder}/orders.parquet").select(F.col("o_custkey").alias("account_code"), F.col("o_totalprice").cast("string").alias("amount"))
    mapping = files.read_table(spark, f"{folder}/events.parquet").where("value > 1e300").select("event_type")
    target = files.read_table(spark, f"{folder}/lineitem.parquet").select(F.col("l_extendedprice").alias("amount"))
    return V.table_warnings(source, mapping, target)
