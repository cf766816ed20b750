"""Account aggregates, column inventories and run histories of remote platforms, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tieout import defaults as D
from tieout.scale import running_total
from tieout.sources.types import leaf_dtypes

CELL_DELIMITER = "# COMMAND ----------"  # fixed value: line between the cells of an exported notebook
INVENTORY = T.StructType([T.StructField(c, T.StringType()) for c in ("table_name", "version", "column_name", "data_type")])


def _turnover(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("account_code").agg(
        F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("row_count"), F.sum(F.abs("amount")).alias("turnover")
    )


def account_aggregates(transactions: DataFrame, n: int = D.CONNECTOR_ROWS) -> DataFrame:
    """Sum and rows of the ``n`` accounts with the largest turnover (a top-n report of the source)."""
    return _turnover(transactions).orderBy(F.desc("turnover"), "account_code").limit(n).drop("turnover")


def aggregates_as_source(transactions: DataFrame) -> DataFrame:
    """Aggregates of all accounts in the shape of transactions, numbered from zero by falling turnover.

    The numbers are a running total over slices, so no task has to order all accounts.
    """
    ones = _turnover(transactions).withColumn("_one", F.lit(1).cast("long"))
    numbered = running_total(ones, [], [F.desc("turnover"), F.asc("account_code")], "_one", "_n")
    number = F.col("_n") - 1
    return numbered.select(
        number.cast("string").alias("transaction_id"),
        F.coalesce("account_code", F.lit("unknown")).alias("account_code"),
        F.lit("CONNECTOR").alias("entity_code"),
        F.coalesce("total_amount", F.lit(0)).alias("amount"),
        F.col("row_count").alias("transaction_count"),
        F.lit(False).alias("is_intercompany"),
        F.lit(False).alias("adjustment_flag"),
        F.lit(D.DEFAULT_CURRENCY).alias("currency"),
    )


def inventory_of(df: DataFrame, table: str, version: str, nested: bool = False) -> DataFrame:
    """Columns and types of one table version; only its schema is read."""
    return inventory({table: df}, version, nested)


def inventory(tables: dict[str, DataFrame], version: str, nested: bool = False) -> DataFrame:
    """Columns and types of several tables; only their schemas are read. With ``nested`` a row for each leaf of a type."""
    kinds = leaf_dtypes if nested else (lambda df: df.dtypes)
    rows = [(table, version, name, kind) for table, df in tables.items() for name, kind in kinds(df)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, INVENTORY)


def catalog_inventory(spark: SparkSession, version: str, database: str | None = None) -> DataFrame:
    """Columns of all tables of a database in the session's catalog."""
    rows = [
        (t.name, version, c.name, c.dataType)
        for t in spark.catalog.listTables(database)
        for c in spark.catalog.listColumns(t.name if t.isTemporary or not database else f"{database}.{t.name}")
    ]
    return spark.createDataFrame(rows, INVENTORY)


def epoch_millis(value: Column) -> Column:
    """Milliseconds since 1970 as a timestamp, null for anything else."""
    return F.timestamp_millis(value.cast("string").try_cast("bigint"))


def text_map(value: Column) -> Column:
    """JSON object as a map of texts."""
    return F.from_json(value, "map<string,string>")


def run_history(
    rows: DataFrame, names: dict[str, str], millis: bool = False, extra: list[str] = ("pipeline_id", "side")
) -> DataFrame:
    """Run records of one platform in the common shape.

    ``names`` gives the platform's column for each common field; a missing one becomes null. Times
    are epoch milliseconds or ISO texts, parameters JSON objects.
    """
    def field(name):
        return F.col(names[name]) if names.get(name) in rows.columns else F.lit(None).cast("string")

    when = (lambda n: epoch_millis(field(n))) if millis else (lambda n: field(n).cast("string").try_cast("timestamp"))
    kind = rows.schema[names["parameters"]].dataType if names.get("parameters") in rows.columns else None
    parameters = field("parameters") if isinstance(kind, T.MapType) else text_map(field("parameters"))
    return rows.select(
        *extra,
        field("task_name").cast("string").alias("task_name"),
        when("start_time").alias("start_time"),
        when("end_time").alias("end_time"),
        F.coalesce(field("status").cast("string"), F.lit("unknown")).alias("status"),
        parameters.alias("parameters"),
        field("high_watermark").cast("string").try_cast("double").alias("high_watermark"),
    )


def all_runs(*histories: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, histories)


def notebook_cells(notebooks: DataFrame, delimiter: str = CELL_DELIMITER) -> DataFrame:
    """Cells of exported notebooks (notebook_id, content): trimmed, numbered from zero, without empty ones."""
    trimmed = F.transform(F.split("content", "\\Q" + delimiter + "\\E"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return notebooks.select("notebook_id", F.posexplode(F.filter(trimmed, lambda c: c != "")).alias("cell_index", "cell_source")).select(
        "notebook_id", "cell_index", F.lit("code").alias("cell_type"), "cell_source"
    )
