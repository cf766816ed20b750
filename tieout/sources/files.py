"""Reading the four input tables with canonical column names and types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tieout import defaults as D
from tieout.functions import amount_of, category, flag, quarter_label, time_of

FORMATS = {"csv": "csv", "json": "json", "parquet": "parquet", "orc": "orc"}


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Table by name, or files by ending. CSV columns come as text, as the loaders set the types."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if "/" not in path and ending not in FORMATS:
        return spark.table(path)
    kind = FORMATS.get(ending, "parquet")
    return spark.read.options(**({"header": True} if kind == "csv" else {}) | options).format(kind).load(path)


@dataclass(frozen=True)
class Checked:
    """Rows that were read, and lines that were not: ``good`` with ``source_file``, ``bad`` with ``source_file`` and ``line``."""

    good: DataFrame
    bad: DataFrame


def read_checked(spark: SparkSession, path: str, schema: str, header: bool = True, **options) -> Checked:
    """CSV files read with a schema; lines with too few or too many fields, or with a value of another type, are kept apart.

    All fields of a line are read for both parts whatever columns are used later, so every line of every file is in one of
    them. Empty lines are no lines.
    """
    kinds = T.StructType.fromDDL(schema)
    broken = "_line"
    while broken in kinds.names:
        broken += "_"
    whole = T.StructType([*kinds.fields, T.StructField(broken, T.StringType())])
    reader = spark.read.schema(whole).options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=broken, enforceSchema=True, **options)
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("source_file"))
    every = F.hash(*kinds.names) >= -(2**31)  # always true; a line is read whole whatever columns are used
    good = rows.where(F.col(broken).isNull() & every).select(*kinds.names, "source_file")
    return Checked(good, rows.where(F.col(broken).isNotNull() & every).select("source_file", F.col(broken).alias("line")))


def write_quarantine(bad: DataFrame, folder: str) -> None:
    """Adds the lines that could not be read to the table at ``folder``."""
    bad.select("source_file", "line", F.current_timestamp().alias("found_at")).write.mode("append").parquet(folder)


def plain_names(df: DataFrame) -> DataFrame:
    """Column names trimmed, in lower case, with ``_`` for blanks."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def canonical_names(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename columns to canonical names.

    Columns equal to an alias are taken first; then, for names still missing, the first column that
    contains an alias or is part of one. A column is used once, and a canonical name already present
    is kept.
    """
    renames: dict[str, str] = {}
    exact = lambda column, alias: column == alias
    close = lambda column, alias: alias in column or column in alias
    for fits in (exact, close):
        for name, others in aliases.items():
            if name in df.columns or name in renames.values():
                continue
            free = [c for c in df.columns if c not in renames and c not in aliases]
            found = [c for c in free if any(fits(c, o) for o in others)]
            if found:
                renames[found[0]] = name
    return df.withColumnsRenamed(renames)


def load_source(raw: DataFrame, date_formats: tuple[str, ...] = ()) -> DataFrame:
    """Transactions: amounts as decimals (unreadable is zero), dates, quarters, flags and defaults."""
    df = canonical_names(plain_names(raw), D.SOURCE_ALIASES)
    zero = F.lit(0).cast("decimal(18,2)")
    changes = {"amount": amount_of(F.col("amount")) if "amount" in df.columns else zero}
    if "date" in df.columns:
        when = time_of(F.col("date"), date_formats)
        changes |= {"date": when, "period": quarter_label(when)}
    for name in ("is_intercompany", "adjustment_flag"):
        changes[name] = flag(F.col(name)) if name in df.columns else F.lit(False)
    for name, default in (("counterparty_entity", None), ("adjustment_type", None), ("currency", D.DEFAULT_CURRENCY)):
        if name not in df.columns:
            changes[name] = F.lit(default).cast("string")
    return df.withColumns(changes)


def load_mapping(raw: DataFrame, rules=None) -> DataFrame:
    """Account mapping with canonical metric categories."""
    df = canonical_names(plain_names(raw), D.MAPPING_ALIASES)
    given = "metric_category" in df.columns
    return df.withColumn("metric_category", category(F.col("metric_category"), rules) if given else F.lit(D.DEFAULT_CATEGORY))


def load_target(raw: DataFrame) -> DataFrame:
    df = canonical_names(plain_names(raw), D.TARGET_ALIASES)
    amount = amount_of(F.col("amount")) if "amount" in df.columns else F.lit(0).cast("decimal(18,2)")
    return df.withColumn("amount", amount)


def load_hierarchy(raw: DataFrame) -> DataFrame:
    """Entity hierarchy; the first column naming an entity code becomes ``entity_code``."""
    df = plain_names(raw)
    if "entity_code" in df.columns:
        return df
    found = [c for c in df.columns if "entity" in c and "code" in c]
    return df.withColumnRenamed(found[0], "entity_code") if found else df
