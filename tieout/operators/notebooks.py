"""Transformation steps read from the text of notebook cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieout.scale import SLICE_ROWS, pin

# Patterns and keywords that mark steps, in order of precedence.
NAME_PATTERNS = [
    r"(?im)#\s*(?:Step|STEP)\s*\d*[:\-–]?\s*(.+)",
    r"(?im)def\s+(\w+)\s*\(",
    r"(?im)# ==+\s*(.+?)\s*==+",
    r"(?im)spark\.sql\(.*?--\s*(.+?)\n",
]
STEP_KINDS = [
    ("join", ["join", "merge", "lookup"]),
    ("aggregate", ["groupby", "group by", "agg(", "aggregate", "sum(", "count("]),
    ("filter", ["filter", "where", "dropna", "drop_duplicates"]),
    ("ingest", ["read_", "load", "spark.read", "pd.read"]),
    ("write", ["write", "save", "to_delta", "to_parquet", "to_excel"]),
    ("transform", ["select", "withcolumn", "rename", "cast"]),
]
JOIN_KEYS = r"""(?:on|left_on|right_on)\s*=\s*["'\[]([^"'\]]+)"""
FILTER_CALL = r"\.filter\(([^)]{3,})\)"
WHERE_CLAUSE = r"(?is)WHERE\s+(.+?)(?:GROUP|ORDER|LIMIT|$)"
GROUP_CALL = r"(?i)groupby\(\[?([^\])]+)\]?\)"
GROUP_CLAUSE = r"(?is)GROUP BY\s+(.+?)(?:HAVING|ORDER|LIMIT|$)"
SELECT_CALL = r"(?i)\.select\(\[?([^\])]+)\]?\)"
SELECT_CLAUSE = r"(?is)SELECT\s+(.+?)\s+FROM"
BLANKS = r"^\s+|\s+$"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def _found(source: Column, pattern: str) -> Column:
    return F.regexp_extract_all(source, F.lit(pattern), 1)


def _names(matches: Column, quotes: bool = True) -> Column:
    """Comma-separated names of every match."""
    def split(text):
        return F.transform(F.split(text, ","), lambda p: F.regexp_replace(_strip(p), "^[\"']+|[\"']+$", "") if quotes else _strip(p))

    return F.flatten(F.transform(matches, split))


def _distinct(values: Column, first: int | None) -> Column:
    return F.slice(F.array_distinct(values), 1, first) if first else F.array_distinct(values)


def _cut(text: Column, first: int | None) -> Column:
    return F.substring(text, 1, first) if first else text


def step_name(source: Column, index: Column, first: int | None = None) -> Column:
    """Name from the first pattern that fits, in snake case (its ``first`` characters if given); else ``step_<index>``."""
    found = [F.when(source.rlike(p), F.regexp_extract(source, p, 1)) for p in NAME_PATTERNS]
    named = F.replace(F.lower(_cut(_strip(F.coalesce(*found)), first)), F.lit(" "), F.lit("_"))
    return F.coalesce(named, F.concat(F.lit("step_"), index.cast("string")))


def step_kind(source: Column) -> Column:
    text = F.lower(source)
    kinds = []
    for kind, words in STEP_KINDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        kinds.append(F.when(hit, F.lit(kind)))
    return F.coalesce(*kinds, F.lit("unknown"))


def notebook_steps(cells: DataFrame, most: int | None = None, name_chars: int | None = None, filter_chars: int | None = None) -> DataFrame:
    """One step per non-empty code cell: name, kind, join keys, filters, group columns, output columns.

    Everything is kept; ``most`` cuts each list to its first entries, ``name_chars`` and ``filter_chars`` cut the texts.
    """
    source = F.col("cell_source")
    code = cells.filter((F.coalesce(F.col("cell_type"), F.lit("code")) == "code") & (F.length(_strip(source)) > 0))
    calls = F.transform(_found(source, FILTER_CALL), lambda t: _cut(_strip(t), filter_chars))
    clauses = F.transform(_found(source, WHERE_CLAUSE), lambda t: F.replace(_cut(_strip(t), filter_chars), F.lit("\n"), F.lit(" ")))
    groups = F.concat(_names(_found(source, GROUP_CALL)), _names(_found(source, GROUP_CLAUSE), quotes=False))
    selected = _names(_found(source, SELECT_CALL))
    output = F.when(F.size(selected) > 0, selected).otherwise(_names(_found(source, SELECT_CLAUSE), quotes=False))
    return code.select(
        "notebook_id",
        F.col("cell_index").alias("step_index"),
        step_name(source, F.col("cell_index"), name_chars).alias("step_name"),
        step_kind(source).alias("transform_type"),
        _distinct(_names(_found(source, JOIN_KEYS)), most).alias("join_keys"),
        _distinct(F.concat(calls, clauses), most).alias("filter_conditions"),
        _distinct(groups, most).alias("aggregation_columns"),
        _distinct(output, most).alias("output_schema"),
        F.length(source).alias("cell_length_chars"),
    )


# The steps assumed when no notebook is known.
ASSUMED_STEPS = [
    ("source_ingest", 0, "ingest", [], [], [], []),
    ("mapping_apply", 1, "lookup_join", ["account_code", "source_account_code"], [], [], []),
    ("metric_aggregation", 2, "aggregate", [], ["is_intercompany == False"], ["amount"], ["metric_category", "amount"]),
]


def steps_or_assumed(steps: DataFrame) -> DataFrame:
    """The steps themselves, or the assumed ones when there are none."""
    if not steps.isEmpty():
        return steps
    lists = ["join_keys", "filter_conditions", "aggregation_columns", "output_schema"]
    schema = "step_name string, step_index int, transform_type string, " + ", ".join(f"{c} array<string>" for c in lists)
    return steps.unionByName(steps.sparkSession.createDataFrame(ASSUMED_STEPS, schema), allowMissingColumns=True)


def step_edges(steps: DataFrame) -> DataFrame:
    """Edge from every step to the next one of its notebook; steps without a notebook belong together.

    Steps are range-partitioned by notebook and index and written once. Inside a slice the step before is the row before;
    for the first step of a notebook in a slice it is the last step of that notebook in the slices before, of which
    there is one row per notebook and slice.
    """
    rows = pin(steps.select("notebook_id", "step_index", "step_name"))
    least = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(least, -(-rows.count() // SLICE_ROWS))  # a slice stays as large however many steps there are
    ranged = pin(rows.repartitionByRange(slices, "notebook_id", "step_index").withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy("_slice", "notebook_id").orderBy("step_index")
    before = ranged.withColumn("_before", F.lag("step_name").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    lasts = ranged.groupBy("notebook_id", "_slice").agg(F.max_by("step_name", "step_index").alias("_last"))
    earlier = Window.partitionBy("notebook_id").orderBy("_slice")
    lasts = lasts.select(F.col("notebook_id").alias("_notebook"), F.col("_slice").alias("_of"), F.lag("_last").over(earlier).alias("_carried"))
    carried = lasts.filter(F.col("_carried").isNotNull())
    match = F.col("notebook_id").eqNullSafe(F.col("_notebook")) & (F.col("_slice") == F.col("_of")) & F.col("_first")
    joined = before.join(carried, match, "left").withColumn("from_step", F.coalesce("_before", "_carried"))
    return joined.filter(F.col("from_step").isNotNull()).select(
        "notebook_id", "step_index", "from_step", F.col("step_name").alias("to_step"), F.lit("sequential").alias("edge_type")
    )
