from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tieout import defaults as D
from tieout.functions import category, flag, period_key, token_sorted
from tieout.operators import validation as V
from tieout.sources import files, remote, sinks


def test_plain_and_canonical_names(rows):
    df = files.canonical_names(files.plain_names(rows("` Txn ID ` string, `GL Account` string, Value string", ("1", "a", "2"))), D.SOURCE_ALIASES)
    assert df.columns == ["transaction_id", "account_code", "amount"]


def test_exact_alias_wins_over_part_of_a_name(rows):
    df = files.canonical_names(rows("account_name string, account string", ("x", "1")), {"account_code": ["account"]})
    assert df.columns == ["account_name", "account_code"]


def test_canonical_name_is_kept(rows):
    df = files.canonical_names(rows("amount int, net int", (1, 2)), D.SOURCE_ALIASES)
    assert df.columns == ["amount", "net"]


def test_load_source_coerces(rows):
    raw = rows(
        "transaction_id string, date string, account_code string, entity_code string, amount string, is_intercompany string",
        ("1", "2024-02-03", "a", "e", "12.50", "False"), ("2", "x", "a", "e", "abc", "yes"), ("3", "2024-12-31", "a", "e", "1,000", None),
    )
    got = {r.transaction_id: r for r in files.load_source(raw).collect()}
    assert [got[k].amount for k in "123"] == [Decimal("12.50"), Decimal(0), Decimal(0)]
    assert [got[k].period for k in "123"] == ["2024Q1", None, "2024Q4"]
    assert got["1"].date == datetime(2024, 2, 3) and got["2"].date is None
    assert [got[k].is_intercompany for k in "123"] == [False, True, False]
    assert got["1"].currency == "USD" and got["1"].counterparty_entity is None and got["1"].adjustment_flag is False


def test_load_source_other_date_format(rows):
    raw = rows("date string, amount string", ("03/02/2024", "1"))
    assert files.load_source(raw, ("dd/MM/yyyy",)).first().date == datetime(2024, 2, 3)


def test_load_source_without_amount(rows):
    assert files.load_source(rows("transaction_id string", ("1",))).first().amount == 0


def test_load_mapping_and_target(rows):
    m = files.load_mapping(rows("`From Account` string, `To Account` string, Category string", ("1", "T1", "cost of goods sold")))
    assert m.columns == ["source_account_code", "target_account_code", "metric_category"] and m.first().metric_category == "COGS"
    assert files.load_mapping(rows("source_account_code string, target_account_code string", ("1", "t"))).first().metric_category == "Revenue"
    t = files.load_target(rows("KPI string, Region string, Quarter string, Expected string", ("Revenue", "EU", "2024-Q1", "7")))
    assert t.columns == ["metric", "group_by", "period", "amount"] and t.first().amount == 7


def test_load_hierarchy(rows):
    assert "entity_code" in files.load_hierarchy(rows("`Legal Entity Code` string, Region string", ("a", "b"))).columns
    assert files.load_hierarchy(rows("Name string", ("a",))).columns == ["name"]


def test_categories(rows):
    texts = ["cost of revenue", "Electricity", "SG&A costs", "sga", "R&D", "G&A Expenses", "office supplies", None, "Net Sales"]
    got = [r.c for r in rows("i int, t string", *enumerate(texts)).orderBy("i").select(category(F.col("t")).alias("c")).collect()]
    assert got == ["Revenue", "Intercompany", "OpEx", "OpEx", "R&d", "OpEx", "Intercompany", None, "Revenue"]


def test_flags_periods_tokens(rows):
    texts = ["True", "1", "Yes", "False", "0", "maybe", "", None]
    got = [r.f for r in rows("i int, t string", *enumerate(texts)).orderBy("i").select(flag(F.col("t")).alias("f")).collect()]
    assert got == [True, True, True, False, False, False, False, False]
    one = rows("p string, t string", ("2024-Q1", "  b  a\tc ")).select(period_key(F.col("p")).alias("p"), token_sorted(F.col("t")).alias("t")).first()
    assert (one.p, one.t) == ("2024Q1", "a b c")


def test_read_table_formats(spark, rows, tmp_path):
    df = rows("a string, b string", ("1", "x"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.createOrReplaceTempView("some_table")
    for path in (str(tmp_path / "t.csv"), str(tmp_path / "t.parquet"), "some_table"):
        assert files.read_table(spark, path).collect() == df.collect()


def test_inventory(spark, rows):
    rows("a string, b int", ("1", 2)).createOrReplaceTempView("inventory_check")
    got = remote.catalog_inventory(spark, "v1").filter("table_name = 'inventory_check'").collect()
    assert {(r.column_name, r.data_type) for r in got} == {("a", "string"), ("b", "int")}
    one = remote.inventory_of(rows("x double", (1.0,)), "t", "v2").first()
    assert tuple(one) == ("t", "v2", "x", "double")


def test_epoch_millis_and_parameters(rows):
    raw = rows("k string, s string, e string, p string", ("1", "1700000000123", "soon", '{"a": 1, "b": "x"}'))
    run = remote.run_history(raw, {"task_name": "k", "start_time": "s", "end_time": "e", "parameters": "p"}, millis=True, extra=[]).first()
    assert run.start_time == datetime(2023, 11, 14, 22, 13, 20, 123000) and run.end_time is None
    assert run.parameters == {"a": "1", "b": "x"} and run.status == "unknown" and run.high_watermark is None


def test_warnings(rows):
    empty = rows("amount string")
    good = rows("metric string, amount double", ("m", 1.0))
    got = {(r.check, r.table_name) for r in V.table_warnings(empty, rows("a int", (1,)), good).collect()}
    assert got == {("empty", "source"), ("missing_column", "source"), ("not_numeric", "source"), ("missing_column", "mapping")}


def test_report_and_audit(spark, rows, tmp_path):
    nested = rows("a string, l array<string>", ("x", ["1", "2"]))
    sinks.write_report({"one": nested}, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/one")).first().l == '["1","2"]'
    sinks.write_report({"one": nested}, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet/one")).collect() == nested.collect()
    entry = spark.createDataFrame([(datetime(2024, 1, 1), "Fix", "how", 2.0, 1.0, 1.0, 0.95, ["a"])], sinks.AUDIT)
    folder = str(tmp_path / "audit")
    sinks.append_audit(entry, folder)
    sinks.append_audit(entry, folder)
    assert sinks.read_audit(spark, folder).count() == 2
    sinks.reset_audit(spark, folder)
    assert sinks.read_audit(spark, folder).count() == 0
