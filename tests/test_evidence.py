"""Overlapping spans, evidence per group, observed totals, previews, audit commits, footers, checked lines and sketches."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from tests.conftest import SMALL
from tieout.operators import control_totals, fixes, outliers, overlap, parameters, runs, sketches
from tieout.operators.enrich import fold
from tieout.operators.metrics import gaps, our_metrics, target_metrics
from tieout.plans import investigate as plan
from tieout.scale import path_of
from tieout.sources import files, footers, sinks, types
from verification.views import Views

START = datetime(2024, 1, 1)


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    hour = lambda n: START + timedelta(hours=n)
    left = [(i, rng.choice("ab"), hour(s), hour(s + rng.choice((0, 0, 1, 30, 90)))) for i, s in enumerate(rng.randrange(600) for _ in range(80))]
    right = [(i, rng.choice("ab"), hour(s), hour(s + rng.choice((0, 1, 24, 100)))) for i, s in enumerate(rng.randrange(600) for _ in range(60))]
    left += [(900, "a", None, hour(5)), (901, None, hour(0), hour(600))]
    right += [(900, "a", hour(0), None), (901, None, hour(0), hour(600)), (902, "a", hour(700), hour(690))]
    a = spark.createDataFrame(left, "l long, k string, s timestamp, e timestamp")
    b = spark.createDataFrame(right, "r long, k string, b timestamp, d timestamp")
    want = sorted((x[0], y[0]) for x in left for y in right if None not in (*x, *y) and x[1] == y[1] and y[2] < y[3] and x[2] < y[3] and x[3] >= y[2])
    for seconds in (3600, 86400, 10**7):
        got = overlap.overlapping(a, b, ("s", "e"), ("b", "d"), ["k"], seconds)
        assert sorted((r.l, r.r) for r in got.collect()) == want and got.columns.count("k") == 1
    assert len(want) > 100


def test_quarters_have_their_first_days(rows):
    got = overlap.quarter_spans(rows("period string", ("2024Q1",), ("2023-Q4",), ("2024Q1",), ("2024",), (None,))).orderBy("period").collect()
    assert [(r.period, r.period_start, r.period_end) for r in got] == [("2023-Q4", datetime(2023, 10, 1), START), ("2024Q1", START, datetime(2024, 4, 1))]


RUNS = "pipeline_id string, side string, task_name string, start_time timestamp, end_time timestamp, status string, parameters map<string,string>, high_watermark double"


def run(feed, side, day, water=1.0):
    at = START + timedelta(days=day)
    return (feed, side, "t", at - timedelta(hours=1), at, "Succeeded", {"k": "1"}, water)


def test_evidence_is_that_of_the_group(rows):
    source = rows(
        "entity_code string, period string, account_code string, amount decimal(18,2), is_intercompany boolean, counterparty_entity string, adjustment_flag boolean",
        *[(e, p, a, Decimal(1000), False, None, False) for e in ("x", "y", "z") for p in ("2024Q1", "2024Q2") for a in ("known", f"lost {e}")],
    )
    mapping = rows("source_account_code string, target_account_code string, metric_category string", ("known", "T", "Revenue"))
    target = rows("entity_code string, period string, metric string, amount decimal(18,2)", *[(e, p, "Revenue", Decimal(5000)) for e in ("x", "y", "z") for p in ("2024Q1", "2024Q2")])
    log = rows(RUNS, run("f", "source", 10, 5.0), run("f", "target", 10, 9.0), run("f", "source", 100), run("f", "target", 100), run("g", "source", 100, 2.0), run("g", "target", 100, 3.0))
    feeds = rows("pipeline_id string, entity_code string", ("f", "x"), ("g", "y"), ("f", "x"))
    drift = rows("table_name string, has_schema_drift boolean", ("t1", True), ("t2", False))
    tables = rows("table_name string, entity_code string", ("t1", "y"), ("t2", "x"))
    periods = overlap.quarter_spans(source)
    outlier = rows("account_code string", ("lost z",))
    near = rows("source_code string", ("lost x",))
    scopes = plan.Scopes(feeds=feeds, tables=tables, periods=periods)
    found = plan.investigate(source, mapping, target, by=["entity_code", "period"], run_log=log, drift=drift, fuzzy=near, outliers=outlier, scopes=scopes)
    got = {(r.entity_code, r.period): (r.watermark_gap_flag, r.run_confidence, r.has_schema_drift, r.has_fuzzy_match, r.anomalous_count) for r in found.evidence.collect()}
    assert got == {
        ("x", "2024Q1"): (True, 0.9, False, True, 0), ("x", "2024Q2"): (False, 1.0, False, True, 0), ("y", "2024Q1"): (False, 0.5, True, False, 0),
        ("y", "2024Q2"): (True, 0.9, True, False, 0), ("z", "2024Q1"): (False, 0.5, False, False, 1), ("z", "2024Q2"): (False, 0.5, False, False, 1),
    }
    details = {(r.entity_code, r.period, r.seq): r.finding for r in found.details.collect()}
    assert details["x", "2024Q1", 1] == "lost x" and details["x", "2024Q1", 3] == "f" and ("x", "2024Q2", 3) not in details and ("z", "2024Q1", 1) not in details
    whole = plan.investigate(source, mapping, target, by=["entity_code", "period"], run_log=log, drift=drift, fuzzy=near, outliers=outlier)
    assert {(r.has_schema_drift, r.anomalous_count, r.has_run_findings) for r in whole.evidence.collect()} == {(True, 1, True)}


def test_searches_run_inside_the_investigation(rows):
    names = [f"account {i:02d}" for i in range(12)]
    source = rows("account_code string, amount decimal(18,2), is_intercompany boolean, adjustment_flag boolean, entity_code string", *[(n, Decimal(10**9 if n.endswith("07") else 1000 + i), False, False, "e") for i, n in enumerate(names)])
    mapping = rows("source_account_code string, target_account_code string, metric_category string", *[(n, "T", "Revenue") for n in names[:-1]])
    target = rows("metric string, amount decimal(18,2)", ("Revenue", Decimal(1)))
    found = plan.investigate(source, mapping, target, search=True).evidence.first()
    assert found.has_fuzzy_match and found.anomalous_count >= 1
    assert plan.investigate(source, mapping, target).evidence.first().has_fuzzy_match is None


def test_totals_of_all_steps_come_from_one_read(spark, tmp_path, monkeypatch):
    spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").cast("decimal(18,2)").alias("amount")).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    steps = [("all", lambda d: d), ("some", lambda d: d.where("k > 2")), ("joined", lambda d: d.join(F.broadcast(spark.range(5).withColumnRenamed("id", "i")), F.col("k") == F.col("i"))), ("none", lambda d: d.where("k > 90"))]
    last, _ = control_totals.observed(source, steps)
    plan_text = last._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("FileScan parquet") == 1 and plan_text.count("CollectMetrics") == 4
    got = [tuple(r) for r in control_totals.step_totals(source, steps).orderBy("step").collect()]
    monkeypatch.setattr(control_totals, "_run_without_failures", lambda df: False)
    assert got == [tuple(r) for r in control_totals.step_totals(source, steps).orderBy("step").collect()]
    assert [r[2] for r in got] == [1000, 571, 286, 0] and got[3][3] == 0
    assert control_totals.step_totals(source, []).count() == 0


def test_the_job_group_of_the_caller_stays(spark):
    context = spark.sparkContext
    context.setLocalProperty("spark.jobGroup.id", "mine")
    assert control_totals._run_without_failures(spark.range(5)) and context.getLocalProperty("spark.jobGroup.id") == "mine"
    context.setLocalProperty("spark.jobGroup.id", None)


def test_previews_are_those_of_a_full_recomputation(spark):
    v = Views(spark, SMALL)
    source = v.source("entity_code", "region", "account_code", "amount", "is_intercompany", "counterparty_entity").cache()
    reported = v.grouped_target.join(v.hierarchy.select("entity_code", "region"), "entity_code").select("region", "metric", "amount")
    moves = v.hierarchy.where("entity_code IN ('NATION_3', 'NATION_8')").select("entity_code", F.lit("region").alias("field"), F.lit("Nowhere").alias("new_value"), F.lit(1).alias("seq"))
    moves = moves.unionByName(v.hierarchy.where("region = 'ASIA'").select("entity_code", F.lit("region").alias("field"), F.lit("EUROPE").alias("new_value"), F.lit(2).alias("seq")))
    lost = v.full_mapping.join(v.mapping.select("source_account_code"), "source_account_code", "left_anti").unionByName(v.mapping.limit(3))
    booked = v.hierarchy.select("entity_code", "region", F.lit("Brand#2").alias("account_code"), F.lit(17).cast("decimal(18,2)").alias("amount"), F.lit("Kind").alias("adjustment_type"))
    open_ = booked.withColumn("counterparty_entity", F.lit("NATION_1"))
    cases = [("add_mapping", lost, None), ("add_mapping", lost, v.hierarchy), ("fix_hierarchy", moves, v.hierarchy), ("add_adjustment", booked, None), ("add_adjustment", booked, v.hierarchy), ("add_elimination", open_, None), ("add_mapping", lost.limit(0), None)]
    for fix, entries, hierarchy in cases:
        for by in ([], ["region"]):
            folded = fold(source, by)
            new = [folded, v.mapping, hierarchy]
            if fix == "add_mapping":
                new[1] = fixes.add_mapping(v.mapping, entries)
            elif fix == "fix_hierarchy":
                new[2] = fixes.fix_hierarchy(hierarchy, entries)
            else:
                new[0] = (fixes.add_adjustments if fix == "add_adjustment" else fixes.add_eliminations)(folded, entries)
            target = target_metrics(reported, by)
            want = fixes.compare_gaps(gaps(our_metrics(folded, v.mapping, hierarchy, by), target, by), gaps(our_metrics(*new, by), target, by), by)
            got = fixes.preview_fix(fix, entries, source, v.mapping, reported, hierarchy, by)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), (fix, by)


ENTRY = [(START, "Fix", "how", 2.0, 1.0, 1.0, 0.95, ["a"])]


def test_audit_appends_are_whole_and_once(spark, tmp_path, monkeypatch):
    folder, entry = str(tmp_path / "audit"), spark.createDataFrame(ENTRY, sinks.AUDIT)
    assert sinks.read_audit(spark, folder).count() == 0
    assert sinks.append_audit(entry, folder, "fix 1") and not sinks.append_audit(entry, folder, "fix 1")
    assert sinks.read_audit(spark, folder).collect() == entry.collect()
    whole = sinks._named
    monkeypatch.setattr(sinks, "_named", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        sinks.append_audit(entry, folder, "fix 2")  # rows are written, the part is not named
    assert sinks.read_audit(spark, folder).count() == 1
    monkeypatch.setattr(sinks, "_named", whole)
    assert sinks.append_audit(entry, folder, "fix 2") and sinks.read_audit(spark, folder).count() == 2
    marker, fs = path_of(spark, f"{folder}/manifest/x")
    draft = marker.suffix("-1.draft")
    fs.create(draft, False).close()  # a call that broke off while naming
    assert sinks.read_audit(spark, folder).count() == 2
    assert sinks.append_audit(entry, folder) and sinks.append_audit(entry, folder) and sinks.read_audit(spark, folder).count() == 4


NESTED = "a int, b struct<c: string, d: array<struct<e: double, f: map<string, struct<g: date>>>>>, h array<array<int>>, i struct<>"


def test_leaves_of_nested_types(spark, tmp_path):
    schema = T.StructType.fromDDL(NESTED)
    assert types.leaf_columns(schema) == [
        ("a", "int"), ("b.c", "string"), ("b.d[].e", "double"), ("b.d[].f{key}", "string"), ("b.d[].f{value}.g", "date"), ("h[][]", "int"), ("i", "struct<>"),
    ]
    plain = NESTED.rsplit(",", 1)[0]
    spark.createDataFrame([], plain).write.parquet(str(tmp_path / "n"))
    spark.range(3).write.parquet(str(tmp_path / "m"))
    spark.range(3).selectExpr("cast(id AS int) AS id").write.mode("append").parquet(str(tmp_path / "m"))
    paths = {"n": str(tmp_path / "n"), "m": f"file://{tmp_path}/m", "o": str(tmp_path)}
    got = footers.file_inventory(spark, paths, "v", per_task=1)
    assert got.rdd.getNumPartitions() == 3
    by_table = {}
    for r in got.collect():
        by_table.setdefault(r.table_name, []).append((r.column_name, r.data_type))
    assert by_table["n"] == types.leaf_columns(T.StructType.fromDDL(plain)) and sorted(by_table["m"]) == [("id", "bigint"), ("id", "int")]
    assert footers.file_inventory(spark, {}, "v").count() == 0
    flat = footers.file_inventory(spark, {"n": paths["n"]}, "v", nested=False).collect()
    assert [r.column_name for r in flat] == ["a", "b", "h"]


def test_lines_are_read_or_kept_apart(spark, tmp_path):
    (tmp_path / "one.csv").write_text('k,v\n1,2.5\n2\n3,x\n4,1,9\n\n5,"a\n6,\n')
    (tmp_path / "two.csv").write_text("k,v\n7,1e3\nseven,1\n")
    read = files.read_checked(spark, str(tmp_path / "*.csv"), "k int, v double")
    assert sorted(r.k for r in read.good.select("k").collect()) == [1, 6, 7]
    assert {(r.source_file.rsplit("/", 1)[1], r.line) for r in read.bad.collect()} == {("one.csv", "2"), ("one.csv", "3,x"), ("one.csv", "4,1,9"), ("one.csv", '5,"a'), ("two.csv", "seven,1")}
    assert read.good.count() == 3 and read.bad.count() == 5
    files.write_quarantine(read.bad, str(tmp_path / "q"))
    files.write_quarantine(read.bad, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).columns == ["source_file", "line", "found_at"]


def test_sketches_merge_to_the_counts_of_the_whole(spark):
    df = spark.range(60000).select((F.col("id") % 12).alias("month"), (F.col("id") * 7 % 25000).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 1000).alias("n"), F.lit("one").alias("t"), F.lit(None).cast("double").alias("e"))
    stored = sketches.column_sketches(df, ["k", "n", "t", "e"], ["month"])
    got = {r.column_name: r for r in sketches.merged_profile(stored).collect()}
    assert {c: (r.row_count, r.null_count) for c, r in got.items()} == {"k": (60000, 0), "n": (60000, 12000), "t": (60000, 0), "e": (60000, 60000)}
    for c, exact in (("k", 25000), ("n", 800), ("t", 1), ("e", 0)):
        assert got[c].distinct_low <= exact <= got[c].distinct_high
    assert abs(got["k"].q50 / 25000 - 0.5) < sketches.RANK_ERROR and got["t"].q50 is None and got["e"].q50 is None
    assert sketches.merged_profile(sketches.column_sketches(df.limit(0), ["k"], ["month"])).count() == 0


def test_steps_of_a_forest_are_looked_up_without_the_driver(spark):
    leaves = spark.createDataFrame([(1, float("-inf"), 2.0), (1, 10.0, 5.0), (2, float("-inf"), 1.0), (2, 10.0, 3.0), (2, 20.5, 0.25)], "tree int, start double, path double")
    accounts = spark.createDataFrame([(f"a{i}", float(v)) for i, v in enumerate((-5, 9.99, 10, 20.4, 20.5, 1e9))], "account_code string, amount double")
    got = {r.amount: float(r.depth) for r in outliers.as_of_sum(accounts, outliers.forest_steps(leaves)).collect()}
    assert got == {-5.0: 3.0, 9.99: 3.0, 10.0: 8.0, 20.4: 8.0, 20.5: 5.25, 1e9: 5.25}


def test_run_checks_per_period(rows):
    log = rows(RUNS, run("f", "source", 1, 5.0), run("f", "target", 1, 5.0), run("f", "source", 100, 5.0), run("f", "target", 100, 7.0))
    spans = overlap.quarter_spans(rows("period string", ("2024Q1",), ("2024Q2",), ("2024Q3",)))
    keys = ["pipeline_id", "period"]
    got = {r.period: r.watermark_gap_flag for r in runs.run_checks(runs.paired_runs(runs.in_periods(log, spans), keys), keys).collect()}
    assert got == {"2024Q1": False, "2024Q2": True}


def test_parameters_are_compared_leaf_by_leaf(rows):
    pairs = rows(
        "k int, source_parameters string, target_parameters string",
        (1, '{"a": 1, "b": [1, {"c": "x"}]}', '{"b": [1.0, {"c": "x"}], "a": 1e0}'), (2, '{"a": "1"}', '{"a": 1}'), (3, "7", "8"), (4, None, '{"a": null}'), (5, "{broken", '{}'),
        (6, '{"a": {"b": {"c": {"d": [[], {}, [[2.50]]]}}}}', '{"a": {"b": {"c": {"d": [[], {}, [[2.5, true]]]}}}}'), (7, '{"a": 1e300}', '{"a": 1.0e300}'), (8, '{"a": 0.1}', '{"a": 0.10}'),
    )
    got = {(r.k, r.parameter): (r.source_value, r.target_value) for r in parameters.nested_differences(pairs, ["k"]).collect()}
    assert got == {
        (2, "a"): ('"1"', "1"), (3, ""): ("7", "8"), (4, "a"): (None, "null"), (5, ""): (None, "{}"), (6, "a.b.c.d[2][0][1]"): (None, "true"),
    }
    assert parameters.nested_differences(pairs.limit(0), ["k"]).count() == 0
