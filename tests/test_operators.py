from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tieout.operators import (
    adjustments,
    attribution,
    causal,
    compare,
    contribution,
    enrich,
    fixes,
    intercompany,
    mapping_checks,
    metrics,
    notebooks,
    profile,
    rollup,
    runs,
    schema_diff,
)
from tieout.operators import control_totals
from tieout.scale import per_group, running_total, small_side

SOURCE = (
    "transaction_id string, account_code string, entity_code string, region string, amount decimal(18,2), is_intercompany boolean, "
    "counterparty_entity string, adjustment_flag boolean, adjustment_type string"
)
MAPPING = "source_account_code string, target_account_code string, metric_category string"
TARGET = "metric string, group_by string, period string, amount decimal(18,2), currency string, row_type string"


def line(i, account, amount, entity="e", ic=False, partner=None, adj=False, kind=None, region="EU"):
    return (str(i), account, entity, region, Decimal(str(amount)), ic, partner, adj, kind)


def value(df, key, column):
    return {r[key]: r[column] for r in df.collect()}


def test_null_keys_never_match_and_count_as_unmapped(rows):
    source = rows(SOURCE, line(1, None, 5), line(2, "a", 7))
    mapping = rows(MAPPING, (None, "T", "Revenue"), ("a", "T", "Revenue"))
    got = value(enrich.map_accounts(source, mapping), "transaction_id", "is_mapped")
    assert got == {"1": False, "2": True}
    assert profile.mapping_coverage(source, mapping).first().unmapped_count == 1
    totals = mapping_checks.unmapped_totals(source, mapping)
    gap = mapping_checks.mapping_gap(totals).first()
    assert (gap.unmapped_account_count, gap.unmapped_transaction_count, gap.unmapped_amount) == (0, 0, 5)
    assert mapping_checks.unmapped_codes(totals).count() == 0


def test_mapping_key_without_target_is_not_mapped_but_has_a_key(rows):
    source, mapping = rows(SOURCE, line(1, "a", 5)), rows(MAPPING, ("a", None, "Revenue"))
    assert enrich.map_accounts(source, mapping).first().is_mapped is False
    assert profile.account_presence(source, mapping).first().has_mapping_key is True


def test_repeated_mapping_keys_multiply_amounts(rows):
    source, mapping = rows(SOURCE, line(1, "a", 5)), rows(MAPPING, ("a", "T", "Revenue"), ("a", "U", "Revenue"))
    assert metrics.category_totals(source, mapping).first().our_value == 10


def test_hierarchy_without_segment_and_with_repeated_entity(rows):
    source = rows("entity_code string, region string, segment string", ("e", "own", "kept"))
    places = rows("entity_code string, region string", ("e", "B"), ("e", "A"))
    got = enrich.place_entities(source, places).collect()
    assert len(got) == 1 and got[0].region == "A" and got[0].segment == "kept"
    assert enrich.place_entities(source, None) is source


def test_large_side_is_not_broadcast(rows):
    df = rows("a string", ("x",), ("y",))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" in d_text(small_side(df)) and "ResolvedHint" not in d_text(small_side(df, max_rows=1))
    assert "ResolvedHint" not in d_text(small_side(df, max_bytes=3))
    source, mapping = rows(SOURCE, line(1, "a", 5)), rows(MAPPING, ("a", "T", "Revenue"))
    assert "broadcast" in plan(enrich.map_accounts(source, mapping)).lower()


def d_text(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_headline_fallback_when_none(rows):
    target = rows(TARGET, ("Revenue", "EU", "q", Decimal(3), "USD", "detail"), ("Revenue", "US", "q", Decimal(4), "USD", "detail"))
    assert metrics.target_metrics(target).first().target_value == 7
    assert metrics.headline_rows(target).count() == 2
    more = target.unionByName(rows(TARGET, ("COGS", "Group Total", "q", Decimal(1), "USD", "headline")))
    assert value(metrics.target_metrics(more), "metric", "target_value") == {"COGS": 1}
    assert metrics.headline_rows(more).count() == 1


def test_headline_fallback_per_group(rows):
    target = rows(
        TARGET, ("Revenue", "all", "q1", Decimal(9), "USD", ""), ("Revenue", "EU", "q1", Decimal(4), "USD", ""), ("Revenue", "EU", "q2", Decimal(5), "USD", "")
    )
    assert value(metrics.target_metrics(target, ["period"]), "period", "target_value") == {"q1": 9, "q2": 5}


def test_gap_threshold_is_strict_and_zero_target_has_no_percentage(rows):
    ours = rows("metric string, our_value decimal(28,2)", ("a", Decimal(1000)), ("b", Decimal("1000.01")))
    target = rows("metric string, target_value decimal(28,2)", ("a", Decimal(0)), ("c", Decimal(2000)))
    got = {r.metric: r for r in metrics.gaps(ours, target).collect()}
    assert [got[m].has_gap for m in "abc"] == [False, True, True]
    assert got["a"].gap_pct is None and got["c"].gap_pct == -100.0 and got["c"].our_value == 0


def test_derived_metrics_exist_without_parts(rows):
    source, mapping = rows(SOURCE, line(1, "a", 5)), rows(MAPPING, ("a", "T", "Other"))
    assert value(metrics.our_metrics(source, mapping), "metric", "our_value") == {"Other": 5, "Gross Margin": 0, "Operating Profit": 0}
    custom = metrics.our_metrics(source, mapping, derived={"Twice": ("Other", "Other")})
    assert value(custom, "metric", "our_value") == {"Other": 5, "Twice": 10}


def test_entity_breakdown_drops_null_keys(rows):
    source = rows(SOURCE, line(1, "a", 5), line(2, "a", 6, entity=None))
    assert [r.our_amount for r in metrics.entity_breakdown(source, rows(MAPPING, ("a", "T", "Revenue"))).collect()] == [5]


def test_primary_metric(rows):
    schema = "g string, metric string, gap decimal(28,2), has_gap boolean"
    gaps = rows(schema, ("x", "COGS", Decimal(-9000), True), ("x", "Net Revenue", Decimal(2000), True), ("y", "COGS", Decimal(-9000), True),
                ("y", "Revenue", Decimal(10), False), ("z", "COGS", Decimal(1), False), ("z", "B", Decimal(2), False))
    got = {r.g: (r.primary_metric, r.primary_gap) for r in metrics.primary_metric(gaps, ["g"]).collect()}
    assert got == {"x": ("Net Revenue", 2000), "y": ("COGS", -9000), "z": ("B", 0)}


def test_intercompany_pairs(rows):
    source = rows(
        SOURCE,
        line(1, "a", 10, "A", True, "B"), line(2, "a", -4, "B", True, "A"), line(3, "a", 3, "C", True, "C"),
        line(4, "a", 8, "D", True, "E"), line(5, "a", -8, "E", True, "D"), line(6, "a", 9, "A", True, None), line(7, "a", 9, "A", False, "B"),
    )
    got = {(r.entity, r.counterparty): r.net_uneliminated for r in intercompany.intercompany_findings(source).collect()}
    assert got == {("A", "B"): 6, ("B", "A"): 6, ("C", "C"): 6}
    once = intercompany.pair_balances(intercompany.intercompany_rows(source), directed=False)
    assert {(r.entity, r.counterparty): r.net_uneliminated for r in once.collect()} == {("A", "B"): 6, ("C", "C"): 3}
    summary = intercompany.intercompany_summary(source).first()
    assert tuple(summary) == (6, 18, 3, 18)
    folded = intercompany.intercompany_summary(enrich.fold(source)).first()
    assert folded == summary
    assert intercompany.pair_samples(intercompany.intercompany_rows(source), 1).count() == 5


def test_checks_take_folded_transactions(rows):
    source = rows(SOURCE, *[line(i, "ab"[i % 2], i, adj=i % 3 == 0, kind="k") for i in range(20)])
    mapping = rows(MAPPING, ("a", "T", "Revenue"))
    folded = enrich.fold(source)
    for check in (
        lambda s: profile.mapping_coverage(s, mapping), lambda s: mapping_checks.mapping_gap(mapping_checks.unmapped_totals(s, mapping)),
        adjustments.adjustment_summary, adjustments.adjustments_by_type, adjustments.adjusted_entities,
    ):
        assert check(source).collect() == check(folded).collect()


def test_excluded_accounts(rows):
    source = rows(SOURCE, line(1, "a", 5, adj=True), line(2, "b", 6, adj=True))
    out = rows("account_code string", ("a",))
    assert adjustments.adjustment_summary(source, out).first().adjustment_amount == 6
    none = adjustments.adjustment_summary(source.filter("false")).first()
    assert (none.adjustment_count, none.adjustment_amount) == (0, 0)


def test_findings_checksum_ignores_order_and_notices_change(rows):
    schema = "account_code string, row_count long, total_amount decimal(28,2)"
    a = rows(schema, ("x", 1, Decimal(1)), ("y", 1, Decimal(2)))
    b = rows(schema, ("y", 1, Decimal(2)), ("x", 1, Decimal(1))).repartition(3)
    c = rows(schema, ("x", 1, Decimal(2)), ("y", 1, Decimal(1)))
    check = lambda d: mapping_checks.mapping_gap(d).first().checksum
    assert check(a) == check(b) != check(c)


def test_region_metric_falls_back_to_first_name(rows):
    target = rows(TARGET, ("Costs", "EU", "q", Decimal(3), "USD", "detail"), ("Assets", "EU", "q", Decimal(2000), "USD", "detail"))
    got = rollup.region_comparison(rows(SOURCE, line(1, "a", 5)), rows(MAPPING, ("a", "T", "Revenue")), target).collect()
    assert [(r.metric, r.our_value, r.gap) for r in got] == [("Assets", 5, -1995)]


def test_runs(rows):
    schema = (
        "pipeline_id string, side string, task_name string, start_time timestamp, end_time timestamp, status string, "
        "parameters map<string,string>, high_watermark double"
    )
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    log = rows(
        schema,
        ("p", "source", "old", None, at(1), "Success", {"a": "1"}, 5.0), ("p", "source", "failed", None, at(9), "FAILED", {"a": "2"}, 6.0),
        ("p", "source", "new", None, at(2), "COMPLETED", {"a": "1", "b": None}, 7.0), ("p", "target", "t", None, at(3), "succeeded", {"a": "1"}, 7.0),
        ("q", "source", "only", at(4), None, "FAILED", None, None),
        ("r", "source", "s", None, at(1), "success", {"a": "1", "c": "3"}, 1.5), ("r", "target", "t", None, at(3), "success", {"a": "2"}, 1.0),
    )
    latest = {(r.pipeline_id, r.side): r.task_name for r in runs.latest_runs(log).collect()}
    assert latest == {("p", "source"): "new", ("p", "target"): "t", ("q", "source"): "only", ("r", "source"): "s", ("r", "target"): "t"}
    pairs = runs.paired_runs(log)
    got = {r.pipeline_id: r for r in runs.run_checks(pairs).collect()}
    assert got["p"].timestamp_diff_seconds == 3600 and not got["p"].timestamp_gap_flag  # exactly an hour is no gap
    assert got["p"].parameter_diff_count == 0 and got["p"].run_confidence == 1.0
    assert got["q"].timestamp_diff_seconds is None and got["q"].run_confidence == 0.8
    assert got["r"].timestamp_gap_flag and got["r"].parameter_diff_count == 2 and got["r"].watermark_gap == 0.5 and got["r"].run_confidence == 0.9
    diffs = {(r.pipeline_id, r.parameter): (r.source_value, r.target_value) for r in runs.parameter_differences(pairs).collect()}
    assert diffs == {("r", "a"): ("1", "2"), ("r", "c"): ("3", None)}


def test_schema_drift(rows):
    inv = rows(
        "table_name string, version string, column_name string, data_type string",
        ("t", "1", "a", "int"), ("t", "2", "a", "string"), ("t", "1", "b", "int"), ("t", "2", "c", "int"), ("u", "1", "a", "int"), ("u", "2", "a", "int"),
    )
    assert {(r.column_name, r.missing_in) for r in schema_diff.missing_columns(inv, "1", "2").collect()} == {("b", "2"), ("c", "1")}
    assert [(r.column_name, r.old_type, r.new_type) for r in schema_diff.type_drift(inv, "1", "2").collect()] == [("a", "int", "string")]
    assert value(schema_diff.schema_drift(inv, "1", "2"), "table_name", "has_schema_drift") == {"t": True, "u": False}
    hashes = {(r.table_name, r.version): r.schema_hash for r in profile.schema_hashes(inv).collect()}
    assert hashes[("u", "1")] == hashes[("u", "2")] != hashes[("t", "1")]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_total_splits_one_group_over_slices(spark, by):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("hot2").alias("g"), F.col("id"), (F.col("id") % 7).alias("v"))
    got = running_total(df, by, [F.col("v").desc(), F.col("id").asc()], "v", "t", slices=8).collect()
    assert len(got) == 2000
    want = {}
    for r in sorted(got, key=lambda r: (-r.v, r.id)):
        k = r.g if by else ""
        want[k] = want.get(k, 0) + r.v
        assert r.t == want[k]


def test_per_group_matches_null_groups(rows):
    got = per_group(rows("g string, v int", (None, 1), ("a", 2)), rows("g string, w int", (None, 10), ("a", 20)), ["g"], ["w"])
    assert {r.v: r.w for r in got.collect()} == {1: 10, 2: 20}


def test_contributions(rows):
    deltas = rows("account_code string, delta decimal(28,2)", ("a", Decimal(60)), ("b", Decimal(-35)), ("c", Decimal(5)), ("d", Decimal(1)), ("out", Decimal(900)))
    gap = rows("gap decimal(28,2)", (Decimal(100),))
    out = rows("account_code string", ("out",))
    scores = contribution.contribution_scores(deltas, gap, excluded=out)
    assert {r.account_code: r.contribution_pct for r in scores.collect()} == {"a": 60.0, "b": -35.0}
    summary = contribution.contribution_summary(scores, gap).first()
    assert (summary.explained_share, summary.stopped_early) == (0.95, True)
    first = rows("account_code string, rank int", ("d", 0), ("c", 1))
    ranked = contribution.contribution_scores(deltas, gap, excluded=out, priorities=first)
    assert {r.account_code for r in ranked.collect()} == {"d", "c", "a", "b"}
    noise = rows("gap decimal(28,2)", (Decimal("0.5"),))
    none = contribution.contribution_scores(deltas, noise)
    assert none.count() == 0 and contribution.contribution_summary(none, noise).first().explained_share == 1.0


EVIDENCE = (
    "gap decimal(28,2), has_unmapped boolean, unmapped_amount double, has_open_pairs boolean, uneliminated_amount double, has_run_findings boolean, "
    "run_confidence double, timestamp_gap_flag boolean, has_parameter_diffs boolean, watermark_gap_flag boolean, has_schema_drift boolean, "
    "unmapped_ratio double, data_confidence double, has_region_mismatch boolean, anomalous_count int"
)


def components(rows, *data):
    return [(r.category, r.amount) for r in attribution.component_rows(attribution.attribute(rows(EVIDENCE, data)), ["gap"]).orderBy("seq").collect()]


def test_attribution_order_and_caps(rows):
    got = components(rows, Decimal(-1000), True, -400.0, True, 100.0, True, 0.7, True, False, False, True, 0.1, 0.5, True, 2)
    assert got == [
        ("Mapping Gap", -400.0), ("Intercompany Elimination", -100.0), ("Orchestration Timing", -150.0), ("Schema / Mapping Drift", -35.0),
        ("Manual Adjustment", -315.0), ("Hierarchy Mismatch", 0.0), ("Anomalous Accounts", 0.0),
    ]
    assert components(rows, Decimal(100), True, 400.0, True, 100.0, True, 0.7, True, False, False, True, 0.1, 0.5, False, 0) == [("Mapping Gap", 100.0)]


def test_attribution_flag_precedence(rows):
    # Low confidence hides only the time flag; parameters and watermarks count whatever the confidence.
    low = components(rows, Decimal(1000), False, 0.0, False, 0.0, True, 0.2, True, False, False, False, 0.0, 0.5, False, 0)
    assert low == [("Manual Adjustment", 1000.0)]
    other = components(rows, Decimal(1000), False, 0.0, False, 0.0, True, 0.2, False, True, False, False, 0.0, 0.5, False, 0)
    assert other == [("Orchestration Timing", 100.0), ("Manual Adjustment", 900.0)]


def test_attribution_small_rest_stays_unexplained(rows):
    assert components(rows, Decimal("100.50"), True, 100.0, False, 0.0, False, 0.0, False, False, False, False, 0.0, 0.5, False, 0) == [
        ("Mapping Gap", 100.0), ("Unexplained Residual", 0.5)
    ]


def test_attribution_sums_to_the_gap_and_summary(rows):
    df = rows(EVIDENCE, (Decimal(-1000), True, 400.0, True, 100.0, True, 0.9, True, True, False, True, 0.1, 0.5, True, 1))
    done = attribution.attribute(df)
    parts = attribution.component_rows(done, ["gap"])
    assert abs(sum(r.amount for r in parts.collect()) + 1000) < 0.01
    s = attribution.attribution_summary(done, ["gap"]).first()
    # 400 mapping, 100 pairs, 150 runs and 35 drift are fixable; 315 are left to manual adjustments.
    assert (s.explained_pct, s.auto_fixable_pct) == (100.0, 68.5)
    assert s.overall_confidence == round((400 * 0.95 + 100 * 0.85 + 150 * 0.9 + 35 * 0.5 + 315 * 0.65) / 10, 1)
    falls = attribution.waterfall(parts, ["gap"]).orderBy("seq").collect()
    assert [r.running_total for r in falls][:3] == [-400.0, -500.0, -650.0] and falls[0].direction == "negative"
    assert {r.category: r.share for r in attribution.cause_shares(parts, []).collect()}["Mapping Gap"] == 0.4
    assert value(parts, "category", "confidence_label")["Manual Adjustment"] == "Medium"


def test_attribution_plan_stays_small(rows):
    df = rows(EVIDENCE, (Decimal(-1000), True, 400.0, True, 100.0, True, 0.9, True, True, False, True, 0.1, 0.5, True, 1))
    parts = attribution.component_rows(attribution.attribute(df), ["gap"]).filter("amount < 0")
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()


def test_causal_path(rows):
    schema = EVIDENCE + ", adjustment_amount decimal(28,2)"
    df = rows(
        schema,
        (Decimal(-1000), True, 600.0, True, 100.0, True, 0.9, True, False, False, True, 0.1, 0.5, True, 0, Decimal(10)),
        (Decimal(1000), True, 300.0, True, 400.0, True, 0.9, False, False, True, True, 0.1, 0.5, True, 0, None),
        (Decimal(0), True, 300.0, True, 400.0, False, 0.9, False, False, False, True, 0.1, 0.5, True, 0, None),
    )
    got = {float(r.gap): r for r in causal.trace(causal.stage_deltas(df)).collect()}
    assert (got[-1000].root_cause, got[-1000].root_share) == ("mapping_join", 0.6)
    assert [p.node for p in got[-1000].path] == ["manual_adj", "schema_version", "orchestration_timing", "ic_elimination", "mapping_join"]
    assert (got[1000].root_cause, got[1000].root_share, len(got[1000].path)) == ("ic_elimination", 0.4, 6)
    assert [p.delta for p in got[1000].path][2] == 100.0
    assert (got[0].root_cause, got[0].root_share, got[0].path) == ("none", 0.0, [])


def test_confidence_gate(rows):
    df = rows("explained_share double, data_confidence double, run_confidence double", (1.0, 1.0, 1.0), (0.5, 0.9, 0.5))
    got = [(r.overall_confidence, r.needs_review) for r in causal.confidence_gate(df).collect()]
    assert got == [(1.0, False), (0.6, True)]


def test_value_diff(rows):
    ours = rows("metric string, our_value decimal(28,2)", ("a", Decimal(100)), ("b", Decimal(104)), ("c", Decimal(110)), ("d", Decimal(0)), ("e", Decimal(1)))
    target = rows("metric string, target_value decimal(28,2)", *[(m, Decimal(100)) for m in "abc"], ("d", Decimal(0)), ("e", Decimal(0)))
    got = {r.metric: (r.status, r.delta_pct, r.checksum_match) for r in compare.value_diff(ours, target).collect()}
    assert got == {"a": ("pass", 0.0, True), "b": ("warn", 4.0, False), "c": ("fail", 10.0, False), "d": ("pass", 0.0, True), "e": ("fail", None, False)}


def test_hierarchy_updates_last_wins(rows):
    h = rows("entity_code string, region string", ("a", "x"), ("b", "y"))
    u = rows("entity_code string, field string, new_value string, seq int", ("a", "region", "one", 1), ("a", "region", "two", 2), ("z", "region", "q", 1))
    assert value(fixes.fix_hierarchy(h, u), "entity_code", "region") == {"a": "two", "b": "y"}


def test_unknown_fix(rows):
    one = rows("a int", (1,))
    with pytest.raises(ValueError):
        fixes.preview_fix("other", one, one, one, one)


def test_step_checks(rows):
    source = rows("amount decimal(18,2)", (Decimal(1000),), (Decimal(5000),))
    totals = control_totals.step_totals(source, [("all", lambda d: d), ("large", lambda d: d.filter("amount > 2000")), ("none", lambda d: d.filter("amount > 9999"))])
    expected = rows("step_name string, expected_total double", ("all", 6000.0), ("large", 6000.0))
    got = [(r.step_name, r.is_off, r.first_off) for r in control_totals.step_checks(totals, expected).orderBy("step").collect()]
    assert got == [("all", False, False), ("large", False, False), ("none", False, False)]
    tight = control_totals.step_checks(totals, expected, 10).orderBy("step").collect()
    assert [r.first_off for r in tight] == [False, True, False]


def test_notebook_steps(rows):
    cells = rows(
        "notebook_id string, cell_index int, cell_type string, cell_source string",
        ("n", 0, "code", "# Step 1: Load Data\ndf = spark.read.csv('x')"),
        ("n", 1, "markdown", "# nothing"), ("n", 2, "code", "   \n"),
        ("n", 3, "code", "out = df.merge(m, left_on=['a', 'b'], right_on=\"c\")\nout.filter(x > 1).select([\"p\", \"q\"])"),
        ("n", 4, "code", "SELECT a, sum(b) FROM t\nWHERE a > 1\n AND b < 2 GROUP BY a, c ORDER BY a"),
        ("one", 0, "code", "x = 1"), ("two", 5, None, "def shape_it(df):\n  return df"),
    )
    steps = notebooks.notebook_steps(cells)
    got = {(r.notebook_id, r.step_index): r for r in steps.collect()}
    assert len(got) == 5
    assert (got["n", 0].step_name, got["n", 0].transform_type) == ("load_data", "ingest")
    join = got["n", 3]
    assert (join.transform_type, join.join_keys, join.filter_conditions, join.output_schema) == ("join", ["c"], ["x > 1"], ["p", "q"])
    sql = got["n", 4]
    assert sql.filter_conditions == ["a > 1  AND b < 2"] and sql.aggregation_columns == ["a", "c"] and sql.output_schema == ["a", "sum(b)"]
    assert got["one", 0].transform_type == "unknown" and got["two", 5].step_name == "shape_it"
    edges = {(r.notebook_id, r.from_step, r.to_step) for r in notebooks.step_edges(steps).collect()}
    assert edges == {("n", "load_data", "step_3"), ("n", "step_3", "step_4")}


def test_assumed_steps(rows):
    none = notebooks.notebook_steps(rows("notebook_id string, cell_index int, cell_type string, cell_source string"))
    assert [r.step_name for r in notebooks.steps_or_assumed(none).orderBy("step_index").collect()] == ["source_ingest", "mapping_apply", "metric_aggregation"]
    some = notebooks.notebook_steps(rows("notebook_id string, cell_index int, cell_type string, cell_source string", ("n", 0, "code", "x")))
    assert notebooks.steps_or_assumed(some) is some


def test_assumed_steps_have_edges(rows):
    none = notebooks.notebook_steps(rows("notebook_id long, cell_index int, cell_type string, cell_source string").limit(0))
    edges = notebooks.step_edges(notebooks.steps_or_assumed(none)).orderBy("step_index").collect()
    assert [(r.notebook_id, r.from_step, r.to_step) for r in edges] == [
        (None, "source_ingest", "mapping_apply"), (None, "mapping_apply", "metric_aggregation")
    ]


def test_edges_over_slices(spark):
    steps = spark.range(0, 600).selectExpr("id % 2 AS notebook_id", "CAST(id AS INT) AS step_index", "concat('s', id) AS step_name")
    edges = notebooks.step_edges(steps).collect()
    assert sorted((r.step_index, r.from_step, r.to_step) for r in edges) == [(i, f"s{i - 2}", f"s{i}") for i in range(2, 600)]


def test_fingerprint_keeps_the_place_of_a_missing_hash(rows):
    hashes = rows("src_hash string, map_hash string, tgt_hash string", ("a", None, "c"), ("a", "c", None))
    got = profile.fingerprints(hashes, rows("coverage_pct double", (50.0,)))
    assert got.select("fingerprint_hash").distinct().count() == 2


def test_data_confidence_without_near_match_check(rows):
    schema = "unmapped_ratio double, has_schema_drift boolean, has_fuzzy_match boolean"
    got = mapping_checks.data_confidence(rows(schema, (0.0, False, None), (0.0, False, False), (0.1, True, True))).collect()
    assert [r.data_confidence for r in got] == [1.0, 0.9, 0.5]


def test_checksum_uses_all_digits(rows):
    import hashlib

    found = rows("account_code string, total_amount decimal(28,2), row_count long, transaction_count long", ("a", Decimal("1.50"), 1, 1), ("b", Decimal("-2.00"), 1, 1))
    digests = [hashlib.md5(t.encode()).hexdigest() for t in ("a:1.50", "b:-2.00")]
    sums = [str(sum(int(d[i : i + 16], 16) for d in digests)) for i in (0, 16)]
    assert mapping_checks.mapping_gap(found).first().checksum == hashlib.md5(":".join(["2", *sums]).encode()).hexdigest()


def test_long_names_and_lists_are_kept(rows):
    name, filters = "n" * 90, " ".join(f".filter(c{i} > {'9' * 90})" for i in range(12))
    cells = rows("notebook_id long, cell_index int, cell_type string, cell_source string", (1, 0, "code", f"# Step 1: {name}\ndf{filters}"))
    whole, short = notebooks.notebook_steps(cells).first(), notebooks.notebook_steps(cells, most=5, name_chars=60, filter_chars=80).first()
    assert whole.step_name == name and len(whole.filter_conditions) == 12 and len(whole.filter_conditions[0]) > 90
    assert short.step_name == "n" * 60 and len(short.filter_conditions) == 5 and len(short.filter_conditions[0]) == 80


def test_few_accounts_are_sorted_for_contributions(spark, rows):
    from tieout.operators import contribution

    deltas = spark.range(4000).selectExpr("concat('a', id) AS account_code", "CAST(IF(id < 20, 1000, 1) AS decimal(28,2)) AS delta")
    scored = deltas.selectExpr("*", "CAST(20000 AS decimal(28,2)) AS gap", "delta AS abs_delta")
    assert contribution._deciding(scored, [], 0.95).count() == 20
    got = contribution.contribution_scores(deltas, rows("gap decimal(28,2)", (Decimal(20000),))).count()
    assert got == 19


def test_scratch_is_removed(spark):
    import os

    from tieout import scale

    with scale.scratch(spark):
        pinned = scale.pin(spark.range(5))
        folder = scale.application_folder(spark)
        before = set(os.listdir(folder))
        assert pinned.count() == 5 and before
    assert len(before - set(os.listdir(folder))) == 1


def test_run_times_of_steps(rows):
    log = rows("task_name string, start_time timestamp, end_time timestamp, status string", ("a", None, datetime(2024, 1, 1), "old"), ("a", None, datetime(2024, 1, 2), None))
    got = {r.step_name: (r.end_time, r.status) for r in runs.with_run_times(rows("step_name string", ("a",), ("b",)), log).collect()}
    assert got == {"a": (datetime(2024, 1, 2), "unknown"), "b": (None, None)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_cut_before_the_shuffle(rows):
    source = rows(SOURCE, line(1, "a", 10, "A", True, "B"))
    assert plan_of(intercompany.pair_samples(intercompany.intercompany_rows(source))).count("WindowGroupLimit") == 2
    findings = rows("g string, v int", ("a", 1))
    assert plan_of(attribution.drill_down(findings, ["g"], [F.col("v").desc()])).count("WindowGroupLimit") == 2


def test_no_check_joins_unaggregated_transactions_or_makes_pairs(rows):
    source = rows(SOURCE, line(1, "a", 10, "A", True, "B"))
    mapping = rows(MAPPING, ("a", "T", "Revenue"))
    for df in (
        metrics.our_metrics(source, mapping), profile.mapping_coverage(source, mapping), intercompany.intercompany_summary(source),
        mapping_checks.mapping_gap(mapping_checks.unmapped_totals(source, mapping)), intercompany.intercompany_findings(source),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert plan.rstrip().count("partial_sum") >= 1


def test_hot_account_is_summed_before_the_shuffle(spark):
    hot = spark.range(0, 20000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("account_code"),
        F.lit(1).cast("decimal(18,2)").alias("amount"), F.lit(False).alias("is_intercompany"),
    )
    plan = plan_of(enrich.fold(hot))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") < plan.index("partial_sum")
    assert enrich.fold(hot).filter("account_code = 'hot'").first().row_count == 6667
