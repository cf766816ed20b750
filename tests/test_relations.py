"""Relations that hold on any data, checked on the given tables."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tieout.operators import attribution, compare, fixes, intercompany, metrics
from tieout.operators.enrich import fold
from tieout.plans.investigate import investigate
from verification.views import Views

LINE = ("account_code", "amount", "is_intercompany")


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SMALL)


def gaps(v, mapping):
    return {r.metric: r for r in metrics.gap_summary(v.source(*LINE), mapping, v.target).collect()}


@pytest.fixture(scope="module")
def before(v):
    return gaps(v, v.mapping)


@pytest.mark.parametrize("code, touched", [("Brand#1", ["Revenue", "Gross Margin", "Operating Profit"]), ("Brand#2", ["COGS", "Gross Margin", "Operating Profit"])])
def test_removing_an_account_moves_its_metrics_by_its_amount(v, before, code, touched):
    amount = v.source(*LINE).filter((F.col("account_code") == code) & ~F.col("is_intercompany")).agg(F.sum("amount")).first()[0]
    after = gaps(v, v.mapping.filter(F.col("source_account_code") != code))
    for metric, row in before.items():
        assert after[metric].gap - row.gap == (-amount if metric in touched else 0)
    if code == "Brand#2":  # a missing cost leaves a positive gap
        assert after["COGS"].gap > before["COGS"].gap


def test_full_mapping_leaves_only_the_entry_on_the_derived_metric(v):
    after = gaps(v, v.full_mapping)
    assert {m: r.gap for m, r in after.items()} == {"Revenue": 0, "COGS": 0, "Gross Margin": 0, "OpEx": 0, "Operating Profit": -500000}
    assert [m for m, r in after.items() if r.has_gap] == ["Operating Profit"]
    found = compare.inconsistent_metrics(metrics.gap_summary(v.source(*LINE), v.full_mapping, v.target)).collect()
    assert [(r.derived_metric, r.discrepancy) for r in found] == [("Operating Profit", -500000)]


def test_empty_fix_closes_nothing(v):
    none = v.mapping.limit(0)
    rows = fixes.preview_fix("add_mapping", none, v.source(*LINE), v.mapping, v.target).collect()
    assert {r.gap_closed for r in rows} == {0} and len(rows) == 5


def test_mapping_fix_and_its_audit_row(v):
    rows = fixes.preview_fix("add_mapping", v.full_mapping, v.source(*LINE), v.mapping, v.target)
    revenue = rows.filter("metric = 'Revenue'").first()
    assert revenue.gap_after == 0 and revenue.gap_closed_pct == 100.0
    audit = fixes.audit_row(rows, "add_mapping", ["a"]).first()
    assert audit.delta_after == 0 and audit.gap_closed == audit.delta_before > 0 and audit.confidence == 0.95


def test_adjustment_fix_moves_the_metric(v):
    entries = v.spark.createDataFrame([("Brand#1", "NATION_1", 12.5)], "account_code string, entity_code string, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    rows = {r.metric: r for r in fixes.preview_fix("add_adjustment", entries, v.source(*LINE, "entity_code"), v.mapping, v.target).collect()}
    assert float(rows["Revenue"].after_our_value - rows["Revenue"].before_our_value) == 12.5 and rows["COGS"].gap_closed == 0


def test_undirected_eliminations_bring_every_balance_to_zero(v):
    source = v.source("entity_code", "counterparty_entity", "amount", "is_intercompany")
    entries = intercompany.suggested_eliminations(intercompany.pair_balances(intercompany.intercompany_rows(source), directed=False))
    effect = {r.state: r for r in fixes.elimination_effect(source, entries).collect()}
    assert effect["before"].uneliminated_pair_count > 0 and effect["after"].uneliminated_pair_count == 0


def test_investigation_components_sum_to_every_gap(v):
    found = investigate(
        v.source("entity_code", "counterparty_entity", "adjustment_flag", "region", *LINE), v.mapping, v.grouped_target, by=["entity_code"], run_log=v.run_log
    )
    sums = found.components.groupBy("entity_code").agg(F.sum("amount").alias("total"))
    for r in found.primary.join(sums, "entity_code").collect():
        assert abs(float(r.primary_gap) - r.total) < 0.011
    one = investigate(v.source("entity_code", "counterparty_entity", "adjustment_flag", "region", *LINE), v.mapping, v.target, v.hierarchy)
    assert one.summary.count() == 1 and one.gate.count() == 1 and one.gaps.count() == 5
    assert one.primary.first().primary_metric == "Revenue" and one.contributions.count() >= 1


def test_fold_keeps_amounts_and_counts(v):
    source = v.source(*LINE)
    folded = fold(source)
    assert folded.agg(F.sum("amount"), F.sum("row_count")).first() == source.agg(F.sum("amount"), F.count(F.lit(1))).first()


def test_waterfall_of_no_gap(v):
    df = v.spark.createDataFrame([(0.0,)], "gap double")
    assert attribution.component_rows(attribution.attribute(df), ["gap"]).count() == 0
    assert attribution.attribution_summary(attribution.attribute(df), ["gap"]).first().explained_pct == 100.0
