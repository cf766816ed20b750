"""Plans that have to stay fit for tables far larger than those of the tests."""

from datetime import datetime

import pytest

from tieout.operators import fuzzy
from verification import cause_queries, gap_queries
from verification.views import Views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_with_a_row_for_every_code_are_not_broadcast(rows):
    source = rows("account_code string", ("Customer#00012",), ("Customer#00345",), ("gone",))
    mapping = rows("source_account_code string, metric_category string", ("Customer#000012", "a"), ("Customer#000345", "b"))
    left, right = fuzzy.unmapped_distinct(source, mapping), fuzzy.distinct_codes(mapping, "source_account_code")
    best = fuzzy.fuzzy_matches(source, mapping)
    assert {tuple(r)[:2] for r in best.collect()} == {("Customer#00012", "Customer#000012"), ("Customer#00345", "Customer#000345")}
    for df in (left, best, fuzzy._round(left, right, [(14, 15, 14)]), fuzzy._unsettled(left, best, {14: 100.0}), fuzzy.segment_pairs(left, right, [(14, 15, 12)])):
        assert "SortMergeJoin" in plan(df)
    for df in (left, best, fuzzy._round(left, right, [(14, 15, 14)]), fuzzy._unsettled(left, best, {14: 100.0})):
        assert "Broadcast" not in plan(df)


@pytest.fixture()
def folder(rows, tmp_path):
    day = [datetime(2020, m, 3) for m in (1, 4)]
    tables = {
        "region": rows("r_regionkey int, r_name string", (0, "EAST"), (1, "WEST")),
        "nation": rows("n_nationkey int, n_name string, n_regionkey int", (0, "N0", 0), (1, "N1", 0), (2, "N2", 1)),
        "supplier": rows("s_suppkey long, s_name string, s_nationkey int", (1, "a", 0), (2, "b", 1), (3, "c", 2), (3, "again", 2)),
        "customer": rows(
            "c_custkey long, c_name string, c_nationkey int, c_mktsegment string", (1, "x", 1, "m"), (2, "y", 0, "m"), (None, "z", 2, "m")
        ),
        "part": rows("p_partkey long, p_brand string", (1, "Brand#1"), (2, "Brand#2"), (3, "Brand#11"), (3, "Brand#4")),
        "orders": rows("o_orderkey long, o_custkey long, o_orderpriority string", (1, 1, "1-URGENT"), (2, 2, "5-LOW"), (3, None, "5-LOW"), (None, 1, "5-LOW")),
        "lineitem": rows(
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
            (1, 1, 1, 1, 5000.0, "N", "O", day[0]), (1, 2, 1, 2, 2500.5, "A", "F", day[0]), (2, 3, 2, 1, 900.0, "A", "F", day[1]), (2, 1, 3, 2, 40000.0, None, "F", day[1]),
            (2, 1, 3, 3, 7000.0, "R", "F", None), (3, 1, 1, 1, 1.0, "R", "F", day[0]), (None, 1, 1, 1, 1.0, "R", "F", day[0]), (1, 3, 2, 4, 77.0, "R", "F", day[0]),
        ),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_transactions_are_not_sorted_to_meet_their_orders(spark, folder):
    source = Views(spark, folder).source("entity_code", "counterparty_entity", "amount", "adjustment_type")
    assert "SortMergeJoin" not in plan(source) and "ShuffledHashJoin [l_orderkey" in plan(source)
    got = sorted(map(tuple, source.select("entity_code", "counterparty_entity", source.amount.cast("double"), "adjustment_type").collect()), key=str)
    expected = [
        ("N0", "N1", 5000.0, None), ("N0", None, -2500.5, None), ("N1", None, 900.0, "5-LOW"), ("N1", None, -900.0, "5-LOW"),
        *[("N2", None, 40000.0, None), ("N2", None, 7000.0, None)] * 2, ("N1", None, 77.0, None), ("N1", None, -77.0, None),
    ]
    assert len(got) == len(expected) and {g[:2] for g in got} == {e[:2] for e in expected}
    assert sorted(abs(g[2]) for g in got) == sorted(abs(e[2]) for e in expected)


def test_reports_are_written_once(spark, folder):
    rows = gap_queries.headline_rows_by_period(spark, folder)
    assert "lineitem" not in plan(rows)
    assert {r.period for r in rows.collect()} == {"2020Q1", "2020Q2", None}


@pytest.mark.parametrize("name", ["contribution_scores", "contribution_scores_with_priorities", "contribution_summary"])
def test_transactions_are_folded_once(spark, folder, name):
    read = []
    source = Views.source
    try:
        Views.source = lambda self, *columns: read.append(columns) or source(self, *columns)
        rows = getattr(cause_queries, name)(spark, folder)
    finally:
        Views.source = source
    assert len(read) == 3 and "lineitem" not in plan(rows)  # the fold, what the report is made of, and all transactions
    assert ("entity_code", "account_code", "amount") in read  # those without an order count for contributions
