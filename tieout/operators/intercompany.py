"""Balances between entity pairs that have not been eliminated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieout import defaults as D
from tieout.operators.enrich import rows_in, without_accounts


def intercompany_rows(source: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    return without_accounts(source.filter(F.coalesce(F.col("is_intercompany"), F.lit(False))), excluded)


def _pair_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """Both directions of every pair in one row, from a single aggregation and without a self-join.

    Rows that lack an entity or counterparty are kept together under null keys, for the totals only.
    """
    a, b = F.col("entity_code"), F.col("counterparty_entity")
    known, forward = a.isNotNull() & b.isNotNull(), a <= b
    zero = F.lit(0).cast("decimal(28,2)")
    total = lambda value: F.coalesce(F.sum(value).cast("decimal(28,2)"), zero)
    return rows.groupBy(*by, F.when(known, F.least(a, b)).alias("low"), F.when(known, F.greatest(a, b)).alias("high")).agg(
        total(F.when(forward, F.col("amount"))).alias("forward"),
        total(F.when(~forward, F.col("amount"))).alias("backward"),
        F.max(forward).alias("has_forward"),
        F.max(~forward).alias("has_backward"),
        rows_in(rows).alias("row_count"),
        total(F.col("amount")).alias("amount"),
    )


def pair_balances(rows: DataFrame, by: list[str] = (), directed: bool = True) -> DataFrame:
    """Debit, credit and net per entity pair, for pairs whose net is more than a cent.

    Directed pairs (the default) report both directions of a reciprocal pair, each with the same net;
    a pair of an entity with itself counts its amount on both sides. ``directed=False`` gives every
    pair once.
    """
    by = list(by)
    sums = _pair_sums(rows, by).filter(F.col("low").isNotNull())
    fwd, back, own = F.col("forward"), F.col("backward"), F.col("low") == F.col("high")
    if not directed:
        out = sums.select(*by, F.col("low").alias("entity"), F.col("high").alias("counterparty"),
                          fwd.alias("debit_amount"), back.alias("credit_amount"))
    else:
        there = F.struct(F.col("low").alias("entity"), F.col("high").alias("counterparty"),
                         fwd.alias("debit_amount"), F.when(own, fwd).otherwise(back).alias("credit_amount"))
        here = F.struct(F.col("high").alias("entity"), F.col("low").alias("counterparty"),
                        back.alias("debit_amount"), fwd.alias("credit_amount"))
        both = F.array(F.when(F.col("has_forward"), there), F.when(F.col("has_backward"), here))
        out = sums.select(*by, F.inline(F.filter(both, lambda p: p.isNotNull())))
    net = (F.col("debit_amount") + F.col("credit_amount")).cast("decimal(28,2)")
    return out.withColumn("net_uneliminated", net).filter(F.abs(F.col("net_uneliminated")) > F.lit("0.01").cast("decimal(3,2)"))


def entity_balances(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Intercompany total per entity, for tables that do not name the counterparty."""
    return (
        rows.filter(F.col("entity_code").isNotNull())
        .groupBy(*by, F.col("entity_code").alias("entity"))
        .agg(F.sum("amount").alias("net_uneliminated"))
        .withColumn("counterparty", F.lit("Unknown"))
    )


def intercompany_findings(source: DataFrame, excluded: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    rows = intercompany_rows(source, excluded)
    return pair_balances(rows, by) if "counterparty_entity" in source.columns else entity_balances(rows, by)


def intercompany_summary(source: DataFrame, excluded: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Transactions, total, open directed pairs and open amount per group, from one pass over the transactions."""
    by = list(by)
    rows = intercompany_rows(source, excluded)
    none, zero = F.lit(0).cast("long"), F.lit(0).cast("decimal(28,2)")
    if "counterparty_entity" in source.columns:
        sums = _pair_sums(rows, by)
        own = F.col("low") == F.col("high")
        net = F.when(own, F.col("forward") * 2).otherwise(F.col("forward") + F.col("backward"))
        ways = F.col("has_forward").cast("int") + F.col("has_backward").cast("int")
        is_open = F.col("low").isNotNull() & (F.abs(net) > F.lit("0.01").cast("decimal(3,2)"))
    else:
        sums = rows.groupBy(*by, "entity_code").agg(rows_in(rows).alias("row_count"), F.sum("amount").alias("amount"))
        net, ways, is_open = F.col("amount"), F.lit(1), F.col("entity_code").isNotNull()
    return sums.groupBy(*by).agg(
        F.coalesce(F.sum("row_count"), none).alias("ic_transaction_count"),
        F.coalesce(F.sum("amount").cast("decimal(28,2)"), zero).alias("total_ic_amount"),
        F.coalesce(F.sum(F.when(is_open, ways)), none).alias("uneliminated_pair_count"),
        F.coalesce(F.sum(F.when(is_open, F.abs(net) * ways)).cast("decimal(28,2)"), zero).alias("uneliminated_amount"),
    )


def pair_samples(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first transactions of each directed pair by id.

    The rank filter is applied in every task before the shuffle, so at most ``n`` rows per pair and
    task travel, however large a pair is.
    """
    known = rows.filter(F.col("entity_code").isNotNull() & F.col("counterparty_entity").isNotNull())
    place = F.row_number().over(Window.partitionBy("entity_code", "counterparty_entity").orderBy("transaction_id"))
    return known.select(
        F.col("entity_code").alias("entity"), F.col("counterparty_entity").alias("counterparty"), "transaction_id",
        place.alias("place"),
    ).filter(F.col("place") <= n)


def suggested_eliminations(findings: DataFrame, account: str = D.ELIMINATION_ACCOUNT) -> DataFrame:
    """Entries that would bring every open balance to zero."""
    return findings.filter("net_uneliminated != 0").select(
        F.col("entity").alias("entity_code"),
        F.lit(account).alias("account_code"),
        (-F.col("net_uneliminated")).cast("decimal(18,2)").alias("amount"),
        F.col("counterparty").alias("counterparty_entity"),
    )
