"""Entity-period tables of the star schema that several queries start from, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import period_key
from ..sources.tables import table


def cents(x: str):
    return F.round(F.col(x) * 100).cast("bigint")


def period(stamp: str) -> list:
    year, month = F.year(stamp).cast("bigint"), F.month(stamp).cast("bigint")
    return [period_key(year, month).alias("wk"), year.alias("yr"), month.alias("mo")]


def customer_month(spark: SparkSession, sf: str) -> DataFrame:
    """``cust, wk, yr, mo, spend`` (cents) ``, n`` for months with an order."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), *period("o_orderdate"), cents("o_totalprice").alias("c"))
    return orders.groupBy("cust", "wk", "yr", "mo").agg(F.sum("c").alias("spend"), F.count(F.lit(1)).alias("n"))


CM = "cm AS (SELECT o_custkey AS cust, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS wk, year(o_orderdate)::BIGINT AS yr, month(o_orderdate)::BIGINT AS mo, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS spend, count(*)::BIGINT AS n FROM orders GROUP BY ALL)"


def supplier_month(spark: SparkSession, sf: str) -> DataFrame:
    """``supp, wk, yr, mo, qty, small`` (quantity in lots up to 20) ``, cents, n``."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), *period("l_shipdate"), F.col("l_quantity").alias("q"), cents("l_extendedprice").alias("c"))
    return lines.groupBy("supp", "wk", "yr", "mo").agg(F.sum("q").alias("qty"), F.sum(F.when(F.col("q") <= 20, F.col("q")).otherwise(0.0)).alias("small"), F.sum("c").alias("cents"), F.count(F.lit(1)).alias("n"))


SM = "sm AS (SELECT l_suppkey AS supp, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS wk, year(l_shipdate)::BIGINT AS yr, month(l_shipdate)::BIGINT AS mo, sum(l_quantity) AS qty, sum(CASE WHEN l_quantity <= 20 THEN l_quantity ELSE 0.0 END) AS small, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)"


def customer_year(spark: SparkSession, sf: str) -> DataFrame:
    """``entity, season, grp, games`` (orders) ``, points`` (spend in thousands)."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("season"), cents("o_totalprice").alias("c"))
    yearly = orders.groupBy("entity", "season").agg(F.count(F.lit(1)).cast("double").alias("games"), (F.sum("c") / 100000.0).alias("points"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"))
    return yearly.join(customers, "entity")


def customer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``customer_year`` with ``opportunities``: lines of the year's orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("bigint").alias("season"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    found = orders.join(lines, "o_orderkey").groupBy("entity", "season").agg(F.sum("n").cast("double").alias("opportunities"))
    return customer_year(spark, sf).join(found, ["entity", "season"], "left").fillna(0.0, ["opportunities"])


CY = "cy AS (SELECT o_custkey AS entity, year(o_orderdate)::BIGINT AS season, c_mktsegment AS grp, count(*)::DOUBLE AS games, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 100000.0 AS points FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
#: The panel: lags by season number.
PANEL = CY + ", panel AS (SELECT cy.*, " + ", ".join(f"l{n}.games AS prev{n}_games, l{n}.points AS prev{n}_points" for n in (1, 2, 3)) + " FROM cy " + " ".join(f"LEFT JOIN cy l{n} ON l{n}.entity = cy.entity AND l{n}.season = cy.season - {n}" for n in (1, 2, 3)) + ")"
