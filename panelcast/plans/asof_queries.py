"""Queries of the as-of join of two tables."""

from __future__ import annotations

from panelcast.operators.asof import asof_join
from panelcast.plans.registry import register
from panelcast.sources.tables import table
from pyspark.sql import functions as F

#: The first five nations are one key, which then has a fifth of all rows.
KEY = "CASE WHEN {0} < 5 THEN 0 ELSE {0} END"
SIDES = f"""WITH shipped AS (SELECT l_orderkey, l_linenumber, l_shipdate, {KEY.format('s_nationkey')} AS nation FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
ordered AS (SELECT {KEY.format('c_nationkey')} AS nation, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT l_orderkey, l_linenumber, s.nation, o.o_orderdate, o_orderkey, o_totalprice FROM shipped s ASOF LEFT JOIN ordered o ON s.nation = o.nation AND s.l_shipdate """


def shipped_and_ordered(spark, sf):
    key = lambda c: F.when(F.col(c) < 5, 0).otherwise(F.col(c)).alias("nation")
    shipped = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    ordered = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return shipped.select("l_orderkey", "l_linenumber", "l_shipdate", key("s_nationkey")), ordered.select(key("c_nationkey"), "o_orderdate", "o_orderkey", "o_totalprice")


@register(SIDES + ">= o.o_orderdate")
def shipments_asof_orders(spark, sf):
    """Each shipment with the last order of its supplier's nation on its day or earlier."""
    return asof_join(*shipped_and_ordered(spark, sf), ["nation"], "l_shipdate", ["o_orderkey", "o_totalprice"], "o_orderdate").drop("l_shipdate")


@register(SIDES + "> o.o_orderdate")
def shipments_before_orders(spark, sf):
    """The same, of earlier days only."""
    return asof_join(*shipped_and_ordered(spark, sf), ["nation"], "l_shipdate", ["o_orderkey", "o_totalprice"], "o_orderdate", before=True).drop("l_shipdate")
