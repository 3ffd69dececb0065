"""Queries of points in territories with holes and parts, and of nearest places on an irregular grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import spatial
from panelcast.plans.registry import register, rounded
from panelcast.sources.tables import table

#: A nation's territory: a square of side 8 with a hole of side 2, and a triangle beside it.
CORNERS = "SELECT n_nationkey AS territory_id, (n_nationkey % 5) * 12.0 AS x0, (n_nationkey // 5) * 12.0 AS y0 FROM nation"
#: Customers stand on a grid of quarters, so that many are on edges and corners.
STANDS = "SELECT c_custkey, (c_custkey % 240) / 4.0 AS x, (floor(abs(c_acctbal)) % 240) / 4.0 AS y FROM customer"


def stands(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", ((F.col("c_custkey") % 240) / 4.0).alias("x"), ((F.floor(F.abs("c_acctbal")) % 240) / 4.0).alias("y"))


def territories(spark, sf):
    """territory_id, x0, y0 and wkt, a polygon in well-known text with a hole and a second part."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("territory_id"), ((F.col("n_nationkey") % 5) * 12.0).alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 12.0).alias("y0"))
    at = lambda dx, dy: F.concat_ws(" ", F.col("x0") + dx, F.col("y0") + dy)
    ring = lambda *ps: F.concat(F.lit("("), F.concat_ws(", ", *[at(*p) for p in ps]), F.lit(")"))
    square, hole, wedge = ring((0, 0), (8, 0), (8, 8), (0, 8), (0, 0)), ring((3, 3), (3, 5), (5, 5), (5, 3), (3, 3)), ring((9, 0), (11, 0), (9, 8), (9, 0))
    return n.withColumn("wkt", F.concat(F.lit("MULTIPOLYGON (("), square, F.lit(", "), hole, F.lit("), ("), wedge, F.lit("))")))


HELD = f"""WITH corners AS ({CORNERS}), stands AS ({STANDS})
SELECT c_custkey, x, y, min(territory_id) AS territory_id FROM stands LEFT JOIN corners
  ON (x > x0 AND x < x0 + 8 AND y > y0 AND y < y0 + 8 AND NOT (x BETWEEN x0 + 3 AND x0 + 5 AND y BETWEEN y0 + 3 AND y0 + 5)) OR (x > x0 + 9 AND y > y0 AND 4 * (x - x0 - 9) + (y - y0) < 8)
GROUP BY ALL"""


@register(HELD)
def points_in_parts(spark, sf):
    """Territories from well-known text, with a hole and two parts; a point on an edge is in none."""
    rings = territories(spark, sf).select("territory_id", spatial.rings_of_wkt(F.col("wkt")).alias("rings"))
    return spatial.within(stands(spark, sf), rings, "c_custkey", 1.5)


@register(HELD)
def points_in_geojson(spark, sf):
    """The same territories from GeoJSON."""
    t = territories(spark, sf).withColumn("_r", spatial.rings_of_wkt(F.col("wkt")))
    pairs = F.transform("_r", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    parts = F.array(F.slice(pairs, 1, 2), F.slice(pairs, 3, 1))
    text = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates")))
    return spatial.within(stands(spark, sf), t.select("territory_id", spatial.rings_of_geojson(text).alias("rings")), "c_custkey", 3.0)


PLACED = """WITH p AS (SELECT c_custkey, c_acctbal AS x, (c_custkey * 7919 % 1000) * 1.0 AS y FROM customer), s AS (SELECT s_suppkey, s_acctbal AS x, (s_suppkey * 104729 % 1000) * 1.0 AS y FROM supplier)"""


@register(PLACED + """
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), s_suppkey) AS rank, s_suppkey, round(sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 6) AS distance
FROM p, s QUALIFY rank <= 3""")
def nearest_places(spark, sf):
    """The three suppliers nearest to each customer, on no grid."""
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 1000 * 1.0).alias("y"))
    places = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 104729 % 1000 * 1.0).alias("y"))
    out = rounded(spatial.nearest(points, places, 3), 6, "distance")
    return out.select(F.col("point_id").alias("c_custkey"), F.col("rank").cast("long").alias("rank"), F.col("place_id").alias("s_suppkey"), "distance")
