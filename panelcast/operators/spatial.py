"""Points in territories of several rings, and nearest points, by grid cells in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.sinks import kept

POINT = "struct<x:double,y:double>"


def rings_of_wkt(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON in well-known text, holes and parts alike; none for an empty or null one."""
    rings = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\(([^()]+)\)"), F.lit(1))

    def point(p: Column) -> Column:
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(F.get(xy, F.lit(0)).cast("double").alias("x"), F.get(xy, F.lit(1)).cast("double").alias("y"))

    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


def rings_of_geojson(text: Column) -> Column:
    """Rings of a Polygon or MultiPolygon geometry in GeoJSON, holes and parts alike; none for a null or other geometry."""
    coordinates, kind = F.get_json_object(text, "$.coordinates"), F.get_json_object(text, "$.type")
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return F.coalesce(F.transform(rings, lambda r: F.transform(r, point)), F.array().cast(f"array<array<{POINT}>>"))


def edges_of(rings: Column) -> Column:
    """Edges (a, b) of rings that have three points or more; a ring's last point is joined to its first."""

    def of(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 3), of))


def holds(x: Column, y: Column, edges: Column) -> Column:
    """Whether x, y is strictly inside: on no edge, and a ray to larger x crosses an odd number of edges."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]
        return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False))

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        aligned = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return aligned & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return ~F.exists(edges, touches) & (F.size(F.filter(edges, crosses)) % 2 == 1)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether x, y is strictly inside one ring of points x, y."""
    return holds(x, y, edges_of(F.array(ring)))


def within(points: DataFrame, polygons: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """points (key, x, y) with territory_id of the polygon that holds them, the smallest of several; null outside all.

    polygons: territory_id and rings (arrays of points x, y; a point within an odd number of them is inside, so holes and several parts
    need no marks) or one ring. A point on an edge is outside. Points and polygons meet by the grid cells of the polygons' boxes, of
    which only the ids are copied; the edges are cut into bands of height cell, and a point sees those of its own band.
    """
    rings = F.col("rings") if "rings" in polygons.columns else F.array("ring")
    shapes = polygons.select(F.col("territory_id").alias("_t"), edges_of(rings).alias("_e")).where(F.size("_e") > 0)
    cells = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    lowest, highest = (lambda c: F.array_min(F.transform("_e", lambda e: e["a"][c]))), (lambda c: F.array_max(F.transform("_e", lambda e: e["a"][c])))
    boxes = shapes.select("_t", F.explode(cells(lowest("x"), highest("x"))).alias("_cx"), cells(lowest("y"), highest("y")).alias("_ys")).select("_t", "_cx", F.explode("_ys").alias("_cy"))
    each = shapes.select("_t", F.explode("_e").alias("_e"))
    ya, yb = F.col("_e.a.y"), F.col("_e.b.y")
    bands = each.select("_t", "_e", F.explode(cells(F.least(ya, yb), F.greatest(ya, yb))).alias("_cy")).groupBy("_t", "_cy").agg(F.collect_list("_e").alias("_edges"))
    asked = points.select(key, "x", "y", F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    met = asked.join(boxes, ["_cx", "_cy"]).join(bands, ["_t", "_cy"]).where(holds(F.col("x"), F.col("y"), F.col("_edges")))
    found = met.groupBy(key).agg(F.min("_t").alias("territory_id"))
    return points.join(found, key, "left")


#: Places of a cell that the first round may meet; cells are halved until none has more, HALVINGS times at most.
CROWD, HALVINGS = 16, 40


def nearest(points: DataFrame, places: DataFrame, k: int = 1) -> DataFrame:
    """point_id, rank, place_id, distance: the k nearest of places (place_id, x, y) to each of points (point_id, x, y), ties by place_id.

    Points and places are cut to cells. A round compares a point with the places of its own cell and the eight around it; where the k-th
    found is no farther than a cell's side none beyond them can be nearer, and the point is done. The others go on with cells of
    double side, until the cells cover everything. Cells begin small enough that a crowded region's hold few places, so its points are
    done before the sparse ones' cells are large. Places of equal coordinates are one with the k smallest ids. Rows with a null
    coordinate take no part; all places are returned where there are fewer than k.
    """
    asked = points.where("point_id is not null and x is not null and y is not null").select("point_id", "x", "y").distinct()
    first = Window.partitionBy("x", "y").orderBy("place_id")
    own = places.where("place_id is not null and x is not null and y is not null").select("place_id", "x", "y").distinct()
    own = kept(own.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k).drop("_k"))
    box = own.unionByName(asked.withColumnRenamed("point_id", "place_id")).agg(*[f(c).alias(n + c) for c in "xy" for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    spark = points.sparkSession
    schema = f"point_id {dict(asked.dtypes)['point_id']}, rank int, place_id {dict(own.dtypes)['place_id']}, distance double"
    done = spark.createDataFrame([], schema)
    if box["ax"] is None:
        return done
    side = extent = max(box["bx"] - box["ax"], box["by"] - box["ay"], 1e-9)
    cell = lambda c, s: F.floor((F.col(c) - box["a" + c]) / s)
    for _ in range(HALVINGS):
        crowd = own.groupBy(cell("x", side), cell("y", side)).agg(F.count_distinct("x", "y").alias("n")).agg(F.max("n")).first()[0] or 0
        if crowd <= CROWD:
            break
        side /= 2
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = asked
    while True:
        last = side > extent
        near = left.withColumn("_o", around).select("point_id", F.col("x").alias("_x"), F.col("y").alias("_y"), (cell("x", side) + F.col("_o.i")).alias("_cx"), (cell("y", side) + F.col("_o.j")).alias("_cy"))
        met = near.join(own.withColumns({"_cx": cell("x", side), "_cy": cell("y", side)}), ["_cx", "_cy"])
        met = met.withColumn("distance", F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))))
        rank = F.row_number().over(Window.partitionBy("point_id").orderBy("distance", "place_id"))
        best = kept(met.select("point_id", rank.alias("rank"), "place_id", "distance").where(F.col("rank") <= k))
        settled = best.groupBy("point_id").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
        if not last:
            settled = settled.where((F.col("_n") == k) & (F.col("_far") <= side * (1 - 1e-9)))
        done = done.unionByName(best.join(settled.select("point_id"), "point_id", "left_semi"))
        if last:
            return done
        left = kept(left.join(settled.select("point_id"), "point_id", "left_anti"))
        if left.isEmpty():
            return done
        side *= 2
