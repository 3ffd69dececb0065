"""Hard negatives of anchors: a kNN join of vectors by inner product, over Voronoi cells."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, cut, spread_join

#: Pivots of a dimension are at most so many rows, those with the least hashed ids; the cells around them hold every row.
MAX_PIVOTS = 256
#: Dimensions that have pivots, the most frequent; vectors of others have one cell, around the origin.
MAX_DIMENSIONS = 16
#: Rows of a cell and anchors of a group on average, where that needs no more than MAX_PIVOTS pivots.
CELL_ROWS, GROUP_ANCHORS = 8192, 1024
#: Anchors and candidates that one task compares at most.
PART, BLOCK = 8192, 16384
#: Pairs whose scores are held at once in a task.
PAIRS = 1 << 20
#: Up to this product of norms every partial sum of an inner product of whole numbers is exact in double precision.
EXACT = float(2**53)
#: Up to this norm distances bound which rows may meet; beyond it all of a dimension do.
BOUNDED = 1e9
#: Distances are widened by this share of the largest norm, against rounding.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has only finite components."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(packed: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), d)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component, so that all have the norm most: the nearest to (a, 0) has the largest inner product with a."""
    return np.c_[x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0))


def products(own: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered vectors, exact; by Python's integers where double precision may not do, held in 64 bits."""
    if not own.shape[1] or (own * own).sum(axis=1).max() * (asked * asked).sum(axis=1).max() < EXACT**2:
        return (own @ asked.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(own) @ whole(asked).T, -(2**63), 2**63 - 1).astype(np.int64)


class Cells:
    """Pivots of each dimension, and the largest norm: where rows belong, and the distances that bound who meets whom."""

    def __init__(self, pivots: dict[int, tuple[np.ndarray, int]], most: float):
        self.pivots, self.most = {d: (augmented(p, most), groups) for d, (p, groups) in pivots.items()}, most

    def of(self, d: int) -> tuple[np.ndarray, int]:
        return self.pivots.get(d) or (np.zeros((1, d + 1)), 1)

    def place(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with their cell and dist from its pivot; of anchors the group, and apart, their distance from each pivot."""
        for b in batches:
            for d, rows in b.groupby("d"):
                pivots, groups = self.of(d)
                x, anchor = matrix(rows["v"], d), rows["anchor"].to_numpy(bool)
                to = distances(augmented(x, self.most), pivots)
                mine = distances(np.c_[x[anchor], np.zeros(anchor.sum())], pivots)
                group, apart = np.zeros(len(rows), np.int64), np.full(len(rows), None, object)
                group[anchor] = mine[:, :groups].argmin(axis=1)
                for i, m in zip(np.flatnonzero(anchor), mine, strict=True):
                    apart[i] = m.tolist()
                cell = to.argmin(axis=1)
                yield rows.assign(cell=cell, dist=to[np.arange(len(rows)), cell], group=group, apart=apart)


def in_parts(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """anchors with part: their group, split where it has more than PART."""
    sizes = anchors.groupBy(*keys, "group").agg(F.ceil(F.count("*") / PART).alias("_parts"))
    return anchors.join(sizes, [*keys, "group"]).withColumn("part", F.col("group") + MAX_PIVOTS * F.pmod(F.xxhash64("key"), F.col("_parts"))).drop("_parts", "group")


def meeting(candidates: DataFrame, anchors: DataFrame, lo: Column, hi: Column, keys: list[str], found: partial, schema: str) -> DataFrame:
    """What found makes of each block of candidates with each part of anchors that a candidate of it may serve.

    lo, hi: of an anchor's distance d from a pivot, the distances from that pivot between which a row may serve it. A candidate is sent
    to the parts that have such an anchor; a part's candidates are dealt to blocks, and its anchors are sent to each.
    """
    each = anchors.select("*", F.posexplode("apart").alias("cell", "d_pivot"))
    bounds = each.groupBy(*keys, "cell", "part").agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi")).withColumnRenamed("part", "_part")
    sent = candidates.select(*keys, "key", "vec_id", "label", "v", "cell", "dist") if "label" not in keys else candidates.select(*keys, "key", "vec_id", "v", "cell", "dist")
    sent = sent.join(bounds, [*keys, "cell"]).where(F.col("dist").between(F.col("_lo"), F.col("_hi"))).withColumnRenamed("_part", "part").drop("_lo", "_hi", "cell", "dist")
    blocks = cut(sent.groupBy(*keys, "part").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")))
    sent = sent.join(blocks, [*keys, "part"]).withColumn("at", F.pmod(F.xxhash64("key"), F.col("_blocks"))).drop("_blocks")
    asked = anchors.drop("apart", "near", "far").join(blocks, [*keys, "part"]).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    by = [*keys, "part", "at"]
    return sent.toDF(*sent.columns).groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(lambda own, anchors: found(own, anchors), schema)


def in_chunks(own: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Of each anchor its place in asked and its scores with all of own."""
    d = int(asked["d"].iloc[0])
    x, a = matrix(own["v"], d), matrix(asked["v"], d)
    wide = max(1, PAIRS // len(own))
    for i in range(0, len(a), wide):
        scores = products(x, a[i : i + wide])
        for j in range(scores.shape[1]):
            yield i + j, scores[:, j]


def nearest(own: pd.DataFrame, asked: pd.DataFrame, top: int) -> pd.DataFrame:
    """Of each anchor the first top other rows of a block, all of its label."""
    out: dict[str, list] = {"key": [], "anchor_id": [], "other": [], "positive_id": [], "score": []}
    if len(own) and len(asked):
        ids, keys = own["vec_id"].to_numpy(), own["key"].to_numpy()
        for i, score in in_chunks(own, asked):
            anchor = int(asked["key"].iloc[i])
            others = np.flatnonzero(keys != anchor)
            if len(others) > top:
                others = others[score[others] >= np.partition(score[others], -top)[-top]]
            best = others[np.lexsort((keys[others], ids[others], -score[others]))][:top]
            out["key"] += [anchor] * len(best)
            out["anchor_id"] += [int(asked["vec_id"].iloc[i])] * len(best)
            out["other"] += keys[best].tolist()
            out["positive_id"] += ids[best].tolist()
            out["score"] += score[best].tolist()
    return pd.DataFrame(out).astype("int64")


def below(own: pd.DataFrame, asked: pd.DataFrame, top: int, low: int, high: int) -> pd.DataFrame:
    """Of each anchor and positive the first top rows of a block that have another label and a score in the positive's window."""
    out: dict[str, list] = {"key": [], "place": [], "other": [], "negative_id": [], "score": []}
    if len(own) and len(asked):
        ids, keys, labels = own["vec_id"].to_numpy(), own["key"].to_numpy(), own["label"].to_numpy()
        for i, score in in_chunks(own, asked):
            limits = [int(p) for p in asked["scores"].iloc[i]]
            inside = np.flatnonzero((labels != asked["label"].iloc[i]) & (score >= -(-low * min(p for p in limits if p >= 0) // high)) & (score <= max(limits)))
            inside = inside[np.lexsort((keys[inside], ids[inside], -score[inside]))]
            falling = -score[inside]
            for place, p in enumerate(limits):
                first = np.searchsorted(falling, -p)
                best = [j for j in inside[first : first + top] if low * p <= high * int(score[j])]
                out["key"] += [int(asked["key"].iloc[i])] * len(best)
                out["place"] += [place] * len(best)
                out["other"] += keys[best].tolist()
                out["negative_id"] += ids[best].tolist()
                out["score"] += score[best].tolist()
    return pd.DataFrame(out).astype("int64")


def first_of(found: DataFrame, by: list[str], name: str, top: int) -> DataFrame:
    """The first top rows by score of what blocks found, numbered from 0 as place."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), name, "other")
    return found.withColumn("_k", (F.row_number().over(w) - 1).cast("int")).where(F.col("_k") < top)


def mine(
    vectors: DataFrame, every: int = 100, top: int = 5, low: int = 80, high: int = 100, relabel_every: int = 7, labels: int = 10, scale: int = 256,
    cell_rows: int = CELL_ROWS, group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each vec_id divisible by every.

    Components become floor(scale * x). Of each anchor the first top other rows of its label by inner product (ties by smaller
    vec_id) are its positives; of each positive the first top rows of other labels whose score is low to high hundredths of the
    positive's are returned. Where vec_id is divisible by relabel_every, label is the next modulo labels.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; rows of other dimensions never meet;
    empty vectors score 0 with each other. Repeated rows are rows each: a twin of an anchor is an anchor, and its positive. A score
    beyond 64 bits counts as the nearest that fits. Other columns are ignored, whatever their names; a table without rows gives none.

    Vectors with one more component have equal norms, so that the largest product is the smallest distance. Each row belongs to the
    cell of its nearest pivot, each anchor to the group of its own; a group's distances from the pivots bound which rows of a cell might
    serve it, by the triangle inequality, and only those are sent there, dealt to blocks. Results are exact whatever the pivots are.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null and label is not null").where(usable(F.col("embedding")))
    label = F.col("label").cast("long")
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double")).alias("x"), F.size("embedding").alias("d"),
        (F.col("vec_id") % every == 0).alias("anchor"), F.monotonically_increasing_id().alias("key"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [np.floor(np.asarray(x, np.float64)) for x in b["x"]]
            yield b.drop(columns="x").assign(v=[x.tobytes() for x in v], norm=[float(np.sqrt((x * x).sum())) for x in v])

    with Scratch(spark) as scratch:
        rows = scratch.table(rows.mapInPandas(pack, "vec_id long, label long, d int, anchor boolean, key long, v binary, norm double"), "rows")
        most = rows.agg(F.max("norm")).first()[0] or 0.0
        sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).orderBy(F.desc("n"), "d").limit(MAX_DIMENSIONS).collect()
        pivots = {}
        for r in sizes if most <= BOUNDED else []:
            if r["n"] > cell_rows:
                chosen = rows.where(F.col("d") == r["d"]).orderBy(F.xxhash64("vec_id", "key"), "key").limit(min(MAX_PIVOTS, -(-r["n"] // cell_rows))).select("v").toPandas()
                pivots[r["d"]] = matrix(chosen["v"], r["d"]), min(len(chosen), max(1, -(-r["anchors"] // group_anchors)))
        cells = Cells(pivots, most if most <= BOUNDED else 0.0)
        placed = scratch.table(rows.mapInPandas(cells.place, "vec_id long, label long, d int, anchor boolean, key long, v binary, norm double, cell int, dist double, group long, apart array<double>"), "placed")
        return cut(_searched(placed, scratch, most, top, low, high))


def _searched(placed: DataFrame, scratch: Scratch, most: float, top: int, low: int, high: int) -> DataFrame:
    slack, d = SLACK * (most + 1), F.col("d_pivot")
    bounded = most <= BOUNDED
    anchors = placed.where("anchor").select("key", "vec_id", "label", "d", "v", "norm", "group", "apart").withColumn("_ld", F.concat_ws(":", "d", "label"))
    candidates = placed.select("key", "vec_id", "label", "d", "v", "cell", "dist")

    # the distance within which top other rows of an anchor's label lie, by way of the pivots; the anchor may be one of the rows
    w = Window.partitionBy("d", "label", "cell", F.pmod("key", F.lit(64))).orderBy("dist", "key")
    close = placed.select("d", "label", "cell", "dist", "key").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top + 1)
    w = Window.partitionBy("d", "label", "cell").orderBy("dist", "key")
    close = close.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top + 1)
    close = close.groupBy(F.concat_ws(":", "d", "label").alias("_ld")).agg(F.collect_list(F.struct("cell", "dist")).alias("_close"))
    ways = F.array_sort(F.transform("_close", lambda c: F.element_at("apart", c["cell"] + 1) + c["dist"]))
    far = F.coalesce(F.get(ways, F.lit(top)), F.lit(float("inf"))) if bounded else F.lit(float("inf"))
    asked = spread_join(anchors, close, "_ld", F.xxhash64("key")).withColumn("far", far + slack).drop("_ld", "_close", "norm")
    asked = in_parts(scratch.table(asked, "anchors"), ["d", "label"])
    found = meeting(candidates, asked, d - F.col("far"), d + F.col("far"), ["d", "label"], partial(nearest, top=top), "key long, anchor_id long, other long, positive_id long, score long")
    positives = scratch.table(first_of(found, ["key"], "positive_id", top).select("key", "anchor_id", F.col("_k").alias("place"), "positive_id", F.col("score").alias("positive_score")), "positives")

    # scores in a positive's window lie between two distances; no score is at least low hundredths of a negative one and not above it
    scores = positives.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = anchors.drop("_ld").join(scores, "key").where(F.exists("scores", lambda s: s >= 0))
    apart = lambda score: F.sqrt(F.greatest(F.col("norm") * F.col("norm") + most * most - 2 * score, F.lit(0.0)))
    least = F.array_min(F.filter("scores", lambda s: s >= 0)) * F.lit(low / high)
    asked = asked.withColumn("far", (apart(least) + slack) if bounded else F.lit(float("inf"))).withColumn("near", (apart(F.array_max("scores")) - slack) if bounded else F.lit(0.0)).drop("norm")
    asked = in_parts(scratch.table(asked, "asked"), ["d"])
    found = meeting(candidates, asked, F.greatest(d - F.col("far"), F.col("near") - d), d + F.col("far"), ["d"], partial(below, top=top, low=low, high=high), "key long, place int, other long, negative_id long, score long")
    ranked = first_of(found, ["key", "place"], "negative_id", top)
    out = ranked.join(positives, ["key", "place"])
    return out.select("anchor_id", "positive_id", (F.col("_k") + 1).alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


#: The same in DuckDB's SQL, over all pairs of an anchor and a row.
MINED_SQL = """
WITH vectors AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.k AS ka, a.vec_id AS anchor_id, a.label = b.label AS same, b.k AS kb, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (SELECT ka, anchor_id, kb, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY ka ORDER BY score DESC, vec_id, kb) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.ka, p.kb ORDER BY score DESC, n.vec_id, n.kb))::INT AS rank, n.vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON p.ka = n.ka WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.ka, p.kb ORDER BY score DESC, n.vec_id, n.kb) <= 5
"""
