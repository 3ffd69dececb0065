"""Groups of similar texts from hash buckets, without comparing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import attach, connected_components, cut, fetch, spread_join, tidy

#: A table of buckets up to this many rows of two longs is broadcast, a larger one shuffled.
LARGE_BUCKETS = 400_000
#: Buckets up to FEW nodes are compared in a join, larger ones in blocks of BLOCK.
FEW, BLOCK = 16, 384


def shingle_set(text: str | None, size: int) -> set[bytes]:
    """Distinct shingles of ASCII-lower-cased words; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard_pairs(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Of the pairs a, b those whose texts (node, text) have an exact shingle Jaccard of least or more."""

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                p, q = shingle_set(x, size), shingle_set(y, size)
                out.append(len(p & q) >= least * len(p | q))
            yield pd.Series(out, dtype=bool)

    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return both.where(similar("text_a", "text_b")).select("a", "b")


def similar_within(texts: list[str | None], size: int, least: float) -> np.ndarray:
    """For each text the first one that it reaches over pairs of similarity least or more."""
    sets = [np.unique(np.fromiter((xxhash.xxh64_intdigest(x) for x in shingle_set(t, size)), np.uint64)) for t in texts]
    sizes = np.array([len(x) for x in sets], np.float32)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1  # a shingle of one text is in no intersection
    both = np.zeros((len(sets), len(sets)), np.float32)
    held = often[column] > 1
    owner, column = owner[held], shared[column[held]]
    for at in range(0, int(shared[-1]) + 1 if len(values) else 0, 2048):
        own = (column >= at) & (column < at + 2048)
        part = np.zeros((len(sets), 2048), np.float32)
        part[owner[own], column[own] - at] = 1
        both += part @ part.T
    linked = both >= np.float32(least) * (sizes[:, None] + sizes[None, :] - both) - 1e-3
    first = np.arange(len(sets))
    while True:
        lower = np.where(linked, first[None, :], len(sets)).min(axis=1)
        lower = np.minimum(first, lower)[np.minimum(first, lower)]
        if (lower == first).all():
            return first
        first = lower


def block_edges(members: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Edges a, b that link the similar nodes of each bucket, for buckets of any size.

    members: bucket, node, and n, the bucket's number of them. A bucket is dealt into blocks of BLOCK
    nodes; every two blocks meet in one task, which compares all their pairs and returns a forest.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = members.select("bucket", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.select("node", "bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        first = similar_within(part["text"].tolist(), size, least)
        tied = first != np.arange(len(first))
        return pd.DataFrame({"a": part["node"].to_numpy()[first[tied]], "b": part["node"].to_numpy()[tied]}, dtype="int64")

    return met.join(texts, "node").groupBy("bucket", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def verified_components(keyed: DataFrame, near: Callable[[DataFrame], DataFrame], texts_of: Callable[[DataFrame], DataFrame], size: int, least: float, inner: DataFrame | None = None) -> DataFrame:
    """node, component over all pairs of nodes that share a bucket and have a shingle Jaccard of least or more.

    near keeps those pairs a, b that are worth a look; texts_of gives node, text for a table of nodes.
    keyed has node (long), bucket and crowd, each pair once; inner has node and member, further nodes in
    all of node's buckets, where crowd is true. Buckets of two or three nodes give their pairs, which
    their least, greatest and xor tell. In a larger one each node first meets one only, the one that
    shares most buckets with others: the text that copies were made from is nearest to all of them, so
    most of a large group is then in one component. A pair within a component can't change the
    components, so only pivots that met several components follow, with all that they met. Those of the
    same component are one family; all of a family's pairs across components are compared, in a join up to FEW
    nodes, else in blocks, by the exact similarity alone. No candidate is capped.
    """
    spark = keyed.sparkSession
    inner = inner if inner is not None else spark.createDataFrame([], "node long, member long")
    facts = [F.count("*").alias("size"), F.max("crowd").alias("crowd"), F.min("node").alias("x"), F.max("node").alias("y"), F.bit_xor("node").alias("z")]
    met = cut(keyed.groupBy("bucket").agg(*facts).where("size > 1").withColumn("z", F.col("z").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("y"))))
    large = cut(met.where("size > 3 or crowd").groupBy("size", "x", "y", "z").agg(F.min("bucket").alias("bucket")).select("bucket", "size"))  # equal sets once
    members = cut(fetch(keyed, large, ["bucket"], LARGE_BUCKETS).select("bucket", "node", "size"))
    tidy(spark)
    own = members.groupBy("node").agg(F.sum("size").alias("weight"), F.collect_list("bucket").alias("buckets"))  # a bucket for each table at most
    pivots = cut(own.select("node", "weight", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot")))
    mates = cut(spread_join(members.select("bucket", "node"), pivots, "bucket", F.xxhash64("node")).select("pivot", "node").distinct())
    stars = mates.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    stars = stars.unionByName(inner.select(F.least("node", "member").alias("a"), F.greatest("node", "member").alias("b")))
    for a, b, sizes in (("x", "y", "size in (2, 3)"), ("x", "z", "size = 3"), ("z", "y", "size = 3")):
        stars = stars.unionByName(met.where(f"{sizes} and not crowd").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    tried = cut(near(stars.distinct()))
    texts = cut(texts_of(cut(tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct())))
    edges = cut(jaccard_pairs(tried, texts, size, least))
    parts = connected_components(edges)
    tidy(spark)

    nodes = members.select("node").union(inner.select("node")).distinct()
    held = nodes.select("node", F.col("node").alias("member")).unionByName(inner).join(parts.withColumnRenamed("node", "member"), "member", "left")
    held = cut(held.select("node", "member", F.coalesce("component", "member").alias("part")))
    spread = cut(held.groupBy("node").agg(F.min("part").alias("p"), F.max("part").alias("q")))
    split = mates.join(spread, "node").groupBy("pivot").agg(F.min("p").alias("p"), F.max("q").alias("q")).where("p < q").select("pivot")
    families = split.join(spread, split["pivot"] == spread["node"]).select("pivot", F.col("p").alias("family"))
    rest = spread_join(mates, families, "pivot", F.xxhash64("node")).select("family", "node")
    rest = rest.unionByName(spread.where("p < q").select(F.col("p").alias("family"), "node")).distinct()
    rest = cut(rest.join(held, "node").select("family", F.col("member").alias("node"), "part").distinct())
    sizes = rest.groupBy("family").agg(F.count("*").alias("n")).withColumn("size", F.col("n"))
    rest = cut(attach(rest, cut(sizes), "family", rest.count(), F.xxhash64("node")).withColumnRenamed("size", "n"))
    few = rest.where(F.col("n") <= FEW).select("family", "part", "node")
    across = few.withColumnsRenamed({"part": "p", "node": "x"}).join(few.withColumnsRenamed({"part": "q", "node": "y"}), "family").where("p < q")
    fresh = cut(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    many = rest.where(F.col("n") > FEW).select(F.col("family").alias("bucket"), "node", "n")
    asked = cut(fresh.select(F.col("a").alias("node")).union(fresh.select("b")).union(many.select("node")).distinct())
    texts = cut(texts_of(asked))
    edges = edges.unionByName(jaccard_pairs(fresh, texts, size, least)).unionByName(block_edges(many, texts, size, least))
    out = connected_components(edges)
    tidy(spark)
    return out
