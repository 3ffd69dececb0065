"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import Scratch, cut

#: The index is fitted on at most so many vectors, those with the least hashed ids; every row is indexed.
SAMPLE = 8192
#: Coarse centroids fitted at once; an index of more lists has a second level, centroids of what is left of them.
FIRST_LEVEL = 1024
#: Dimensions of vectors that have an index of their own, the most frequent; all vectors of each other one are a list.
INDEXED = 16
#: Queries, or rows where there are none, on which an index is measured.
TRIED = 256
#: Rows of an inverted list, and queries that visit it, which one task compares.
LIST_BLOCK, QUERY_BLOCK = 4096, 2048


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has only finite components and isn't zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = assign(x, centres)
        for j in range(len(centres)):
            own = x[nearest == j]
            centres[j] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * x @ centres.T - (centres**2).sum(axis=1)).argmax(axis=1)


def scaled(vectors: pd.Series) -> np.ndarray:
    """The vectors in double precision, each over a power of two, so that squares stay finite; cosines are the same to the bit."""
    x = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(vectors: pd.Series) -> np.ndarray:
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Index:
    """Fitted on a sample of unit vectors: list centres, one codebook for each part, lists to visit, and how far codes mislead.

    A code stands for its vector up to an error of known length. slack is the share of that length by which the cosine of a query
    and a near vector is above the code's, at most but for a share of 1 - recall of what the sample's queries find.
    """

    centres: np.ndarray
    codebooks: np.ndarray
    probes: int
    slack: float = 1.0

    @staticmethod
    def fit(sample: np.ndarray, lists: int, parts: int, recall: float, top: int, seed: int = 3, asked: np.ndarray | None = None) -> Index:
        """probes is the least number of nearest lists that holds the share recall of the neighbours in the sample of asked, by default of its own.

        Up to FIRST_LEVEL lists have a centroid each; more are the sums of coarse centroids and of centroids of the
        sample's residuals, so that lists follow the table while the sample stays as it is. Asked vectors are no
        neighbours of themselves.
        """
        rng = np.random.default_rng(seed)
        centres = k_means(sample, min(lists, FIRST_LEVEL), rng)
        if lists > len(centres):
            second = k_means(sample - centres[assign(sample, centres)], -(-lists // len(centres)), rng)
            centres = (centres[:, None] + second[None]).reshape(-1, sample.shape[1])
        own = assign(sample, centres)
        rest = (sample - centres[own]).reshape(len(sample), parts, -1)
        codebooks = np.stack([k_means(rest[:, p], 256, rng) for p in range(parts)])
        index = Index(centres, codebooks, 1)
        if asked is None or not len(asked):
            asked = sample[rng.choice(len(sample), min(TRIED, len(sample)), replace=False)]
        near = asked @ sample.T
        near[near > 1 - 1e-12] = -2
        found = np.argsort(-near, axis=1)[:, :top]
        rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, own[found], axis=1).ravel()) + 1
        index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
        # in a whole table neighbours are nearer than in a sample, up to a copy of the query
        off, length = index.misses(sample, own, index.codes_of(sample, own))
        share = off / np.maximum(length, 1e-12)[:, None]
        met = [np.einsum("qd,qkd->qk", asked, share[found]), np.einsum("nd,nd->n", sample, share)]
        index.slack = float(min(1.0, max(0.0, *[np.quantile(x, 1 - (1 - recall) / 5) for x in met])))
        return index

    def misses(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the codes of unit vectors leave, and its length."""
        coded = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.codebooks)], axis=1)
        off = x - self.centres[lists] - coded
        return off, np.sqrt((off * off).sum(axis=1))

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return assign(x, self.centres)

    def codes_of(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (x - self.centres[lists]).reshape(len(x), len(self.codebooks), -1)
        return np.stack([assign(rest[:, p], self.codebooks[p]) for p in range(len(self.codebooks))], axis=1).astype(np.uint8)

    def visits(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The probes lists nearest to each of x, and as many more as it takes until they have least rows; lists without rows are passed over."""
        order = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")
        out = []
        for row in order:
            row = row[sizes[row] > 0]
            enough = int(np.searchsorted(np.cumsum(sizes[row]), least)) + 1
            out.append(row[: max(self.probes, enough)])
        return out


def search(vectors: DataFrame, every: int = 50, top: int = 5, parts: int = 16, recall: float = 0.99, keep: int = 96) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows by cosine of each vec_id divisible by every.

    A query visits the lists nearest to it, and further ones until they have top candidates, so that it has fewer only where the table
    has; how many lists is measured on a sample of the queries. In each block of a list, distances from tables of the query against the
    codebooks choose keep rows, and then every other row whose code, with the slack of its error, reaches the worst of the top best of
    those; the exact cosine in double precision ranks them all, ties by smaller vec_id. Rows of the query's own vec_id are no
    candidates. Vectors that are null, zero or hold null or non-finite components, and null ids take no part. A cosine needs equal
    dimensions, so vectors of each dimension meet among themselves; those of a dimension that has no index of its own, in one list each.
    Repeated queries are answered once, by the least of their vectors; repeated rows are candidates each. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null").where(usable(F.col("embedding"))).withColumn("d", F.size("embedding"))
    with Scratch(spark) as scratch:
        sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(INDEXED).collect()
        indexes = {r["d"]: fitted(rows.where(F.col("d") == r["d"]), r["n"], r["d"], parts, recall, top, every) for r in sizes}
        return cut(searched(rows, indexes, scratch, every, top, keep))


def fitted(rows: DataFrame, n: int, dimension: int, parts: int, recall: float, top: int, every: int) -> Index:
    """The index of n vectors of one dimension, from those with the least hashed ids, measured on such of the queries."""
    least = lambda df, most: unit(df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()["embedding"])
    asked = rows.where(F.col("vec_id") % every == 0)
    parts = next(p for p in range(min(parts, dimension), 0, -1) if dimension % p == 0)
    return Index.fit(least(rows, SAMPLE), int(max(1, n**0.5 / 4)), parts, recall, top, asked=least(asked, TRIED) if not asked.isEmpty() else None)


def searched(rows: DataFrame, indexes: dict[int, Index], scratch: Scratch, every: int, top: int, keep: int) -> DataFrame:
    """search over usable rows with their dimension d."""
    kind = dict(rows.dtypes)["embedding"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("d"):
                index = indexes.get(d)
                if index:
                    x = unit(part["embedding"])
                    lists = index.lists_of(x)
                    codes = index.codes_of(x, lists)
                    yield part.assign(list=lists, codes=[c.tobytes() for c in codes], error=index.misses(x, lists, codes)[1])
                else:
                    yield part.assign(list=0, codes=b"", error=0.0)

    indexed = scratch.table(rows.mapInPandas(place, f"vec_id long, embedding {kind}, d int, list int, codes binary, error double"), "index")
    # a row for each list of an index; candidates of a query are distinct from its own id's rows, of which there are as many as repeats
    filled = {(r["d"], r["list"]): r["n"] for r in indexed.where(F.col("d").isin(list(indexes))).groupBy("d", "list").agg(F.count("*").alias("n")).collect()}
    counts = {d: np.array([filled.get((d, i), 0) for i in range(len(x.centres))]) for d, x in indexes.items()}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby("d"):
                found = [np.zeros(1, int)] * len(part)
                if d in indexes:
                    x, repeats = unit(part["embedding"]), part["repeats"].to_numpy()
                    found = [indexes[d].visits(x[i : i + 1], counts[d], top + repeats[i])[0] for i in range(len(x))]
                again = part.iloc[np.repeat(np.arange(len(part)), [len(f) for f in found])]
                yield again.rename(columns={"vec_id": "query_id"}).drop(columns="repeats").assign(list=np.concatenate(found))

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "d").agg(F.min("embedding").alias("embedding"), F.count("*").alias("repeats"))
    queries = queries.withColumn("_k", F.row_number().over(Window.partitionBy("vec_id").orderBy("d"))).where("_k = 1").drop("_k")
    visits = scratch.table(queries.mapInPandas(visit, f"query_id long, d int, embedding {kind}, list int"), "visits")
    keys = ["d", "list"]
    count = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"))
    shape = count(indexed).withColumnRenamed("n", "rows").join(count(visits), keys)
    shape = cut(shape.select(*keys, F.ceil(F.col("rows") / LIST_BLOCK).alias("x"), F.ceil(F.col("n") / QUERY_BLOCK).alias("y")))
    left = indexed.join(shape, keys).withColumn("at", F.pmod(F.xxhash64("vec_id"), F.col("x"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("y") - 1)))
    right = visits.join(shape, keys).withColumn("to", F.pmod(F.xxhash64("query_id"), F.col("y"))).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x") - 1)))

    def compare(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(asked):
            own = own.sort_values("vec_id", kind="stable")
            index, ids = indexes.get(int(own["d"].iloc[0])), own["vec_id"].to_numpy()
            raw = scaled(own["embedding"])
            norms = np.sqrt((raw * raw).sum(axis=1))
            if index:
                centre = index.centres[int(own["list"].iloc[0])]
                codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1).astype(np.int64)
                offsets = np.arange(codes.shape[1]) * index.codebooks.shape[1]
                slack = index.slack * own["error"].to_numpy() + 1e-9
            for query_id, q in zip(asked["query_id"], scaled(asked["embedding"]), strict=True):
                length = np.sqrt((q * q).sum())
                cosines = lambda at: (raw[at] * q).sum(axis=1) / (norms[at] * length)  # noqa: B023, E731
                close = np.flatnonzero(ids != query_id)
                if index and len(close) > keep:
                    table = np.einsum("pcd,pd->pc", index.codebooks, (q / length).reshape(len(index.codebooks), -1)).ravel()
                    near = table[codes[close] + offsets].sum(axis=1) + centre @ q / length
                    first = np.argpartition(near, -keep)[-keep:]
                    worst = np.partition(cosines(close[first]), -top)[-top] if keep >= top else -1
                    likely = near + slack[close] >= worst
                    likely[first] = True
                    close = close[likely]
                score = cosines(close)
                best = np.lexsort((ids[close], -score))[:top]
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += ids[close][best].tolist()
                out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    cells = left.groupBy(*keys, "at", "to").cogroup(right.groupBy(*keys, "at", "to"))
    found = cells.applyInPandas(compare, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
