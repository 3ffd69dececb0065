"""Exact quantiles of groups of any size by ranges of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.sources.sinks import kept

#: Values of a group that one task sorts; of a larger group only the range that holds the rank is sorted.
GATHERED = 100_000
#: Ranges into which a group's values are counted in a round.
RANGES = 64


def grouped_quantile(rows: DataFrame, keys: list[str], x: str, q: float, name: str) -> DataFrame:
    """keys and name: the quantile q of x in each group, linear between neighbours; null for a group without values.

    A group of up to GATHERED values is aggregated at once. A larger one is counted by RANGES ranges between its least and greatest value;
    only the ranges with the two ranks around q are kept, and counted again, until few values are left.
    """
    sizes = rows.groupBy(*keys).agg(F.count(x).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= GATHERED:
        return rows.groupBy(*keys).agg(F.percentile(x, F.lit(q)).alias(name))
    sizes = kept(sizes)
    renamed = {k: f"_g{i}" for i, k in enumerate(keys)}
    # without keys there is one group, and two rows of ranks to search for
    same = lambda a: [a[k].eqNullSafe(F.col(g)) for k, g in renamed.items()] or [F.lit(True)]
    few = sizes.where(F.col("_n") <= GATHERED).select(*[F.col(k).alias(g) for k, g in renamed.items()])
    small = rows.join(few, same(rows), "left_semi").groupBy(*keys).agg(F.percentile(x, F.lit(q)).alias(name)) if keys else None
    large = sizes.where(F.col("_n") > GATHERED).withColumn("_at", (F.col("_n") - 1) * q)
    # one search for the rank at or below q, one for the next
    wanted = large.select(*[F.col(k).alias(g) for k, g in renamed.items()], F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"), "_at").distinct()
    searched = [*renamed.values(), "_rank"]
    left = rows.where(F.col(x).isNotNull()).join(wanted, same(rows)).select(*searched, F.col("_rank").alias("_skip"), F.col(x).cast("double").alias("_x"))
    found = None
    while True:
        left = kept(left)
        edges = left.groupBy(*searched).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_m"), F.first("_skip").alias("_skip"))
        done = edges.where("_lo = _hi").select(*searched, F.col("_lo").alias("_v"))
        found = done if found is None else found.unionByName(done)
        open_ = kept(edges.where("_lo < _hi"))
        ready = open_.where(F.col("_m") <= GATHERED)
        rank = F.row_number().over(Window.partitionBy(*searched).orderBy("_x")) - 1
        null_safe = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
        sorted_ = left.join(ready.select(*searched), null_safe(left, ready, searched), "left_semi").withColumn("_k", rank).where("_k = _skip")
        found = kept(found.unionByName(sorted_.select(*searched, F.col("_x").alias("_v"))))
        more = open_.where(F.col("_m") > GATHERED)
        if more.isEmpty():
            break
        more = more.select(*[F.col(c).alias(f"{c}_") for c in searched], "_lo", "_hi")
        cells = left.join(more, [left[c].eqNullSafe(F.col(f"{c}_")) for c in searched])
        # halves first, so that a difference beyond the largest double doesn't overflow; all that rounds up belongs to the last range
        share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        cells = kept(cells.select(*searched, "_skip", "_x", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("_c")))
        counted = cells.groupBy(*searched, "_c").agg(F.count("*").alias("_m"), F.first("_skip").alias("_s"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy(*searched).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counted.withColumn("_before", before).where("_before <= _s and _s < _before + _m").select(*[F.col(c).alias(f"{c}_") for c in (*searched, "_c")], "_before")
        left = cells.join(hit, [cells[c].eqNullSafe(F.col(f"{c}_")) for c in (*searched, "_c")]).select(*searched, (F.col("_skip") - F.col("_before")).alias("_skip"), "_x")
    ends = wanted.withColumnsRenamed({c: f"{c}_" for c in (*renamed.values(), "_rank")})
    met = found.join(ends, [found[c].eqNullSafe(F.col(f"{c}_")) for c in searched])
    lower, upper = F.max(F.when(F.col("_rank") == F.floor("_at"), F.col("_v"))), F.max(F.when(F.col("_rank") == F.ceil("_at"), F.col("_v")))
    big = met.groupBy(*renamed.values()).agg((lower + (upper - lower) * (F.max("_at") - F.floor(F.max("_at")))).alias(name)).withColumnsRenamed({g: k for k, g in renamed.items()})
    return big if small is None else small.unionByName(big)


def with_grouped_quantile(rows: DataFrame, keys: list[str], x: str, q: float, name: str) -> DataFrame:
    """rows with name, the quantile of their group; rows of a frequent group aren't gathered, as the groups are joined to them."""
    found = grouped_quantile(rows, keys, x, q, name)
    found = found.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)})
    on = [rows[k].eqNullSafe(found[f"_j{i}"]) for i, k in enumerate(keys)]
    return rows.join(found, on, "left").drop(*[f"_j{i}" for i in range(len(keys))])
