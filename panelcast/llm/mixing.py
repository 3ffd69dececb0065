"""Mixing sources to target weights over fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import carried, cut, text_batches, unfolded, word_bounds, word_count

#: Targets are kept on the driver, one row for each source; more sources than this are refused.
MAX_SOURCES = 100_000
#: Rows of a source that one window sums up, and how many of these groups the next.
GROUP_ROWS, PART_GROUPS = 1000, 1000
#: Blocks that a source is cut into at least, so that whole blocks come near its target.
LEAST_BLOCKS = 200


def source_targets(sizes: dict[str | None, int], weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source. Sources by code point, null last, have weights in turn.

    They divide share times all words by weight; a target stops at cap times its source's size, and
    what is cut is divided again by weight among the rest until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of range(n) at the indices x: a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            z = right + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 + 1) % (1 << 64))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def log_factorial_step(a: int, b: int) -> float:
    """ln a! - ln b!, by Stirling's series where both are large, so that the digits of the difference stay."""
    if min(a, b) < 10_000:
        return lgamma(a + 1) - lgamma(b + 1)
    return (a - b) * log(b) + (a + 0.5) * log1p((a - b) / b) - (a - b) + (1 / a - 1 / b) / 12


def hypergeometric(good: int, bad: int, need: int, rng: np.random.Generator) -> int:
    """How many of need slots are good, of good and bad ones in all; numpy's own ends at 1e9.

    Rejection from a flat top with exponential tails around the mode, which lies over every log-concave
    distribution, so one sampler serves all sizes.
    """
    low, high = max(0, need - bad), min(good, need)
    if low == high:
        return low
    mode = min(max((need + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    top = 0.9 * min(1.0, exp(min(0.0, choose(good, mode) + choose(bad, need - mode) - choose(good + bad, need))))
    half = 1 + top / 2
    while True:
        u, w = rng.random(), 1 - rng.random()
        y = rng.random() * half / top if u <= half / (1 + half) else (half + rng.exponential()) / top
        k = mode + round(y) * (1 if rng.random() < 0.5 else -1)
        if low <= k <= high:
            ratio = -(log_factorial_step(k, mode) + log_factorial_step(good - k, good - mode) + log_factorial_step(need - k, need - mode) + log_factorial_step(bad - need + k, bad - need + mode))
            if log(w) + min(0.0, half - top * y) <= ratio:
                return k


def split_counts(counts: np.ndarray, first: int, rng: np.random.Generator) -> np.ndarray:
    """How many of the first slots go to each source if counts in all do: a multinomial given its totals."""
    out, rest, need = np.zeros_like(counts), int(counts.sum()), first
    for i, n in enumerate(map(int, counts)):
        rest -= n
        out[i] = hypergeometric(n, rest, need, rng)
        need -= out[i]
    return out


def shard_counts(counts: np.ndarray, shard: int, shards: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Source counts of an output shard and of those before it, by halving the range of shards.

    Any shard finds its own in log2(shards) draws that depend on the seed alone, so a lost task can
    draw again; all shards together take exactly counts.
    """
    total, before, low, high = int(counts.sum()), np.zeros_like(counts), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = split_counts(counts, min(total, middle * slots) - low * slots, np.random.default_rng([seed, low, high]))
        if shard < middle:
            counts, high = left, middle
        else:
            before, counts, low = before + left, counts - left, middle
    return counts, before


@dataclass
class Mix:
    """rows: doc_id, source, size, source_size, target, text_hash, and start, the row's place in its source.
    placed: shard, slot, source, pass, block, doc_id, text_hash, start, and words s to e of the document."""

    rows: DataFrame
    placed: DataFrame


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 128, shard_slots: int = 1024, seed: int = 7) -> Mix:
    """Draw each source's blocks of words until its target is met.

    A source's documents, in hashed order, are one run of words cut into blocks of one length (block, or less for a
    source of fewer than LEAST_BLOCKS of these). Each output shard draws
    how many slots go to each source; a source's n-th slot takes the block that a pseudorandom
    permutation puts n-th, a new permutation for every pass over the source. Blocks and slots meet in a
    join on source and block. No pass repeats a block, so no document is taken more often than cap
    allows. Null and blank texts have size 0 and are never placed; a null source is a source of its
    own; repeated rows are placed one by one. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: int(r["words"]) for r in totals}
    targets = source_targets(sizes, weights, share, cap)
    names = list(targets)
    block_of = {s: max(1, min(block, sizes[s] // LEAST_BLOCKS)) for s in names}
    blocks = np.array([-(-sizes[s] // block_of[s]) for s in names], np.int64)
    slots = np.array([round(targets[s] / sizes[s] * b) if b else 0 for s, b in zip(names, blocks, strict=True)], np.int64)
    known = spark.createDataFrame([(i, s, sizes[s], float(targets[s]), block_of[s]) for i, s in enumerate(names)], "source_no int, source string, source_size long, target double, _block long")

    groups = max(1, sum(int(r["rows"]) for r in totals) // GROUP_ROWS)
    spread = F.xxhash64("doc_id", "text_hash")
    rows = sized.join(F.broadcast(known.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumns({"_spread": spread, "_group": F.pmod(spread, F.lit(groups))})
    before = rows.groupBy("source_no", "_group").agg(F.sum("size").alias("words")).withColumn("_part", F.floor(F.col("_group") / PART_GROUPS))
    parts = before.groupBy("source_no", "_part").agg(F.sum("words").alias("_all"))
    parts = parts.select("source_no", "_part", (F.sum("_all").over(Window.partitionBy("source_no").orderBy("_part")) - F.col("_all")).alias("_base"))
    within = F.sum("words").over(Window.partitionBy("source_no", "_part").orderBy("_group")) - F.col("words")
    before = before.withColumn("_within", within).join(parts, ["source_no", "_part"]).select("source_no", "_group", (F.col("_base") + F.col("_within")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source_no", "_group").orderBy("_spread", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = cut(rows.withColumn("_inside", inside).join(before, ["source_no", "_group"]).withColumn("start", F.col("base") + F.col("_inside")).drop("_spread", "_group", "_inside", "base"))

    total = int(slots.sum())
    shards = max(1, -(-total // shard_slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"] if total else []:
                counts, taken = shard_counts(slots, int(shard), shards, shard_slots, seed)
                source = np.repeat(np.arange(len(counts)), counts)
                nth = np.concatenate([np.arange(a, a + c) for a, c in zip(taken, counts, strict=True)])
                found = np.zeros(len(nth), np.int64)
                turn = nth // np.maximum(blocks[source], 1)
                for s, p in {*zip(source.tolist(), turn.tolist(), strict=True)}:
                    own = (source == s) & (turn == p)
                    found[own] = permute(nth[own] % blocks[s], int(blocks[s]), seed + 1_000_003 * s + p)
                order = np.random.default_rng([seed, 1, int(shard)]).permutation(len(nth))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(nth)), "source_no": source[order], "pass": turn[order], "block": found[order]})

    parts = max(1, min(shards, -(-shards // 8)))
    drawn = spark.range(0, shards, 1, parts).mapInPandas(draw, "shard long, slot int, source_no int, pass int, block long")
    pieces = rows.where("size > 0").select("source_no", "source", "doc_id", "text_hash", "start", "size", "_block", F.explode(F.expr("sequence(start div _block, (start + size - 1) div _block)")).alias("block"))
    pieces = pieces.withColumns({"s": F.greatest(F.col("start"), F.col("block") * F.col("_block")) - F.col("start"), "e": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("_block")) - F.col("start")}).drop("size", "_block")
    # Spark estimates drawn by its shards, not by their slots, and would broadcast it whatever its size
    return Mix(rows, drawn.join(pieces.hint("merge"), ["source_no", "block"]))


def mix_report(docs: DataFrame, **settings: object) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs; see mix_sources."""
    mix = mix_sources(docs, **settings)
    taken = mix.placed.groupBy("source_no", "start", "doc_id").agg(F.sum(F.col("e") - F.col("s")).alias("taken"))
    rows, same = mix.rows, ["source_no", "start"]
    filled = rows.where("size > 0").join(taken.drop("doc_id"), same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return filled.unionByName(rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **settings: object) -> DataFrame:
    """docs as mixed: a row for each document and pass that takes words of it, text being those words, n_chars their length.

    Words that follow each other keep what stands between them, line ends too; a line end joins the rest. A row is told
    by doc_id and its text. Null and blank texts are never taken; repeated rows are taken one by one; columns of any
    name are kept; an empty table gives no rows.
    """
    mix = mix_sources(docs, **settings)
    spans = mix.placed.groupBy("doc_id", "text_hash", "start", "pass").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    @F.pandas_udf("string")
    def taken(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([pieces(text, spans) for text, spans in zip(texts, lists, strict=True)], dtype=object)

    keyed = carried(text_batches(docs), F.xxhash64("text").alias("text_hash"))
    if mix.rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", "text_hash"])  # each repeated row has spans of its own
    spans = spans.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    out = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["_id"]) & (keyed["text_hash"] == spans["_hash"]))
    return unfolded(out.withColumn("text", taken("text", "spans")), docs.columns)


def pieces(text: str, spans: list) -> str:
    """Words s to e of each span, in order; spans that meet are one stretch of the text."""
    data = text.encode("utf-8", "surrogatepass")
    begins, ends = word_bounds(data)
    whole: list[list[int]] = []
    for s, e in sorted((int(x["s"]), int(x["e"])) for x in spans):
        if whole and whole[-1][1] == s:
            whole[-1][1] = e
        else:
            whole.append([s, e])
    return b"\n".join(data[begins[s] : ends[e - 1]] for s, e in whole).decode("utf-8", "replace")
