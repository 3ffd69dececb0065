"""Helpers shared by the corpus operators: words, scratch tables, components, hot-key joins."""

from __future__ import annotations

import gc
import uuid

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sources.sinks import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: At most this many keys can each hold a thousandth of all rows, so their table has a proven bound.
HOT_SHARE = 1000


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of UTF-8 text."""
    x = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], (x == 32) | ((x >= 9) & (x <= 13)), [True]])
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return turns[::2], turns[1::2]


def carried(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text, more, and the other columns of docs as the struct _row, so that no name of docs meets one of ours."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # a struct needs a field; its name is none of docs
    none = "_" + max(others, key=len, default="none")
    return docs.select("doc_id", "text", *more, F.struct(*others, F.lit(0).alias(none)).alias("_row"))


def unfolded(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of docs again, from what carried gave; n_chars is the text's length."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return df.select(*[own[c].alias(c) if c in own else F.col("_row")[c].alias(c) for c in columns])


def word_count(text: Column) -> Column:
    """Number of words as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of an Arrow batch where whole texts go to Python workers; Spark's own 10,000 long texts fill their memory.
TEXTS_A_BATCH = 500


def text_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold TEXTS_A_BATCH rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if not 0 < now <= TEXTS_A_BATCH:
        df.sparkSession.conf.set(name, str(TEXTS_A_BATCH))
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; see sinks.shared_folder."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, in the shared folder.

    Spark deletes them with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set, else they stay
    until the folder is cleared.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of frames that are gone; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Parquet tables in the shared folder for wide intermediate results; deleted on exit."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete("")
        tidy(self.spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Edges (two longs each) that one task of a round reads at least, whatever the session's number of partitions.
EDGES_A_TASK = 1 << 16


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Columns a, b -> node, component, its smallest node. Self-loops are ignored.

    Alternates large-star and small-star steps on an edge table until it is a set of stars; each
    round joins every node with one minimum, and the edges of a node that has many are spread over tasks, so no
    neighbourhood is gathered anywhere. Rounds never add edges, so the first count says how many tasks they need.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(e)
    tasks = 1 + before[0] // EDGES_A_TASK
    for i in range(max_rounds):
        if i % 4 == 3:
            tidy(edges.sparkSession)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = attach(both, low, "u", 2 * before[0], F.xxhash64("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attach(large, low, "u", 2 * before[0], F.xxhash64("v")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").coalesce(tasks).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Bits of the filter that stands for a table too large to broadcast: 8 MB whatever the table's size.
FILTER_BITS = 1 << 26


def maybe_in(rows: DataFrame, wanted: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows that may have a partner in wanted by the columns on, and rows that have none.

    The hashed keys of wanted set bits of a bitmap, whose at most 2,048 pieces are broadcast; what
    finds its bit unset has no partner and needs no shuffle.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    pieces = wanted.select(place.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bits"))
    # a piece's 4,096 bytes as 512 longs, of which a row reads one
    word = lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    pieces = pieces.select("_piece", F.transform(F.sequence(F.lit(0), F.lit(511)), word).alias("_words"))
    at = F.bitmap_bit_position(place)
    bit = F.lit(56) - at.bitwiseAND(F.lit(56)) + at.bitwiseAND(F.lit(7))  # the first byte is a long's highest
    tested = rows.withColumn("_piece", F.bitmap_bucket_number(place)).join(F.broadcast(cut(pieces)), "_piece", "left")
    tested = tested.withColumn("_may", F.coalesce(F.getbit(F.get("_words", F.shiftright(at, 6).cast("int")), bit.cast("int")) == 1, F.lit(False)))
    return tuple(tested.where(x).select(*rows.columns) for x in (F.col("_may"), ~F.col("_may")))


#: Bytes of a table, written as JSON, that is broadcast at most.
BROADCAST_BYTES = 1 << 25


def fetch(rows: DataFrame, wanted: DataFrame, on: list[str], limit: int = 100_000, how: str = "inner") -> DataFrame:
    """rows joined null-safely with wanted (cut before); how is inner, left, left_semi or left_anti.

    wanted is broadcast only if it has limit rows and BROADCAST_BYTES at most. Else both are shuffled, but of rows
    only what may have a partner; for outer and anti joins the rest is added after.
    """
    size = wanted.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*wanted.columns)))), F.lit(0))).first()
    few = size[0] <= limit and size[1] <= BROADCAST_BYTES
    rest = None
    if not few:
        rows, rest = maybe_in(rows, wanted, on)
    renamed = wanted.withColumnsRenamed({c: f"_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & rows[c].eqNullSafe(renamed[f"_{c}"])
    out = rows.join(F.broadcast(renamed) if few else renamed, same, how).drop(*[f"_{c}" for c in on])
    if rest is not None and how in ("left", "left_anti"):
        out = out.unionByName(rest, allowMissingColumns=True)
    return out


def attach(rows: DataFrame, table: DataFrame, key: str, rows_in_all: int, salt: Column) -> DataFrame:
    """Left join of rows with table, unique by key and with n, each key's number of rows.

    Keys that hold a thousandth of all rows or more (at most a thousand of them) are broadcast; the
    rest meets in a shuffle, where rows of broadcast keys are spread over salt instead of their key.
    """
    names = [c for c in table.columns if c not in (key, "n")]
    least = max(100, rows_in_all // HOT_SHARE)
    hot = table.where(F.col("n") >= least).select(F.col(key).alias("_key"), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    cold = table.where(F.col("n") < least).select(F.lit(False).alias("_hot"), F.col(key).alias("_salted"), *[F.col(c).alias(f"_cold_{c}") for c in names])
    out = rows.join(F.broadcast(hot), rows[key] == F.col("_key"), "left").drop("_key")
    out = out.withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    out = out.withColumn("_salted", F.when(F.col("_hot"), salt.cast(dict(table.dtypes)[key])).otherwise(F.col(key)))
    out = out.join(cold, ["_hot", "_salted"], "left")
    return out.select(*[rows[c] for c in rows.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in names])


def spread_join(rows: DataFrame, table: DataFrame, key: str, salt: Column) -> DataFrame:
    """Inner join of rows with table, unique by key, where frequent keys don't gather their rows in a task."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    known = cut(table.join(counts, key).withColumn("_met", F.lit(True)))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return attach(rows, known, key, total, salt).where("_met").drop("_met")
