"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import attach, carried, connected_components, cut, fetch, text_batches
from panelcast.llm.links import verified_components
from panelcast.llm.substring import _BASE, _mix, _sketches

BITS = 64
SEED = 42
#: Keys of covering tables that one task makes.
KEYS_A_TASK = 1 << 19


def features(text: str | None, kind: str, size: int) -> list[bytes]:
    """ASCII-lower-cased words as shingles with repeats (kind shingles) or as a set of words (kind words).

    A text shorter than a shingle is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if kind == "words":
        return list(set(words))
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def fingerprint(parts: list[bytes]) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the parts' XXH64. No parts: 0."""
    if not parts:
        return 0
    ones, step = np.zeros(BITS, np.int64), 1 << 16  # a long text goes through in blocks
    for i in range(0, len(parts), step):
        digests = b"".join([xxhash.xxh64_digest(p, SEED) for p in parts[i : i + step]])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(parts)).tobytes(), "big", signed=True)


def fingerprint_column(text: str, kind: str = "shingles", size: int = 3):
    """Column of signed 64-bit fingerprints of a text column."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(features(t, kind, size)) for t in texts], dtype="int64")

    return run(F.col(text))


def sketch(text: str | None, size: int) -> np.ndarray:
    """MinHash band keys of a text's shingles, of which a text shorter than a shingle has one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(size, len(hashes))
    rolled = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        rolled = rolled * _BASE + hashes[k : len(hashes) - n + 1 + k]
    return _sketches((_mix(rolled) >> np.uint64(32)).astype(np.uint32), np.zeros(len(rolled), np.int64), 1)[0].view(np.int64)


def sketch_column(text: str, size: int):
    """Column of the band keys of a text column, an array of longs."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sketch(t, size) for t in texts], dtype=object)

    return run(F.col(text))


def hex_column(fingerprint: str):
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def covering_masks(radius: int, bits: int = BITS, seed: int = 1) -> list[int]:
    """2^(radius+1)-1 signed masks; any two words that differ in radius bits or fewer agree under one.

    Each bit gets a non-zero vector of radius+1 bits, dealt evenly; mask v keeps the bits whose vector
    has odd product with v. Radius vectors can't span the space, so some v is orthogonal to all
    differing bits, and mask v keeps none of them.
    """
    n = (1 << (radius + 1)) - 1
    vectors = np.random.default_rng(seed).permutation(np.resize(np.arange(1, n + 1), max(bits, n)))[:bits]
    masks = [sum(1 << i for i, x in enumerate(vectors) if bin(int(x) & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def covering_keys(nodes: DataFrame, radius: int, *keep: str) -> DataFrame:
    """One row for each node and table: table, key and the columns of keep."""
    masks = covering_masks(radius)
    return nodes.select(*keep, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))


def distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_edges(fps: DataFrame, radius: int, bucket: int = 16) -> DataFrame:
    """Edges a, b whose components are those of all pairs of distinct fp that differ in 2 bits or fewer.

    Buckets of the covering tables up to bucket members compare their pairs. Members of a larger one
    meet at midpoints instead: two words differ in 2 bits or fewer just if they share a word at 1 bit
    or fewer from each, and each word has 65 of those, so no dense group emits its pairs.
    """
    if radius != 2:
        raise ValueError("midpoints at one bit serve a radius of 2 only")
    keyed = cut(covering_keys(fps.select("fp"), radius, "fp"))
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = cut(keyed.join(sizes, ["table", "key"]))
    few = met.where(F.col("size") <= bucket)
    pairs = (
        few.select("table", "key", F.col("fp").alias("a"))
        .join(few.select("table", "key", F.col("fp").alias("b")), ["table", "key"])
        .where((F.col("a") < F.col("b")) & (distance("a", "b") <= radius))
        .select("a", "b")
    )
    many = met.where(F.col("size") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS)])
    ball = many.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    hubs = ball.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top")
    return pairs.unionByName(ball.join(hubs, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))).distinct()


def simhash_components(docs: DataFrame, kind: str = "shingles", size: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row of docs.

    component_id is the smallest doc_id among the rows reachable over links of radius bits or fewer.
    Null, empty and blank texts have fingerprint 0, linked like any other. Repeated rows are equal
    members; null ids belong to components but name none (a component of null ids only has a null
    component_id). Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(text_batches(docs).select(F.col(doc_id).alias("doc_id"), fingerprint_column(text, kind, size).alias("fp")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    parts = connected_components(fingerprint_edges(nodes, radius))
    rooted = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted)
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps"))
    grouped = lowest.where("fps > 1").select("root", "component_id")
    table = rooted.join(grouped, "root", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = attach(rows, table, "fp", total, F.xxhash64("doc_id"))
    return out.select("doc_id", hex_column("fp").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, radius: int = 6, size: int = 5, least: float = 0.8) -> DataFrame:
    """Rows to drop so that one document of each near-duplicate group stays: doc_id, text_hash.

    Fingerprints of word sets within radius bits are candidates (covering tables), and so are texts that
    share a MinHash band of their size-word shingles, which block edits lose no more than others; the
    Jaccard similarity of the whole texts' shingles decides (least or more), and groups are components. The document with the smallest doc_id stays. A row is given by doc_id and the XXH64
    of its text (null: empty); null ids sort first. Exact copies are one class, so they make no
    pairs. Repeated rows share a key.
    """
    rows = cut(keyed_rows(text_batches(docs)).select("doc_id", "text_hash", F.when(F.col("doc_id").isNull(), 0).otherwise(1).alias("has_id"), fingerprint_column("text", "words").alias("fp"), sketch_column("text", size).alias("bands")))
    nodes = cut(rows.groupBy("text_hash").agg(F.min(F.struct("has_id", "doc_id")).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    tables = (1 << (radius + 1)) - 1
    named = cut(nodes.groupBy("fp").agg(F.max(F.struct("n", "text_hash"))["text_hash"].alias("node"), F.count("*").alias("nodes")))
    dealt = named.select("fp", "node", (F.col("nodes") > 1).alias("crowd")).repartition(1 + named.count() * tables // KEYS_A_TASK)
    keyed = covering_keys(dealt, radius, "node", "crowd", "fp").select("node", "crowd", F.xxhash64("table", "key").alias("bucket"))
    keyed = keyed.unionByName(nodes.select(F.col("text_hash").alias("node"), F.lit(False).alias("crowd"), F.explode("bands").alias("bucket")))
    inner = cut(nodes.join(named.where("nodes > 1"), "fp").where("text_hash <> node").select("node", F.col("text_hash").alias("member")))

    def near(pairs: DataFrame) -> DataFrame:
        fps = nodes.select(F.col("text_hash").alias("node"), "fp", "bands")
        both = pairs.join(fps.withColumnsRenamed({"node": "a", "fp": "fp_a", "bands": "bands_a"}), "a").join(fps.withColumnsRenamed({"node": "b", "fp": "fp_b", "bands": "bands_b"}), "b")
        return both.where((distance("fp_a", "fp_b") <= radius) | F.arrays_overlap("bands_a", "bands_b")).select("a", "b")

    def texts_of(wanted: DataFrame) -> DataFrame:
        named = cut(wanted.withColumnRenamed("node", "text_hash").join(nodes, "text_hash").select("text_hash", F.col("first.doc_id").alias("doc_id")))
        return fetch(keyed_rows(docs), named, ["text_hash", "doc_id"]).select(F.col("text_hash").alias("node"), "text").dropDuplicates(["node"])

    parts = verified_components(keyed, near, texts_of, size, least, inner)
    rooted = nodes.join(parts, nodes["text_hash"] == parts["node"], "left").select("text_hash", "first", F.coalesce("component", "text_hash").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min(F.struct("first", "text_hash")).alias("kept")).select("kept.text_hash", "kept.first.doc_id"))
    return cut(rows.select("doc_id", "text_hash").distinct().join(kept.select("text_hash", "doc_id", F.lit(True).alias("stays")), (kept["text_hash"] == rows["text_hash"]) & kept["doc_id"].eqNullSafe(rows["doc_id"]), "left").where("stays is null").select(rows["doc_id"], rows["text_hash"]))


def drop_near_duplicates(docs: DataFrame, **settings: object) -> DataFrame:
    """docs less the rows that near_duplicates names; of repeated rows one stays.

    A null text is an empty one, and all of these are one group. A null id is the smallest. Columns of any name are
    kept as they are; an empty table gives no rows.
    """
    doomed = near_duplicates(docs, **settings)
    keyed = carried(docs, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    out = fetch(keyed, doomed, ["doc_id", "text_hash"], how="left_anti")
    repeated = cut(keyed.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"))
    if repeated.limit(1).count():
        once = fetch(out, repeated, ["doc_id", "text_hash"], how="left_anti")
        out = once.unionByName(fetch(out, repeated, ["doc_id", "text_hash"], how="left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in docs.columns])


def keyed_rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_hash", F.xxhash64("text"))
