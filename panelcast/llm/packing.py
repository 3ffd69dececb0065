"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut, word_count

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: A sequence costs its capacity and this much more, so that fewer, longer ones pay off.
OVERHEAD = 32


def pack(lengths: list[int], capacities: tuple = CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int, int, int]]:
    """bin, capacity, used, offset of each length, none above the largest capacity.

    Longest first, an item goes to the open bin that it fills best. Where none has room, the permitted
    capacity with the least cost a word opens, each tried with the longest remaining items that fit.
    In the end every bin shrinks to the least capacity that holds its contents.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [-lengths[i] for i in order]  # ascending
    sums = list(accumulate((lengths[i] for i in order), initial=0))
    room: list[tuple[int, int]] = []  # what is free in each open bin
    bins: list[list[int]] = []
    place: dict[int, tuple[int, int]] = {}
    for at, i in enumerate(order):
        n = lengths[i]
        j = bisect_left(room, (n, -1))
        if j < len(room):
            free, b = room.pop(j)
        else:
            best = None
            for c in (c for c in capacities if c >= n):
                left, k, used = c - n, at + 1, n
                while left:  # each turn takes all items in a row that fit and leaves less than half of what was free
                    k = bisect_left(falling, -left, k)
                    if k >= len(falling) or falling[k] == 0:
                        break
                    end = bisect_right(sums, sums[k] + left, k) - 1
                    taken = sums[end] - sums[k]
                    left, used, k = left - taken, used + taken, end
                if best is None or (c + overhead) / max(used, 1) < best[0]:
                    best = ((c + overhead) / max(used, 1), c)
            free, b = best[1], len(bins)
            bins.append([0])
        place[i] = (b, bins[b][0])
        bins[b][0] += n
        if free > n:
            insort(room, (free - n, b))
    fit = [min(c for c in capacities if c >= used) for (used,) in bins]
    return [(place[i][0], fit[place[i][0]], bins[place[i][0]][0], place[i][1]) for i in range(len(lengths))]


def pack_documents(docs: DataFrame, capacities: tuple = CAPACITIES, overhead: int = OVERHEAD, shard_rows: int = 4000) -> DataFrame:
    """doc_id, text_hash, copy, piece, start, length, bin, capacity, used, offset: each row's words in sequences.

    A row is told by doc_id, the XXH64 of its text and, among equal rows, copy, so a piece is words start to
    start + length of just one row.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest. Rows are
    dealt by hash into shards of about shard_rows pieces, each packed by itself; bin is unique over all
    shards. Repeated rows are told apart by copy and dealt apart. A null or blank text has one piece of
    length 0, with null bin, capacity and used. Other columns are ignored; an empty table gives no rows.
    """
    largest = max(capacities)
    rows = docs.groupBy("doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("words")).agg(F.count("*").alias("copies"))
    rows = rows.select("doc_id", "text_hash", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / largest) - 1, F.lit(0)).cast("long"))
    pieces = rows.select("doc_id", "text_hash", "copy", "words", F.explode(cuts).alias("piece"))
    pieces = cut(pieces.select("doc_id", "text_hash", "copy", "piece", (F.col("piece") * largest).alias("start"), F.least(F.lit(largest), F.col("words") - F.col("piece") * largest).alias("length")))
    full = pieces.where("length > 0")
    shards = max(1, full.count() // shard_rows)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text_hash", "copy", "piece"], na_position="first", ignore_index=True)
        found = pack(part["length"].tolist(), capacities, overhead)
        for i, name in enumerate(("bin", "capacity", "used", "offset")):
            part[name] = [x[i] for x in found]
        part["bin"] += int(key[0]) * (1 << 24)
        return part[["doc_id", "text_hash", "copy", "piece", "start", "length", "bin", "capacity", "used", "offset"]]

    schema = f"doc_id {dict(pieces.dtypes)['doc_id']}, text_hash long, copy long, piece long, start long, length long, bin long, capacity long, used long, offset long"
    dealt = full.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", "piece"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(run, schema)
    blank = pieces.where("length = 0").select("doc_id", "text_hash", "copy", "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("bin", "capacity", "used")], F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(blank)


def sequences(docs: DataFrame, **settings: object) -> DataFrame:
    """bin, capacity, used, doc_ids, text_hashes, copies, starts, lengths: a row for each sequence, its pieces in order.

    doc_id, text_hash and copy tell the row of docs that a piece is from. Null and blank texts are in no sequence;
    repeated rows are packed one by one; other columns are ignored; an empty table gives no rows.
    """
    pieces = pack_documents(docs, **settings).where("bin is not null")
    rows = pieces.groupBy("bin", "capacity", "used").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "text_hash", "copy", "start", "length"))).alias("parts"))
    names = {"doc_id": "doc_ids", "text_hash": "text_hashes", "copy": "copies", "start": "starts", "length": "lengths"}
    return rows.select("bin", "capacity", "used", *[F.col(f"parts.{a}").alias(b) for a, b in names.items()])
