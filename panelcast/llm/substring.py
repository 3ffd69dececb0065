"""Repeated passages: paragraph MinHash banding, exact verification, winnowed runs, removal by component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import HOT_SHARE, Scratch, attach, carried, connected_components, cut, fetch, maybe_in, text_batches, tidy, unfolded
from panelcast.llm.links import verified_components

#: Words a paragraph needs to count as a passage; those of a line whose inner runs count too, and of a run over line ends.
LEAST_WORDS, LONG_WORDS = 20, 50
#: 12 bands of 5 rows: a pair of similarity 0.8 collides with probability 0.992, one of 0.9 with 0.99998.
BANDS, ROWS, SHINGLE, LEAST = 12, 5, 5, 0.8
BLOCK = 1 << 13
#: Words of an anchor.
ANCHOR = 10
#: What stands for a paragraph's number in the row of a text's anchors and in the row of a text of LONG_WORDS or more.
ANCHORS, TEXT = -1, -2

_UNITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("paragraph", pa.int32()), ("h", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("keys", pa.list_(pa.int64()))])
_UNITS_DDL = "doc_id long, text_hash long, paragraph int, h long, s int, e int, keys array<long>"

_rng = np.random.default_rng(11)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FOLD = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sketches(shingles: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Band keys by owner (a paragraph), from shingle hashes and their owners in order; in blocks, so memory is bounded."""
    low = np.full((owners, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), BLOCK):
        part, own = shingles[i : i + BLOCK], owner[i : i + BLOCK]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        found = np.minimum.reduceat(part[:, None] * _A + _B, starts, axis=0)
        low[own[starts]] = np.minimum(low[own[starts]], found)
    keys = (low.reshape(owners, BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=2, dtype=np.uint64)
    return _mix(keys + _BAND)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row, in log2(width) steps."""
    span = 1
    while 2 * span <= width and len(x) > span:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    rest = width - span
    return np.minimum(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def _grams(hashes: np.ndarray):
    """A function of first words and a size to the hashes of the word runs there."""
    n = len(hashes)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE_INVERSE)])
    prefix = np.r_[np.uint64(0), np.cumsum(hashes * inverse[:-1], dtype=np.uint64)]
    return lambda at, size: _mix((prefix[at + size] - prefix[at]) * power[at] + np.uint64(size))


def _places(hashes: np.ndarray, sizes: np.ndarray, text: np.ndarray, gram) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Windows in which a run is sought: size, first words, and the hashes of the windows' anchors.

    hashes are the words of several texts in a row, sizes those of their lines, text the text of each line. Windows
    are those of LEAST_WORDS words inside a line of LONG_WORDS or more, those of LONG_WORDS words that
    stand in several lines of a text, and those of LONG_WORDS words inside a line. A window's anchor is its ANCHOR words of the
    least hash: it depends on the window's words alone, so texts that share a window share its anchor.
    """
    n = len(hashes)
    pieces = gram(np.arange(max(0, n - ANCHOR + 1)), ANCHOR)
    line = np.repeat(np.arange(len(sizes)), sizes)
    short, long = np.arange(max(0, n - LEAST_WORDS + 1)), np.arange(max(0, n - LONG_WORDS + 1))
    long = long[text[line[long]] == text[line[long + LONG_WORDS - 1]]]
    inside = line[long] == line[long + LONG_WORDS - 1]
    short = short[(line[short] == line[short + LEAST_WORDS - 1]) & (sizes[line[short]] >= LONG_WORDS)]
    best = {size: sliding_min(pieces, size - ANCHOR + 1) for size in (LEAST_WORDS, LONG_WORDS)}
    return [(size, at, best[size][at]) for size, at in ((LEAST_WORDS, short), (LONG_WORDS, long[~inside]), (LONG_WORDS, long[inside]))]


def _anchors(hashes: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and their windows' anchors, each once and in order, and whether a window over line ends has it.

    A window of LONG_WORDS inside a line has the anchor of a shorter one in it, so the first two kinds have all.
    """
    owner, found = np.repeat(text, sizes), []
    for kind, (_, at, best) in enumerate(_places(hashes, sizes, text, _grams(hashes))[:2]):
        own = owner[at]
        new = np.r_[True, (best[1:] != best[:-1]) | (own[1:] != own[:-1])][: len(at)]  # neighbours mostly are equal
        found.append((own[new], best[new], np.full(int(new.sum()), kind)))
    own, best, across = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((-across, best, own))
    own, best, across = own[order], best[order], across[order]
    new = np.r_[True, (best[1:] != best[:-1]) | (own[1:] != own[:-1])][: len(own)]
    return own[new], best[new], across[new]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _lines(text: str) -> list[list[bytes]]:
    return [line.split() for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _flat(texts: list[list[list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts in a row, sizes of their lines, and the text of each line."""
    sizes = np.array([len(w) for lines in texts for w in lines], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(lines) for lines in texts])
    return _hashes([w for lines in texts for words in lines for w in words]), sizes, text


def units(*given: str):
    """Of texts: paragraphs (index, hash, first word, end, band keys, text), texts and their windows' anchors with their kind, and numbers of words."""
    texts = [_lines(t) for t in given]
    hashes, sizes, text = _flat(texts)
    ends = np.cumsum(sizes)
    length = np.bincount(text, sizes, len(texts)).astype(np.int64)
    start = np.cumsum(length) - length
    line = np.arange(len(sizes)) - np.searchsorted(text, text)
    anchors = _anchors(hashes, sizes, text)
    chosen = np.flatnonzero(sizes >= LEAST_WORDS)
    own, first, last = text[chosen], ends[chosen] - sizes[chosen], ends[chosen]
    whole = np.array([xxhash.xxh64_intdigest(b" ".join(texts[i][j])) for i, j in zip(own, line[chosen], strict=True)], np.uint64)
    rolled = hashes[: max(0, len(hashes) - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        rolled = rolled * _BASE + hashes[k : len(rolled) + k]
    counts = sizes[chosen] - SHINGLE + 1
    owner = np.repeat(np.arange(len(chosen)), counts)
    at = np.arange(len(owner)) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    bands = _sketches((_mix(rolled[at]) >> np.uint64(32)).astype(np.uint32), owner, len(chosen))
    return (line[chosen], whole, first - start[own], last - start[own], bands, own), anchors, length


#: Characters of the texts that are worked on at once, unless one has more.
TEXT_AT_ONCE = 1 << 18


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts, but empty ones, that together have TEXT_AT_ONCE characters, or the one text more that reaches them."""
    at, n = [], 0
    for i, text in enumerate(texts):
        if text:
            at.append(i)
            n += len(text)
            if n >= TEXT_AT_ONCE:
                yield at
                at, n = [], 0
    if at:
        yield at


def unit_table(docs: DataFrame) -> DataFrame:
    """Paragraphs with their band keys; a row for a text's anchors, the first s of which a window over line ends has; a row for a text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch["doc_id"], batch["text_hash"].to_numpy(zero_copy_only=False)
            texts = batch["text"].to_pylist()
            for at in _groups(texts):
                (paragraph, whole, first, last, bands, own), (holder, anchors, across), length = units(*[texts[i] for i in at])
                long = np.flatnonzero(length >= LONG_WORDS)
                order = np.lexsort((-across, holder))
                holders, several = np.unique(holder, return_counts=True)
                n, m, k = len(own), len(holders), len(long)
                position = np.array(at)[np.r_[own, holders, long]]
                columns = [np.r_[paragraph, np.full(m, ANCHORS), np.full(k, TEXT)], np.r_[whole, np.zeros(m + k, np.uint64)].view(np.int64), np.r_[first, np.bincount(holder, across, len(at))[holders], np.zeros(k, np.int64)], np.r_[last, np.zeros(m, np.int64), length[long]]]
                ends = np.cumsum(np.r_[0, np.full(n, BANDS), several, np.zeros(k, np.int64)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.r_[bands.ravel(), anchors[order]].view(np.int64)))
                columns = [pa.array(x.astype(kind)) for x, kind in zip(columns, (np.int32, np.int64, np.int32, np.int32), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(position)), pa.array(hashes[position]), *columns, lists], schema=_UNITS)

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, _UNITS_DDL)


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Word spans that repeat an earlier document's or paragraph's: doc_id, text_hash, s, e, kept_id.

    A row is given by doc_id and the XXH64 of its text. The first paragraph of a component, and the
    smallest document of a repeated run, keep the words; kept_id names that document. Documents with a
    null id take part by their paragraphs only.
    """
    every = scratch.table(unit_table(docs), "units")
    doubled = repeated_paragraphs(docs, every, scratch)
    scratch.delete("classes")
    tidy(docs.sparkSession)
    return cut(doubled.unionByName(repeated_runs(docs, every, scratch)))


def repeated_paragraphs(docs: DataFrame, every: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, s, e, kept_id: the paragraphs of a component but its first, computed."""
    paragraphs = every.where("paragraph >= 0")
    place = F.struct("doc_id", "text_hash", "s", "e")
    classes = scratch.table(paragraphs.groupBy(F.col("h").alias("node")).agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first("keys").alias("bands")), "classes")
    keyed = classes.select("node", F.explode("bands").alias("bucket"), F.lit(False).alias("crowd"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = cut(nodes.join(classes, "node").select("node", "place.doc_id", "place.text_hash", "place.s", "place.e"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        found = fetch(rows, wanted, ["doc_id", "text_hash"]).select("node", span_text("text", "s", "e").alias("text"))
        return found.dropDuplicates(["node"])

    parts = verified_components(keyed, lambda pairs: pairs, texts_of, SHINGLE, LEAST)
    rooted = classes.drop("bands").join(parts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    groups = rooted.groupBy("root").agg(F.min("place").alias("kept"), F.sum("n").alias("rows")).where("rows > 1")
    table = cut(rooted.join(groups, "root").select(F.col("node").alias("h"), "n", "kept"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = attach(paragraphs.select("doc_id", "text_hash", "s", "e", "h"), table, "h", total, F.xxhash64("doc_id", "s")).where("kept is not null")
    doubled = members.where(~F.struct("doc_id", "text_hash", "s", "e").eqNullSafe(F.col("kept")))
    return cut(doubled.select("doc_id", "text_hash", "s", "e", F.col("kept.doc_id").alias("kept_id")))


def repeated_runs(docs: DataFrame, every: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, s, e, kept_id: the windows that a text of a smaller doc_id has too, joined where they meet.

    Texts that share an anchor list their windows around it, and equal windows meet, so a run is found
    from its first word to its last. Each text takes part once, by its smallest doc_id; its further
    documents repeat that one from end to end.
    """
    texts = every.where((F.col("paragraph") == TEXT) & F.col("doc_id").isNotNull()).select("doc_id", "text_hash", "s", "e")
    held = cut(texts.groupBy("text_hash").agg(F.min("doc_id").alias("kept_id"), F.max("doc_id").alias("top"), F.count("*").alias("n")))
    holders = held.select("text_hash", F.col("kept_id").alias("doc_id"))
    copied = held.where("kept_id < top").select("text_hash", "kept_id", "n")
    copies = attach(texts, copied, "text_hash", texts.count(), F.xxhash64("doc_id")).where("doc_id <> kept_id").select("doc_id", "text_hash", "s", "e", "kept_id")
    anchors = every.where((F.col("paragraph") == ANCHORS) & F.col("doc_id").isNotNull()).select("text_hash", "s", F.posexplode("keys").alias("at", "h"))
    anchors = anchors.select("text_hash", "h", (F.col("at") < F.col("s")).cast("int").alias("s"))
    shared = cut(anchors.groupBy("h").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"), F.max("s").alias("across"), F.count("*").alias("n")).where("low < high").select("h", "n", "across"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = attach(maybe_in(anchors, shared, ["h"])[0], shared, "h", total, F.xxhash64("text_hash")).where("across is not null")
    wanted = cut(met.groupBy("text_hash").agg(F.collect_set("h").alias("anchors"), F.collect_set(F.when(F.col("across") > 0, F.col("h"))).alias("across")).join(holders, "text_hash"))
    tidy(docs.sparkSession)
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    windows = scratch.table(fetch(rows, wanted, ["doc_id", "text_hash"]).mapInArrow(_windows, _WINDOWS_DDL), "windows")
    tidy(docs.sparkSession)
    often = F.broadcast(cut(shared.where(F.col("n") >= max(100, total // HOT_SHARE)).select(F.col("h").alias("anchor"))))
    again = windows.join(often, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_again, _SPANS_DDL)
    again = again.unionByName(_often_again(windows.join(often, "anchor", "left_semi")))
    own = ["doc_id", "text_hash", "kept_id"]
    return again.repartition("doc_id", "text_hash").sortWithinPartitions(*own, "s").mapInArrow(_met, _SPANS_DDL).unionByName(copies)


def _often_again(windows: DataFrame) -> DataFrame:
    """What _again finds, for anchors so frequent that a task could not hold the windows of one.

    Texts that are alike have equal rows, and these are one run: windows are looked up once for a run, not for each text,
    and a text gets its run's stretches, one for the windows that follow each other with one keeper.
    """
    runs = windows.withColumn("run", F.xxhash64("size", "hashes"))
    alike = cut(runs.groupBy("run").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.count("*").alias("texts"), F.first("hashes").alias("hashes")))
    one = alike.select("run", "low", "top", "texts", F.posexplode("hashes").alias("at", "h"))
    twice = cut(one.groupBy("h").agg(F.min("low").alias("kept_id"), F.max("top").alias("top"), F.count("*").alias("n")).where("kept_id < top").drop("top"))
    total, rows = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], alike.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    known = attach(one.select("run", "at", "h", "top", "texts"), twice, "h", total, F.xxhash64("run", "at")).where("kept_id < top")
    island = F.col("at") - F.row_number().over(Window.partitionBy("run").orderBy("kept_id", "at"))
    stretches = known.withColumn("_island", island).groupBy("run", "kept_id", "_island").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("texts").alias("n"))
    table = cut(stretches.groupBy("run").agg(F.first("n").alias("n"), F.collect_list(F.struct("first", "last", "kept_id")).alias("stretches")))
    again = attach(runs.select("doc_id", "text_hash", "s", "size", "run"), table, "run", rows, F.xxhash64("doc_id", "s"))
    again = again.select("doc_id", "text_hash", "s", "size", F.explode("stretches").alias("x")).where("x.kept_id <> doc_id")
    return again.select("doc_id", "text_hash", (F.col("s") + F.col("x.first")).alias("s"), (F.col("s") + F.col("x.last") + F.col("size")).alias("e"), F.col("x.kept_id").alias("kept_id"))


_WINDOWS_DDL = "doc_id long, text_hash long, anchor long, s int, size int, hashes array<long>"
_SPANS_DDL = "doc_id long, text_hash long, s int, e int, kept_id long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose anchor is one of anchors; those of LONG_WORDS inside a line only where another text may have it over line ends.

    Windows that follow each other with one anchor are a row: the first word of the first, their size, and their hashes.
    """
    for batch in batches:
        ids, hashed = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
        # a text has all its windows' anchors that others have too, so those of the batch's texts serve each of them
        known, wide = (batch[c].flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("anchors", "across"))
        texts = batch["text"].to_pylist()
        for rows in _groups(texts):
            hashes, sizes, text = _flat([_lines(texts[i]) for i in rows])
            gram, anchor, first, length, several, h = _grams(hashes), [], [], [], [], []
            for (size, at, best), wanted in zip(_places(hashes, sizes, text, gram), (known, known, wide), strict=True):
                new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)])
                many = np.diff(np.r_[new, len(at)])
                held = np.isin(best[new], wanted)
                anchor.append(best[new[held]])
                first.append(at[new[held]])
                length.append(np.full(int(held.sum()), size))
                several.append(many[held])
                h.append(gram(at[np.repeat(held, many)], size))
            anchor, first, length, several, h = map(np.concatenate, (anchor, first, length, several, h))
            owner = np.repeat(text, sizes)
            own, start = owner[first], np.searchsorted(owner, np.arange(len(rows)))
            position = np.array(rows)[own]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, several]).astype(np.int32)), pa.array(h.view(np.int64)))
            columns = [pa.array(x) for x in (ids[position], hashed[position], anchor.view(np.int64), (first - start[own]).astype(np.int32), length.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["doc_id", "text_hash", "anchor", "s", "size", "hashes"])


#: Bytes of sorted rows that are worked on at once, unless those of one key are more.
SORTED_AT_ONCE = 1 << 23


def _whole(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in larger batches, so that those of one key are in one batch."""
    held, size, enough = [], 0, SORTED_AT_ONCE
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= enough:
            rows = pa.concat_batches(held)
            other = np.zeros(rows.num_rows, bool)
            for c in key:
                x = rows[c].to_numpy(zero_copy_only=False)
                other |= x != x[-1]
            n = int(other.sum())
            if n:
                yield rows.slice(0, n)
            held = [rows.slice(n)]
            size = held[0].nbytes
            enough = max(SORTED_AT_ONCE, 2 * size)
    if held:
        yield pa.concat_batches(held)


def _spans(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(kind)) for x, kind in zip(columns, (np.int64, np.int64, np.int32, np.int32, np.int64), strict=True)], names=["doc_id", "text_hash", "s", "e", "kept_id"])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows that a smaller doc_id has too, of rows of _windows sorted by anchor: equal windows have one anchor."""
    for rows in _whole(batches, "anchor"):
        ids, hashed, s, size = (rows[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash", "s", "size"))
        h, several = rows["hashes"].flatten().to_numpy(zero_copy_only=False), rows["hashes"].value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(ids)), several)
        at = s[owner] + np.arange(len(h)) - np.repeat(np.cumsum(several) - several, several)
        order = np.argsort(h)
        new = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        kept = np.empty(len(h), np.int64)
        kept[order] = np.repeat(np.minimum.reduceat(ids[owner[order]], new), np.diff(np.r_[new, len(h)]))
        found = np.flatnonzero(kept != ids[owner])
        if not len(found):
            continue
        own, keeper = owner[found], kept[found]
        new = np.r_[True, (found[1:] != found[:-1] + 1) | (own[1:] != own[:-1]) | (keeper[1:] != keeper[:-1])]
        own, keeper = own[new], keeper[new]
        last = np.r_[new[1:], True]
        yield _spans(ids[own], hashed[own], at[found[new]], at[found[last]] + size[own], keeper)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by document, keeper and first word: those that meet are one."""
    own = ("doc_id", "text_hash", "kept_id")
    for rows in _whole(batches, *own):
        ids, hashed, keeper, s, e = (rows[c].to_numpy(zero_copy_only=False) for c in (*own, "s", "e"))
        other = (ids[1:] != ids[:-1]) | (hashed[1:] != hashed[:-1]) | (keeper[1:] != keeper[:-1])
        base = np.cumsum(np.r_[0, other]) << 32  # so that a key's words are all above those of the keys before
        reach = np.maximum.accumulate(base + e)
        new = np.r_[True, (base + s)[1:] > reach[:-1]]
        last = np.r_[new[1:], True]
        yield _spans(ids[new], hashed[new], s[new], (reach - base)[last], keeper[new])


def span_text(text: str, s: str, e: str):
    """Words s to e of a text, as one string."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(t.encode("utf-8", "surrogatepass").split()[a:b]).decode("utf-8", "replace") for t, a, b in zip(texts, starts, stops, strict=True)], dtype=object)

    return run(F.col(text), F.col(s), F.col(e))


def joined(spans: str):
    """Column of an array of spans s, e: those that meet are one, in order."""
    one = "struct<s:int,e:int>"

    def step(acc, x):
        last = F.element_at(acc, -1)
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(F.col(spans).cast(f"array<{one}>")), F.array().cast(f"array<{one}>"), step)


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((int(x["s"]), int(x["e"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: str, spans: list) -> str:
    """The text less its words in spans; lines that lose words are rebuilt with single spaces, emptied ones go."""
    cuts, out, at = merged(spans), [], 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        own = [(max(s, at) - at, min(e, at + len(words)) - at) for s, e in cuts if s < at + len(words) and e > at]
        at += len(words)
        if own:
            for s, e in reversed(own):
                del words[s:e]
            line = b" ".join(words).decode("utf-8", "replace")
        if line or not own:
            out.append(line)
    return "\n".join(out)


def by_document(spans: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans: a document's own spans, as many as its length allows."""
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def substring_classes(docs: DataFrame) -> DataFrame:
    """doc_id, component_id, n_links, removed_words for each row of docs.

    Paragraphs (lines) of 20 words or more repeat each other when their 5-word shingles have a Jaccard
    similarity of 0.8 or more; every run of 20 words or more inside a line of 50 or more, and of 50
    words or more over line ends, when equal, whole. Of each component of passages the first in order of
    doc_id stays, the others are removed_words, and n_links counts the documents that keep them. Documents are of one
    class when a stretch of 50 words or more of one is kept by the other, directly or over others: a short line that many have ties
    none. component_id is the smallest doc_id of the class. Null, empty and short texts have no passage and are
    their own class; a null id has a null class. Repeated rows are classed alike: equal rows are one
    holder of their passages. Other columns are ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_spans(docs, scratch)
    held = spans.where("doc_id <> kept_id").groupBy("doc_id", "text_hash", "kept_id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    held = held.select("doc_id", "text_hash", "kept_id", F.exists(joined("spans"), lambda x: x["e"] - x["s"] >= LONG_WORDS).alias("long"))
    parts = connected_components(held.where("long").select(F.col("doc_id").alias("a"), F.col("kept_id").alias("b")))
    words = F.aggregate(joined("spans"), F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    removed = by_document(spans).select("doc_id", "text_hash", words.alias("removed_words"))
    links = held.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_links"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    out = rows.join(removed, ["doc_id", "text_hash"], "left").join(links, ["doc_id", "text_hash"], "left")
    out = out.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("component_id"), zero("n_links"), zero("removed_words"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text; n_chars follows it. Rows left without a word go, if words were cut.

    Null and blank texts stay as they are. Repeated rows hold the same passages, so they are cut alike. A null id
    keeps no run that others are cut for. Columns of any name are kept; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        spans = cut(by_document(repeated_spans(docs, scratch)))

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([t if x is None else without(t, list(x)) for t, x in zip(texts, lists, strict=True)], dtype=object)

    # Spark would move the last filter below the column and shorten each text twice, with two workers a task; a text that stays isn't sent to them
    shortened = shorten.asNondeterministic()(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans"))
    keyed = carried(docs, F.xxhash64("text").alias("text_hash"))
    out = fetch(keyed, spans, ["doc_id", "text_hash"], how="left")
    out = out.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(shortened))
    return unfolded(out.where(F.col("spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)
