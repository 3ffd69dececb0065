"""Pairs of similar names by an inverted index of grams, with a count filter.

A name's grams are the pairs of neighbouring characters of its words, their ends marked; the second occurrence of a gram is another
gram. A deleted character costs a name two grams at most and an inserted one costs one, so names of a weighted ratio of cutoff or
more share a number of grams that follows from their lengths; where one is much longer a word that both have does as well. Blocks of a
group's names and aliases meet in tasks, which count shared grams by postings and score only pairs that share enough.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from panelcast.functions import scoring
from panelcast.functions.similarity import FAR_LONGER, LONG, PART_SCALE, WORDS_SCALE
from panelcast.sources.sinks import kept

#: Below this cutoff names need not share a gram, and all names of a group are compared.
LEAST_CUTOFF = 72.0
#: Names up to this length have their bounds by table; longer ones by the same rule in proportion.
TABLE = 128
#: Aliases and names of a group that a task reads.
POSTINGS, NAMES = 10_000, 1_000
#: Pairs that a task collects before it scores them.
PAIRS = 100_000


def words(name: Column, first: int | None = None) -> Column:
    """Words of a name; with first so many of a text, which is split no further, and its rest."""
    return F.filter(F.split(name, r"\s+", first + 2 if first else -1), lambda w: w != "")


def near_bound(m: int, cutoff: float) -> int:
    """Grams that a name of m characters shares with any of at most LONG times its length, or of its length over LONG, and cutoff or more."""
    least = m + 1
    for n in range(max(1, ceil(m / LONG)), floor(m * LONG) + 1):
        long_enough = min(m, n, ceil(cutoff / 200 * (m + n) - 1e-9))
        least = min(least, m + 1 - 2 * (m - long_enough) - (n - long_enough))
    return max(1, min(least, m // 3 + 1))


def far_bound(m: int, cutoff: float) -> int:
    """Grams that a name of m characters shares with a window of a longer one, less those at the window's ends."""
    least = m + 1
    for w in range(1, m + 1):
        common = ceil(cutoff / PART_SCALE / 200 * (m + w) - 1e-9)
        if common <= w:
            least = min(least, m + 1 - 2 * (m - common) - (w - common) - (2 if w == m else 1))
    return max(1, least)


#: Rows of a table that is sent to all tasks; a larger one is shuffled with what looks it up.
SENT = 20_000


def looked_up(table: DataFrame, most: int = SENT) -> DataFrame:
    """table computed once, and sent to all tasks where it is small, so that rows that look up a few frequent names stay where they are."""
    table = kept(table)
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def numbered_grams(parts: list[str]) -> list[str]:
    """Distinct grams of a name's words: pairs of characters of each word between marks, numbered where one occurs again."""
    seen: Counter = Counter()
    out = []
    for word in parts:
        marked = f"\u0002{word}\u0003"
        for g in map("".join, zip(marked, marked[1:], strict=False)):
            seen[g] += 1
            out.append(f"{g}{seen[g]}")
    return out


def postings(lists: list) -> dict[str, np.ndarray]:
    """For each value of lists the places of the lists that have it."""
    at: dict[str, list[int]] = defaultdict(list)
    for i, values in enumerate(lists):
        for v in values:
            at[v].append(i)
    return {v: np.array(x) for v, x in at.items()}


class Index:
    """Aliases of a block, the shortest first, with the postings of their grams and words, which say what a name meets."""

    def __init__(self, aliases: list[str], cutoff: float):
        self.aliases, self.cutoff = sorted(aliases, key=lambda a: (len(a), a)), cutoff
        parts = [scoring.split(a) for a in self.aliases]
        self.grams, self.words = postings([numbered_grams(w) for w in parts]), postings([set(w) for w in parts])
        self.sizes = np.array([len(a) for a in self.aliases])
        self.cores = np.array([len(" ".join(dict.fromkeys(w))) for w in parts])
        self.near, self.far = (np.array([0] + [rule(m, cutoff) for m in range(1, TABLE + 1)]) for rule in (near_bound, far_bound))

    def met(self, name: str) -> np.ndarray:
        """Places of aliases among which are all of a weighted ratio of cutoff or more with name."""
        if self.cutoff < LEAST_CUTOFF:
            return np.arange(len(self.aliases))
        parts = scoring.split(name)
        core = len(" ".join(dict.fromkeys(parts)))
        if core == 1:
            return np.arange(len(self.aliases))
        shared = np.zeros(len(self.aliases), np.int32)
        for g in numbered_grams(parts):
            if g in self.grams:
                shared[self.grams[g]] += 1
        longer = np.maximum(self.sizes, len(name)) / np.minimum(self.sizes, len(name))
        apart = (longer >= LONG) & (longer <= FAR_LONGER)
        enough = np.where(longer < LONG, self.near[min(core, TABLE)], self.far[np.minimum(np.minimum(core, self.cores), TABLE)])
        met = ((longer <= FAR_LONGER) & (shared >= enough)) | (self.cores == 1)
        if self.cutoff <= 100 * WORDS_SCALE * PART_SCALE:
            for w in set(parts):
                if w in self.words:
                    own = self.words[w]
                    met[own] |= apart[own]
        return np.flatnonzero(met)


def most_similar(names: list[str], index: Index, most: int | None, scored: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of names and of the index's aliases and their weighted ratio, of cutoff or more, or of all that meet; of each name the most similar."""
    if scored:
        known = scoring.letters(names, index.aliases, [" "])
        a, b = scoring.Names(names, known), scoring.Names(index.aliases, known)
        order = np.argsort(np.argsort(np.array(index.aliases, object)))
    i, j, n = [], [], 0
    for at, name in enumerate(names):
        found = index.met(name)
        i.append(np.full(len(found), at))
        j.append(found)
        n += len(found)
        if n < PAIRS and at < len(names) - 1:
            continue
        p, q, i, j, n = np.concatenate(i), np.concatenate(j), [], [], 0
        if not scored:
            yield p, q, np.zeros(len(p))
            continue
        score = scoring.weighted_ratio(a, p, b, q)
        own = np.flatnonzero(score >= index.cutoff)
        if most is not None:
            own = own[np.lexsort((order[q[own]], -score[own], p[own]))]
            start = np.searchsorted(p[own], p[own])
            own = own[np.arange(len(own)) - start < most]
        yield p[own], q[own], score[own]


def compared(names: DataFrame, aliases: DataFrame, cutoff: float, group: str, most: int | None = None, scored: bool = True) -> DataFrame:
    """group, name, alias, similarity of the distinct pairs of a group that most_similar gives for a block of its names and one of its aliases.

    A group's names and aliases are dealt to blocks by their number, so that a group of any size is spread; every two blocks meet in a task.
    """
    both = names.select(group).limit(0).unionByName(aliases.select(group).limit(0)).schema[0].dataType
    sides = [rows.where(F.col(group).isNotNull() & (F.size(words(F.col(c))) > 0)).select(F.col(group).cast(both).alias(group), c).distinct() for rows, c in ((names, "name"), (aliases, "alias"))]
    sides = [kept(s) for s in sides]
    sizes = [s.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias(c)) for s, size, c in zip(sides, (NAMES, POSTINGS), ("_p", "_q"), strict=True)]
    sizes = looked_up(sizes[0].join(sizes[1], group))
    tasks = max(names.sparkSession.sparkContext.defaultParallelism, sizes.agg(F.coalesce(F.sum(F.col("_p") * F.col("_q")), F.lit(0))).first()[0])
    blocks = []
    for rows, c, own, other in zip(sides, ("name", "alias"), ("_p", "_q"), ("_q", "_p"), strict=True):
        rows = rows.join(sizes, group).select(group, c, F.pmod(F.xxhash64(c), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
        blocks.append(rows.select(group, "_p", "_q", c).repartition(tasks, group, "_p", "_q").groupBy(group, "_p", "_q"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        index, own = Index(right["alias"].to_pylist(), cutoff), left["name"].to_pylist()
        found = list(most_similar(own, index, most, scored)) if len(left) and len(right) else []
        i, j, score = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((int, int, float), zip(*found, strict=True) if found else ((), (), ()), strict=True))
        texts = [pa.array(x, pa.string()).take(pa.array(at)) for x, at in ((own, i), (index.aliases, j))]
        return pa.table([pa.repeat(key[0], len(i)), *texts, pa.array(score)], names=[group, "name", "alias", "similarity"])

    schema = StructType([StructField(group, both), StructField("name", StringType()), StructField("alias", StringType()), StructField("similarity", DoubleType())])
    return blocks[0].cogroup(blocks[1]).applyInArrow(run, schema)


def met_pairs(names: DataFrame, aliases: DataFrame, cutoff: float, group: str = "region_code") -> DataFrame:
    """group, name, alias of a group, distinct, among which are all of a weighted ratio of cutoff or more.

    names (group, name), aliases (group, alias), normalised, with single spaces; null and blank ones are left out. Names or aliases of
    one character, of which a group has as many as there are characters, meet all of the group.
    """
    return compared(names, aliases, cutoff, group, scored=False).drop("similarity")


def dealt(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """rows computed once and dealt to tasks of size rows, by some columns or all, however few bytes they have: what follows takes long for each."""
    rows = kept(rows)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // size)), *(by or rows.columns))


def ratios(pairs: DataFrame) -> DataFrame:
    """pairs (a, b and other columns) with all parts of their weighted ratio, null where a text is; of the pairs that a task holds at a time, equal ones are scored once."""

    def scored_pairs(rows: pa.Table) -> pa.Table:
        texts, codes = zip(*[(x.dictionary.to_pylist(), x.indices.fill_null(-1).to_numpy()) for x in (rows[c].combine_chunks().dictionary_encode() for c in ("a", "b"))], strict=True)
        some = np.flatnonzero((codes[0] >= 0) & (codes[1] >= 0))
        own, at = np.unique(codes[0][some].astype(np.int64) * max(1, len(texts[1])) + codes[1][some], return_inverse=True)
        known = scoring.letters(*texts, [" "])
        found = scoring.ratios(scoring.Names(texts[0], known), own // max(1, len(texts[1])), scoring.Names(texts[1], known), own % max(1, len(texts[1])))
        place = np.full(len(rows), len(own))
        place[some] = at
        for c, values in found.items():
            rows = rows.append_column(c, pa.array(np.append(values, np.nan)[place], pa.float64(), mask=place == len(own)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= PAIRS:
                yield from scored_pairs(pa.Table.from_batches(held)).to_batches()
                held, n = [], 0
        if n:
            yield from scored_pairs(pa.Table.from_batches(held)).to_batches()

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, *[StructField(c, DoubleType()) for c in scoring.PARTS]]))


def similar(names: DataFrame, aliases: DataFrame, cutoff: float, group: str = "region_code", most: int | None = None) -> DataFrame:
    """group, name, alias, similarity: all pairs of a group whose weighted ratio is cutoff or more; with most only so many of a name, the most similar, ties by alias."""
    pairs = compared(names, aliases, cutoff, group, most)
    if most is None:
        return pairs
    rank = F.row_number().over(Window.partitionBy(group, "name").orderBy(F.desc("similarity"), "alias"))
    return pairs.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def closest(names: DataFrame, aliases: DataFrame, cutoff: float, group: str = "region_code") -> DataFrame:
    """group, name, alias, similarity: the most similar alias of each name that has one of cutoff or more, ties by alias."""
    return similar(names, aliases, cutoff, group, 1)
