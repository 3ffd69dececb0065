"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import carried, text_batches

SYMBOLS, DIMENSIONS = 48, 1024
#: Prototypes are kept on the driver, one for each language; more languages than this are refused.
MAX_LANGUAGES = 10_000
#: Weights are whole multiples of one part in so many, so that sums don't depend on their order.
GRAIN = 1 << 20


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x3000: 0 for what isn't a letter, 1-26 for a-z, more by hash."""
    table = np.zeros(0x3000, np.int64)
    for c in range(0x3000):
        if chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + (c * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


def letter_vectors(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, DIMENSIONS))


def trigrams(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams around each letter and their weights, in GRAINs of a vector of length 1; none without letters.

    Weights are whole, so that sums of them are exact in any order, however rows are dealt to batches.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    high = points >= len(table)
    s = table[np.where(high, 0, points)]
    if high.any():
        values, back = np.unique(points[high], return_inverse=True)
        s[high] = np.array([27 + (int(v) * 2654435761 >> 7) % (SYMBOLS - 27) if chr(v).isalpha() else 0 for v in values])[back]
    s = np.r_[0, s, 0]
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    middle = s[1:-1] > 0
    codes, counts = np.unique(((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[middle], return_counts=True)
    weights = np.sqrt(counts)
    return codes, np.rint(weights / np.linalg.norm(weights) * GRAIN)


def bundle(codes: list[np.ndarray], weights: list[np.ndarray], rows: np.ndarray, n: int, letters: np.ndarray) -> np.ndarray:
    """n vectors; row i of the lists adds its weighted trigram vectors to vector rows[i].

    A trigram's vector is the product of its letters' vectors, each rotated by its place.
    """
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    counts = np.zeros((n, len(found)))
    np.add.at(counts, (np.repeat(rows, [len(c) for c in codes]), at), np.concatenate(weights))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    out = np.zeros((n, DIMENSIONS))
    for i in range(0, len(found), 1024):  # so that memory doesn't follow the number of trigrams
        x = found[i : i + 1024]
        out += counts[:, i : i + 1024] @ (first[x // (SYMBOLS * SYMBOLS)] * second[x // SYMBOLS % SYMBOLS] * letters[x % SYMBOLS])
    return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[float]]:
    """Prototype of each language: the sum of its documents' vectors, of length 1. All rows with lang and letters count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, letters, sums = symbol_table(), letter_vectors(), {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                langs = {x: i for i, x in enumerate(dict.fromkeys(part["lang"]))}
                each = [trigrams(t, table) for t in part["text"]]
                vectors = bundle([c for c, _ in each], [w for _, w in each], np.array([langs[x] for x in part["lang"]]), len(langs), letters)
                for x, i in langs.items():
                    sums[x] = sums.get(x, 0) + vectors[i]
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.astype(np.int64) for v in sums.values()]})

    rows = text_batches(labelled).select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInPandas(run, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("vector"))
    found = whole.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        v = np.array(r["vector"], np.float64)
        if v.any():
            out[r["lang"]] = (v / np.linalg.norm(v)).tolist()
    return out


def predict(prototypes: dict[str, list[float]], text: str = "text") -> Column:
    """Struct lang_pred, score: the nearest prototype and its cosine, 0 if negative; ties go to the first
    by name. A text that is null or has no letter, and any text if nothing was learned, is und with 0."""
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float64).reshape(len(prototypes), DIMENSIONS)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, letters = symbol_table(), letter_vectors()
        for texts in batches:
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            for at in range(0, len(texts), 256):
                each = {at + i: x for i, t in enumerate(texts.iloc[at : at + 256]) if t is not None and len((x := trigrams(t, table))[0])}
                if each and names:
                    vectors = bundle([c for c, _ in each.values()], [w for _, w in each.values()], np.arange(len(each)), len(each), letters)
                    cosines = np.round(vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), 9)
                    best = cosines.argmax(axis=1)
                    langs[list(each)] = np.array(names, object)[best]
                    scores[list(each)] = np.clip(cosines[np.arange(len(best)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return run(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, learned from labelled rows that aren't held out.

    Repeated rows count as often as they stand; a null doc_id is not held out. Other columns are
    ignored; an empty table gives no rows.
    """
    prototypes = learn(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), predict(prototypes).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """docs less those whose language can't be told: no letters, or a cosine below least, near that of random text.

    Null texts have no letters. Repeated rows stay or go together; columns of any name are kept; an empty table
    gives no rows. Without labels nothing is learned, and all that have a letter stay.
    """
    prototypes = learn(docs.where(~held_out()))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = carried(docs, predict(prototypes).alias("found"))
    kept = found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= least))
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in docs.columns])
