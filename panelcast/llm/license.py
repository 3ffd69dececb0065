"""License scans by a positional index of rare words, in DataFrame expressions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key phrases that each name a licence, and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates with their labels and the phrase that must stand where the template has it.
TEMPLATES = (
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("reserved", "all rights reserved", "rights reserved"),
)
#: A lower-cased word is a run of digits, a-z and what isn't ASCII; A-Z count as they are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_column(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BREAKS), "")


def _plain(word: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(word, UPPER, LOWER)


def _one_of(word: Column, known: list[str]) -> Column:
    return F.lower(word).isin(known) & _plain(word).isin(known)


def vocabulary(templates: tuple = TEMPLATES, phrases: dict = PHRASES) -> list[str]:
    """All words of templates and phrases."""
    return sorted({w for _, t, _ in templates for w in t.split()} | {w for p in phrases for w in p.split()})


def anchors(phrase: str, idf: dict[str, float], most: int = 2) -> list[tuple[str, int]]:
    """The words of highest IDF of a phrase and their places in it; a word is taken where it stands first."""
    words = phrase.split()
    ranked = sorted({w: words.index(w) for w in words}.items(), key=lambda x: (-idf[x[0]], x[0]))
    return ranked[:most]


def word_idf(docs: DataFrame, text: str, words: list[str]) -> dict[str, float]:
    """ln(1 + documents / documents with the word) of each given word, over all documents."""
    found = F.array_distinct(F.transform(F.filter("words", lambda w: _one_of(w, words)), _plain))
    seen = docs.select(words_column(text).alias("words")).select(F.explode(F.concat(found, F.array(F.lit("")))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in seen.collect()}  # at most one row for each given word, and one for all
    n = max(counts.get("", 0), 1)
    return {w: log(1 + n / max(counts.get(w, 0), 1)) for w in words}


def _is_at(start: Column, phrase: str) -> Column:
    """Whether the phrase's words stand at word start of the column words."""
    size = len(phrase.split())
    return F.when(start >= 0, F.array_join(F.transform(F.slice("words", F.greatest(start, F.lit(0)) + 1, size), _plain), " ") == phrase).otherwise(F.lit(False))


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict = PHRASES, least: float = 0.6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, places, base, matches for each row of docs.

    places has the start of every base phrase, base the labels of those found, with repeats. matches has label, at and
    score of every template placed in the text. The file's occurrences of the two words of highest IDF in a key
    phrase are its postings; each gives a start by its relative position, and only starts that both give are
    kept. There the key phrase must stand, and a placing holds if the template words in their places have the
    share least of the template's IDF. A key phrase has both words in their places, so none that holds is missed.
    Null texts are empty; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    idf = word_idf(docs, text, vocabulary(templates, phrases))
    rare = sorted({w for p in (*phrases, *[key for _, _, key in templates]) for w, _ in anchors(p, idf)})
    rows = docs.select(F.col(doc_id).alias("doc_id"), words_column(text).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), _plain(w).alias("word"))), lambda h: h["word"].isin(rare))
    none = F.array().cast("array<struct<at:int,word:string>>")
    rows = rows.withColumn("hits", F.when(F.exists("words", lambda w: _one_of(w, rare)), hits).otherwise(none))

    def shifted(word: str, k: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - k)

    def starts(phrase: str) -> Column:
        """Places where all of a phrase's words stand."""
        found = [shifted(w, k) for w, k in anchors(phrase, idf)]
        common = found[0]
        for other in found[1:]:
            common = F.array_intersect(common, other)
        return F.filter(common, lambda at: _is_at(at, phrase))

    def placings(label: str, template: str, key: str) -> Column:
        words = template.split()
        total = sum(idf[w] for w in words)
        ahead = next(i for i in range(len(words)) if words[i : i + len(key.split())] == key.split())
        score = lambda o: sum((F.when((o + i >= 0) & (_plain(F.get("words", o + i)) == w), idf[w] / total).otherwise(0.0) for i, w in enumerate(words)), F.lit(0.0))
        scored = F.transform(F.col(keys[key]), lambda at: F.struct(F.lit(label).alias("label"), (at - ahead).alias("at"), F.least(F.round(score(at - ahead), 9), F.lit(1.0)).alias("score")))
        return F.filter(scored, lambda m: m["score"] >= least)

    wanted = list(dict.fromkeys([*phrases, *[key for _, _, key in templates]]))
    keys = {p: f"at{i}" for i, p in enumerate(wanted)}
    empty = F.array().cast("array<struct<label:string,at:int,score:double>>")
    any_hit = F.size("hits") > 0
    rows = rows.select("doc_id", "words", *[F.when(any_hit, starts(p)).otherwise(F.array().cast("array<int>")).alias(c) for p, c in keys.items()])
    some = F.size(F.concat(*[F.col(keys[key]) for key in dict.fromkeys(k for _, _, k in templates)])) > 0
    labels = F.array_compact(F.array(*[F.when(F.size(keys[p]) > 0, F.lit(x)) for p, x in phrases.items()]))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.concat(*[F.col(keys[p]) for p in phrases]).alias("places"), labels.alias("base"), F.when(some, F.concat(*[placings(*t) for t in templates])).otherwise(empty).alias("matches"))


def license_report(docs: DataFrame, **settings: object) -> DataFrame:
    """Digest of scan_licenses; score is the best placing's, 0 without one."""
    found = scan_licenses(docs, **settings)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat(F.col("base"), F.col("matches.label"))).alias("labels"),
        F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0)).alias("score"),
    )
