"""Queries over the operators of this subpackage, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import ann, chat, langid, license, maintext, media, merkle, mixing, negatives, packing, simhash, substring, urlfilter


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": _over("documents", mixing.mix_report),
    "op2_link_tool_calls": _over("conversations", lambda t: chat.link_tool_calls(*chat.turns_as_calls(t), chat.REPLY)),
    "op3_language_id": _over("documents", langid.identify),
    "op4_simhash": _over("documents", simhash.simhash_components),
    "op5_repeated_passages": _over("documents", substring.substring_classes),
    "op6_best_fit_packing": _over("documents", packing.pack_documents),
    "op7_media_fingerprints": _over("documents", media.media_digest),
    "op8_nearest_neighbours": _over("embeddings", ann.search),
    "op9_url_filters": _over("pages", lambda t: urlfilter.page_verdicts(t, urlfilter.entries_of(t))),
    "op10_license_scan": _over("documents", license.license_report),
    "op11_hard_negatives": _over("embeddings", negatives.mine),
    "op12_main_text": _over("pages", maintext.main_text),
    "op13_merkle_manifest": _over("documents", merkle.manifest),
}

ORACLE_SQL: dict[str, str] = {
    "op2_link_tool_calls": chat.LINKED_TURNS_SQL,
    "op9_url_filters": urlfilter.PAGE_VERDICTS_SQL,
    "op11_hard_negatives": negatives.MINED_SQL,
    "op13_merkle_manifest": merkle.MANIFEST_SQL,
}
