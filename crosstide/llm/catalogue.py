"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosstide.llm import (centroids, chat_format, html_extract, license_scan, mixing, packing, quality_classifier, quality_rules, sharding,
                           signature_tree, topk, webp, whitening)
from crosstide.llm.common import table


def _of(name: str, report):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(table(spark, sf_dir, name))
    return run


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_pack": _of("documents", packing.pack),
    "op2_quality_rules": _of("documents", quality_rules.report),
    "op3_license_scan": _of("documents", license_scan.report),
    "op4_webp": _of("documents", webp.report),
    "op5_chat_format": chat_format.query,
    "op6_mix_sources": _of("documents", mixing.report),
    "op7_ngram_join": _of("documents", signature_tree.classes),
    "op8_html_extract": _of("pages", html_extract.report),
    "op9_shard": _of("documents", sharding.report),
    "op10_quality_classifier": _classified,
    "op11_whitening": _of("embeddings", whitening.report),
    "op12_centroids": _of("embeddings", centroids.report),
    "op13_topk": _of("embeddings", topk.report),
}

SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op3_license_scan": license_scan.SQL,
    "op5_chat_format": chat_format.SQL,
    "op6_mix_sources": mixing.SQL,
    "op12_centroids": centroids.SQL,
    "op13_topk": topk.SQL,
}
