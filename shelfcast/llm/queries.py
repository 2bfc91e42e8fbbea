"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import alignment, decontamination, flatgraph, jaccard, mixing, packing, periodic, quality, repeats, separators, toxicity, urltrust, warc
from shelfcast.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The rules of the url filter: fixed values of its contract.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judged(table(spark, sf_dir, "pages"), [urltrust.split_rule(*r) for r in RULES])


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.document_tokens(table(spark, sf_dir, "documents"))


def op3_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), length=1024, end=2)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), window=50).drop("kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatgraph.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.documents_taken(mixing.mixture(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.valued(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapsed(table(spark, sf_dir, "documents"), rewrite=periodic.planted))


def queries() -> dict[str, Query]:
    found = (
        op1_url_trust,
        op2_separator_scan,
        op3_warc_dictionary,
        op4_jaccard_join,
        op5_best_fit_packing,
        op6_substring_dedup,
        op7_toxicity,
        op8_decontamination,
        op9_flat_graph,
        op10_quality,
        op11_source_mix,
        op12_token_alignment,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in found}
