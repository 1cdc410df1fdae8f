"""Queries over the test tables for the operators of this subpackage: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baglight.llm import category_sample, containers, near_captions, related_splits, split_overlap, subjects, tokenise
from baglight.operators.rows import latest
from baglight.sources.tables import table


def current_split(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current rows of scan_split."""
    return latest(table(spark, d, "scan_split", "uid", "run_at", *columns), "uid", "run_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.groups_with_tag(current_split(spark, d, "bag_tag", "dup_group"))


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    scans = current_split(spark, d, "bag_tag", "dup_group", "labels")
    return related_splits.split_related(scans, table(spark, d, "split_targets")).select("uid", "part")


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return category_sample.sample_to_targets(current_split(spark, d, "part", "cache_ok", "labels"), table(spark, d, "sample_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the drawn sample misses because the part can't supply them."""
    return _p2(spark, d)[1].filter("short > 0 and supply < need").select("part", "class_id")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0].select("uid", "part")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1]


def current_captions(spark: SparkSession, d: str) -> DataFrame:
    """uid and caption of the current rows of scan_index."""
    return latest(table(spark, d, "scan_index", "uid", "caption", "indexed_at"), "uid", "indexed_at").select("uid", "caption")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_captions.near_pairs(current_captions(spark, d), "uid", "caption")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """uid, group, links: membership without expanding copies or pairs."""
    return near_captions.near_groups(current_captions(spark, d), "uid", "caption", links=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.ordered_pairs(split_overlap.cross_split_pairs(current_split(spark, d, "part", "img_path", "sig_d", "sig_a")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(current_split(spark, d, "part", "folder_name", "img_path", "sig_d", "sig_a"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.token_ids(table(spark, d, "documents", "doc_id", "text"), "byte_bpe_50k")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "container_specs")
    names = [r.tokenizer for r in specs.select("tokenizer").distinct().collect()]  # a row a tokenizer
    counts = tokenise.token_counts(table(spark, d, "documents", "doc_id", "text"), names)
    return containers.pack_documents(counts, specs)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return containers.packing_report(p8_pack(spark, d), table(spark, d, "container_specs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return subjects.Subjects(docs, table(spark, d, "subject_labels", "doc_id", "subject"), table(spark, d, "subject_areas", "subject")).found()


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents", "doc_id", "lang", "source"), p9_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_split": p1_split,
    "p2_found": p2_found,
    "p2_sample": p2_sample,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_ids": p7_ids,
    "p8_pack": p8_pack,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
