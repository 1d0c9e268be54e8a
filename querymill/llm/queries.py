"""Queries over the llm operators: name → (spark, sf_dir) → DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querymill.llm import consensus, defects, exactdup, langid, mixing, neardup, overlap, splits, tokens
from querymill.session import table


def _records(spark: SparkSession, d: str, split: str = "train") -> DataFrame:
    return table(spark, d, f"calibration_{split}")


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d, "dev").unionByName(_records(spark, d, "test"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.flag(_records(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.misnamed(_records(spark, d), table(spark, d, "db_catalog"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    shares = {r["split_name"]: r["share"] for r in table(spark, d, "split_targets").collect()}
    return splits.split(_records(spark, d), table(spark, d, "db_catalog"), shares)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.disputed(table(spark, d, "voters"), table(spark, d, "calibration_verdicts"))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "voters"), table(spark, d, "calibration_verdicts"))


def p4_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.reliability(table(spark, d, "voters"), table(spark, d, "calibration_verdicts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(_records(spark, d), _held_out(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(p5_found(spark, d), _records(spark, d), {"dev": _records(spark, d, "dev"), "test": _records(spark, d, "test")}, table(spark, d, "db_catalog", "db_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_records(spark, d))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(_records(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return exactdup.duplicates(_records(spark, d))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    return exactdup.collapse(_records(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.report(*_swapped(mixing.mixture(table(spark, d, "documents"), targets), targets))


def p9_report_whole(spark: SparkSession, d: str) -> DataFrame:
    """Half as many tokens again as the documents have: scarce sources' targets can't be met, the exponent bisects to their limits."""
    targets = table(spark, d, "mix_targets")
    return mixing.report(*_swapped(mixing.mixture(table(spark, d, "documents"), targets, 1.5), targets))


def p9_report_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Shares by temperature alone, of the entropy of the target shares, over half of all tokens."""
    targets = table(spark, d, "mix_targets")
    wanted = mixing.entropy({r["source"]: r["target_share"] for r in targets.collect()})
    return mixing.report(*_swapped(mixing.mixture(table(spark, d, "documents"), targets, 0.5, entropy_of=wanted), targets))


def _swapped(made: tuple[DataFrame, mixing.Plan], targets: DataFrame) -> tuple[DataFrame, DataFrame, mixing.Plan]:
    return made[0], targets, made[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.segments(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_splits, p4_found, p4_consensus, p4_reliability, p5_found, p5_report, p6_found, p6_groups, p7_found, p7_copies, p8_ids,
        p9_mix, p9_report, p9_report_whole, p9_report_entropy, p10_found, p10_segments,
    )
}
