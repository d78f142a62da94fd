"""Counts over tagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.fixed_values import (
    CATEGORY_CARRYOVER,
    CATEGORY_EXACT_NOT_FOUND,
    CATEGORY_REARRANGED_NOT_FOUND,
    DIFFERENT,
    ENRICHED,
    EXACT,
    METRICS,
    NO_MATCH,
    REARRANGED,
)


def metric_counts() -> list[Column]:
    """The 14 metrics as aggregates over tagged rows."""
    flag, category = F.col("MatchFlag"), F.col("ExceptionCategory")
    conditions = (
        F.lit(True),
        F.col("IsDuplicate"),
        ~F.col("IsDuplicate"),
        F.col("DateChanged"),
        flag == EXACT,
        flag == REARRANGED,
        flag == ENRICHED,
        flag == DIFFERENT,
        flag == NO_MATCH,
        F.col("Route") == "cleaned_output",
        F.col("Route") == "rearranged_output",
        category == CATEGORY_EXACT_NOT_FOUND,
        category == CATEGORY_REARRANGED_NOT_FOUND,
        category == CATEGORY_CARRYOVER,
    )
    return [F.count_if(c).alias(m) for m, c in zip(METRICS, conditions, strict=True)]


def run_counts(tagged: DataFrame) -> DataFrame:
    """One row with the 14 metrics as columns, from one aggregation."""
    return tagged.agg(*metric_counts())


def run_summary(tagged: DataFrame) -> DataFrame:
    """The metrics as (Metric, Count) rows."""
    pairs = [
        F.struct(F.lit(m).alias("Metric"), F.col(f"`{m}`").alias("Count")) for m in METRICS
    ]
    return run_counts(tagged).select(F.inline(F.array(*pairs)))


def headline_metrics(tagged: DataFrame) -> DataFrame:
    """Input, auto-cleaned and queued totals and the date changes, in one row."""

    def total(*metrics: str):
        return sum((F.col(f"`{m}`") for m in metrics[1:]), F.col(f"`{metrics[0]}`"))

    return run_counts(tagged).select(
        total("Input records").alias("InputRecords"),
        total(
            "Eligible for carry-forward (exact)",
            "Eligible for carry-forward (rearranged)",
            "Enriched (auto-processed)",
        ).alias("AutoCleaned"),
        total(
            "Different (needs review)",
            "No previous-month match",
            "Same hash, not found in cleaned file",
            "Rearranged, not found in cleaned file",
            "Previously UNL'd, still unresolved (carryover)",
        ).alias("SentToUnl"),
        total("Date changes logged (informational)").alias("DateChanges"),
    )
