"""Keyed merge of clean rows written by several batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.fixed_values import (
    CLEAN_ENRICHED,
    CLEAN_EXACT,
    CLEAN_REARRANGED,
    CLEAN_SEED,
    IDENTITY_KEY,
)


def category_rank() -> Column:
    """The order in which categories are written for one file."""
    category = F.col("MatchCategory")
    return (
        F.when(category == CLEAN_SEED, 0)
        .when(category == CLEAN_EXACT, 1)
        .when(category == CLEAN_REARRANGED, 2)
        .when(category == CLEAN_ENRICHED, 3)
    )


def merge_clean(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """One row per identity and period out of all rows ever written for it.

    The last write supplies the values and the category, the first one the
    record it came from, as updating a row in place would. Both are partial
    aggregates: a key written many times shrinks before the shuffle.
    """
    rank = F.struct(*order)
    last = F.max_by(F.struct("IdentityFields", "MatchCategory"), rank)
    first = F.min_by(F.struct("CleanRecordID", "SourceRawRecordID", "Status", "CreatedAt"), rank)
    return (
        rows.groupBy(*IDENTITY_KEY, "ReportingPeriod")
        .agg(last.alias("_last"), first.alias("_first"))
        .select(*IDENTITY_KEY, "ReportingPeriod", "_first.*", "_last.*")
    )
