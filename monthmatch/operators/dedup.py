"""Same-month duplicates and first-row lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthmatch.fixed_values import DEDUP_REASON, RECORD_KEY
from monthmatch.functions.text import joined
from monthmatch.operators.skew import split


def mark_duplicates(
    df: DataFrame,
    keys: Sequence[str],
    balance: Column,
    order: Sequence[str],
    record_id: str,
    heavy: Sequence[int] = (),
) -> DataFrame:
    """Flag every row but the one with the lowest balance of its key.

    A missing balance ranks last, equal balances go by ``order``, which must
    tell the rows of a key apart. ``heavy`` lists the hashes of keys whose rows
    are too many for one task: their winners (one row per key) come from a
    partially aggregated minimum and are broadcast back, so their rows are
    never brought together.
    """
    df = df.withColumn("ThisRowBalance", balance)
    names = df.columns
    if not heavy:
        return _ranked(df, names, keys, order, record_id)
    ordinary, hot = split(df, keys, heavy)
    rank = F.struct(F.col("ThisRowBalance").isNull(), F.col("ThisRowBalance"), *order)
    winners = hot.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
        F.min(rank).alias("_kept"), F.min_by(record_id, rank).alias("_kept_id")
    )
    dropped = rank != F.col("_kept")
    # Null-safe, as a window also takes nulls for equal.
    same_key = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    hot = hot.join(F.broadcast(winners), same_key).select(
        *names, *_flags(dropped, F.col("_kept.ThisRowBalance"), F.col("_kept_id"))
    )
    return _ranked(ordinary, names, keys, order, record_id).unionByName(hot)


def _ranked(
    df: DataFrame, names: Sequence[str], keys: Sequence[str], order: Sequence[str], record_id: str
) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.col("ThisRowBalance").asc_nulls_last(), *order)
    flags = _flags(
        F.row_number().over(w) > 1, F.first("ThisRowBalance").over(w), F.first(record_id).over(w)
    )
    return df.select(*names, *flags)


def _flags(dropped: Column, balance: Column, record: Column) -> list[Column]:
    return [
        dropped.alias("IsDuplicate"),
        F.when(dropped, balance).alias("KeptBalance"),
        F.when(dropped, record).alias("KeptOverThisRecordID"),
        F.when(dropped, F.lit(DEDUP_REASON)).alias("DedupReason"),
    ]


def composite_key() -> Column:
    """The duplicate key as text, for display."""
    return joined([F.col(c).cast("string") for c in RECORD_KEY])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key.

    Written as a filter on ``row_number`` so that each map task keeps one row
    per key before the shuffle (a window group limit); a key with many rows
    arrives as at most one row per map task.
    """
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_position", position).filter("_position = 1").drop("_position")
