"""Finding the few keys that hold too many rows for one task.

A key is heavy when its rows exceed twice the fair share of a shuffle
partition. The answer only steers the physical plan: a key missed or reported
wrongly changes where rows are computed, never what is computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Items a sketch tracks for each shuffle partition. It finds every key above
# about 3.5 / (TRACKED_PER_PARTITION * partitions) of the rows, which is below
# the 2 / partitions that make a key heavy.
TRACKED_PER_PARTITION = 4
# Partial sketches are merged in two levels so no task merges all of them.
SHARDS = 64
# Rows a task handles without trouble, whatever the fair share is.
MIN_HEAVY_ROWS = 200_000


def key_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


@dataclass(frozen=True)
class HeavyKeys:
    """Hashes of heavy identities and of heavy duplicate keys."""

    identities: tuple[int, ...] = ()
    records: tuple[int, ...] = ()


NO_HEAVY_KEYS = HeavyKeys()


def find_heavy_keys(
    df: DataFrame,
    identity: Sequence[str],
    record: Sequence[str],
    min_rows: int = MIN_HEAVY_ROWS,
) -> HeavyKeys:
    """Heavy keys by one narrow pass over the two keys, whatever the size of the input.

    A heavy key has more than ``2 / partitions`` of the rows, so there are
    fewer than half as many as shuffle partitions, and all of them are returned.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(1_000_000, max(256, TRACKED_PER_PARTITION * partitions))
    most = partitions // 2 + 1
    shard = F.pmod(F.spark_partition_id(), F.lit(SHARDS))
    sketches = (
        df.select(
            shard.alias("shard"),
            key_hash(identity).alias("identity"),
            key_hash(record).alias("record"),
        )
        .groupBy("shard")
        .agg(
            F.expr(f"approx_top_k_accumulate(identity, {tracked})").alias("identity"),
            F.expr(f"approx_top_k_accumulate(record, {tracked})").alias("record"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    # Grouped by a constant so that no input gives no row.
    found = sketches.groupBy(F.lit("all").alias("all")).agg(
        F.expr(f"approx_top_k_combine(identity, {tracked})").alias("identity"),
        F.expr(f"approx_top_k_combine(record, {tracked})").alias("record"),
        F.sum("rows").alias("rows"),
    ).select(
        F.expr(f"approx_top_k_estimate(identity, {most})").alias("identity"),
        F.expr(f"approx_top_k_estimate(record, {most})").alias("record"),
        "rows",
    )
    row = found.first()
    if row is None:
        return NO_HEAVY_KEYS
    limit = max(min_rows, 2 * row["rows"] // partitions)

    def above(items) -> tuple[int, ...]:
        return tuple(i["item"] for i in items if i["count"] > limit)

    return HeavyKeys(above(row["identity"]), above(row["record"]))


def heavy_frame(df: DataFrame, hashes: Sequence[int]) -> DataFrame:
    """Heavy keys as rows to join with; fewer than half the shuffle partitions."""
    rows = df.sparkSession.createDataFrame([(h,) for h in hashes], "_heavy BIGINT")
    return F.broadcast(rows)


def only_heavy(df: DataFrame, columns: Sequence[str], hashes: Sequence[int]) -> DataFrame:
    """The rows of heavy keys."""
    keys = heavy_frame(df, hashes)
    return df.join(keys, key_hash(columns) == F.col("_heavy"), "left_semi")


def split(df: DataFrame, columns: Sequence[str], hashes: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of heavy keys."""
    keys = heavy_frame(df, hashes)
    ordinary = df.join(keys, key_hash(columns) == F.col("_heavy"), "left_anti")
    return ordinary, only_heavy(df, columns, hashes)
