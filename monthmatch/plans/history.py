"""Reconcile all months of a history together, instead of one after the other.

What a record is matched with is last month's record, which is there already:
all months are matched at once, with the month as part of the key. Only the
verified values of a month depend on those of the month before, and they
follow from runs of months: an identity's values are verified from the month in
which they were seeded or enriched, for as long as each following month has the
record again, exact or rearranged. Such runs are islands of consecutive months,
found by windows over one row for each identity and month.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthmatch.fixed_values import (
    BALANCE,
    CLEAN_ENRICHED,
    CLEAN_EXACT,
    CLEAN_REARRANGED,
    CLEAN_SEED,
    DATE,
    ENRICHED,
    EXACT,
    MATCH_KEY,
    REARRANGED,
    hash_fields,
)
from monthmatch.functions.fields import unpack
from monthmatch.functions.parse import amount_of
from monthmatch.functions.text import identity_key
from monthmatch.operators.dedup import mark_duplicates
from monthmatch.operators.route import exception_category
from monthmatch.plans.reconcile import duplicate_keys, reconcile
from monthmatch.sources.registry import FILE_ORDER, Registry

PERIOD = "ReportingPeriod"
_CODE, _JOINT = "SubscriberCode", "\n"
# Within a month, categories are written in this order.
_WRITTEN = {CLEAN_SEED: 0, CLEAN_EXACT: 1, CLEAN_REARRANGED: 2, CLEAN_ENRICHED: 3}


@dataclass
class History:
    """``tagged``: every submitted row and what became of it; ``clean``: the verified values of each month."""

    tagged: DataFrame
    clean: DataFrame


def _month(period: Column) -> Column:
    """Months since the year 0, so that consecutive ones differ by one."""
    return F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int") - 1


def _next(period: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(period, "yyyy-MM"), 1), "yyyy-MM")


def _keyed(rows: DataFrame, period: Column) -> DataFrame:
    """Rows whose subscriber code holds the month they belong to or are looked up in."""
    return rows.withColumn(_CODE, F.concat(_CODE, F.lit(_JOINT), period))


def _plain(rows: DataFrame) -> DataFrame:
    code = F.split(_CODE, _JOINT)
    rows = rows.withColumns({_CODE: code[0], PERIOD: code[1]})
    return rows.withColumn("IdentityKey", identity_key()) if "IdentityKey" in rows.columns else rows


def clean_states(tagged: DataFrame, seeds: DataFrame, submission_type: str) -> DataFrame:
    """The verified values of every identity and month, from rows matched with the month before.

    ``tagged`` rows have ``MatchFlag`` and the month; ``seeds`` have the keys, the
    month and the fields, null where a field was not given.
    """
    fields = hash_fields(submission_type)
    category = (
        F.when(F.col("MatchFlag") == EXACT, F.lit(CLEAN_EXACT))
        .when(F.col("MatchFlag") == REARRANGED, F.lit(CLEAN_REARRANGED))
        .when(F.col("MatchFlag") == ENRICHED, F.lit(CLEAN_ENRICHED))
    )
    values = F.struct(*[F.col(f) for f in fields]).alias("values")
    rank = F.create_map(*[F.lit(x) for pair in _WRITTEN.items() for x in pair])
    written = tagged.filter(~F.col("IsDuplicate")).withColumn("category", category).filter(F.col("category").isNotNull())
    written = written.select(*MATCH_KEY, PERIOD, "category", *FILE_ORDER, values)
    seeded = seeds.select(
        *MATCH_KEY,
        PERIOD,
        F.lit(CLEAN_SEED).alias("category"),
        F.lit(-1).cast("bigint").alias("SequenceNumber"),
        F.lit("").alias("PartName"),
        F.lit(0).cast("bigint").alias("BlockStart"),
        F.col("RowIndex") if "RowIndex" in seeds.columns else F.lit(0).cast("bigint").alias("RowIndex"),
        values,
    )
    order = F.struct("SequenceNumber", rank[F.col("category")].alias("rank"), *FILE_ORDER[1:])
    last = F.struct("category", "values")
    # One row for each identity and month: the last row written if nothing was
    # verified the month before (what is carried is not written then), and if it was.
    source = F.col("category").isin(CLEAN_SEED, CLEAN_ENRICHED)
    months = (
        written.unionByName(seeded)
        .groupBy(*MATCH_KEY, PERIOD)
        .agg(
            F.max_by(F.when(source, last), F.when(source, order)).alias("anew"),
            F.max_by(last, order).alias("any"),
        )
        .withColumn("month", _month(F.col(PERIOD)))
    )
    by_key = W.partitionBy(*MATCH_KEY).orderBy("month")
    months = months.withColumn("island", F.col("month") - F.row_number().over(by_key))
    by_island = W.partitionBy(*MATCH_KEY, "island").orderBy("month")
    sofar = F.coalesce(F.max(F.col("anew").isNotNull()).over(by_island), F.lit(False))
    months = months.withColumn("verified", sofar)
    before = F.coalesce(F.lag("verified").over(by_island), F.lit(False))
    months = months.withColumn("before", before).filter("verified")
    months = months.withColumn("last", F.when(F.col("before"), F.col("any")).otherwise(F.col("anew")))
    # What is written anew begins a run; in a run the first value that is known stays.
    begins = (~F.col("before") | F.col("last.category").isin(CLEAN_SEED, CLEAN_ENRICHED)).cast("int")
    months = months.withColumn("run", F.sum(begins).over(by_island))
    run = W.partitionBy(*MATCH_KEY, "island", "run").orderBy("month")
    return months.select(
        *MATCH_KEY,
        F.lit(submission_type).alias("SubmissionType"),
        PERIOD,
        F.col("last.category").alias("MatchCategory"),
        *[F.first(F.col("last.values")[f], ignorenulls=True).over(run).alias(f) for f in fields],
    )


def reconcile_history(rows: DataFrame, seeds: DataFrame, submission_type: str) -> History:
    """Reconcile the rows of all months with those of the month before.

    ``rows`` have the columns of a registry's ``submitted`` rows with the fields
    as columns; ``seeds`` are clean baselines with their month. The result is
    what loading the months one after the other gives. However many months there
    are, rows are matched twice: for their flags, and for verified values.
    """
    rows = _keyed(rows, F.col(PERIOD)).drop(PERIOD)
    flagged = mark_duplicates(
        rows, duplicate_keys(rows), amount_of(rows, BALANCE), FILE_ORDER, "RawRecordID"
    )
    names = [*MATCH_KEY, DATE, *FILE_ORDER, *hash_fields(submission_type)]
    kept = _plain(flagged.filter(~F.col("IsDuplicate")).select(*names))
    prior = _keyed(kept, _next(F.col(PERIOD))).drop(PERIOD)

    def matched(clean: DataFrame) -> DataFrame:
        return reconcile(
            rows, prior, clean, submission_type, order=FILE_ORDER, record_id="RawRecordID", normalize=False
        )

    nothing = prior.limit(0).select(*MATCH_KEY, *hash_fields(submission_type))
    states = clean_states(_plain(matched(nothing)), seeds, submission_type)
    clean = _keyed(states, _next(F.col(PERIOD))).drop(PERIOD, "MatchCategory")
    tagged = _plain(matched(clean))
    # A key is open from the month after its first exception on.
    first = F.min(F.when(F.col("Route") == "unl_output", F.col(PERIOD))).over(W.partitionBy(*MATCH_KEY))
    opened = F.coalesce(first < F.col(PERIOD), F.lit(False))
    tagged = tagged.withColumn("InOpenUnl", F.col("InOpenUnl") | opened)
    return History(tagged.withColumn("ExceptionCategory", exception_category()), states)


def replay(registry: Registry, submission_type: str) -> History:
    """The history of a registry's committed submissions and seeds, all months together."""
    fields = hash_fields(submission_type)
    of_type = F.col("SubmissionType") == submission_type
    loaded = registry.committed("submissions").select("SubmissionID", "BatchID")
    rows = unpack(
        registry.committed("submitted")
        .filter(of_type)
        .join(F.broadcast(loaded), ["SubmissionID", "BatchID"], "left_semi")
        .drop("RawPayload", "Malformed", "IdentityKey", "BatchID"),
        fields,
    )
    seeds = registry.committed("clean").filter(of_type & (F.col("MatchCategory") == CLEAN_SEED))
    seeds = unpack(seeds.drop("SequenceNumber", "PartName", "BlockStart"), fields)
    return reconcile_history(rows, seeds, submission_type)
