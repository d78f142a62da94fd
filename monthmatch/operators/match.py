"""Matching current records to the previous period and classifying them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.fixed_values import (
    DATE,
    DIFFERENT,
    ENRICHED,
    EXACT,
    IDENTITY_KEY,
    MATCH_KEY,
    NO_MATCH,
    REARRANGED,
    hash_fields,
)
from monthmatch.functions.compare import FieldComparison
from monthmatch.functions.parse import date_of
from monthmatch.functions.text import field_or_blank, filled, normalized, or_blank
from monthmatch.operators.dedup import first_per_key
from monthmatch.operators.skew import only_heavy


@dataclass(frozen=True)
class Lookups:
    """At most one row per key each: prior record, prior clean values, open exception."""

    prior: DataFrame
    clean: DataFrame
    open_unl: DataFrame | None

    def _joined(self, rows: DataFrame, lookup: DataFrame, broadcast: bool) -> DataFrame:
        return rows.join(F.broadcast(lookup) if broadcast else lookup, list(MATCH_KEY), "left")

    def attach_prior(self, rows: DataFrame, broadcast: bool = False) -> DataFrame:
        """Add ``Prior``; no row is lost or multiplied, as the lookup has one per key.

        ``broadcast`` is for lookups already cut down to a bounded key list.
        """
        return self._joined(rows, self.prior, broadcast)

    def attach_clean(self, rows: DataFrame, broadcast: bool = False) -> DataFrame:
        """Add ``Clean`` and ``InOpenUnl`` in the same way."""
        rows = self._joined(rows, self.clean, broadcast)
        if self.open_unl is None:
            return rows.withColumn("InOpenUnl", F.lit(False))
        rows = self._joined(rows, self.open_unl, broadcast)
        return rows.withColumn("InOpenUnl", F.coalesce("InOpenUnl", F.lit(False)))

    def only(self, hashes: Sequence[int]) -> Lookups:
        """The lookups' rows of heavy keys."""

        def kept(lookup: DataFrame) -> DataFrame:
            return only_heavy(lookup, MATCH_KEY, hashes)

        return Lookups(
            kept(self.prior),
            kept(self.clean),
            None if self.open_unl is None else kept(self.open_unl),
        )


def prior_lookup(
    prior_raw: DataFrame,
    submission_type: str,
    order: Sequence[Column | str],
    normalize: bool = True,
) -> DataFrame:
    """``MATCH_KEY`` -> ``Prior`` struct (fields and date) of the first prior row."""
    names = prior_raw.columns
    ready = normalized if normalize else filled
    fields = [
        (ready(f) if f in names else F.lit("")).alias(f) for f in hash_fields(submission_type)
    ]
    first = first_per_key(prior_raw, MATCH_KEY, order)
    return first.select(*MATCH_KEY, F.struct(*fields, date_of(first, DATE).alias(DATE)).alias("Prior"))


def clean_lookup(
    prior_clean: DataFrame, submission_type: str, order: Sequence[Column | str]
) -> DataFrame:
    """``MATCH_KEY`` -> ``Clean`` struct; a field the clean data lacks stays null."""
    names = prior_clean.columns
    fields = ", ".join(
        f"CAST({f'`{f}`' if f in names else 'NULL'} AS STRING) AS `{f}`"
        for f in hash_fields(submission_type)
    )
    return first_per_key(prior_clean, MATCH_KEY, order).select(
        *MATCH_KEY, F.expr(f"struct({fields})").alias("Clean")
    )


def open_unl_lookup(open_unl: DataFrame) -> DataFrame:
    """``MATCH_KEY`` of unresolved exceptions; all are, if there is no such column."""
    if "Resolved" in open_unl.columns:
        open_unl = open_unl.filter(~F.col("Resolved"))
    return open_unl.select(*MATCH_KEY).distinct().withColumn("InOpenUnl", F.lit(True))


def classify(df: DataFrame, submission_type: str) -> DataFrame:
    """Add the match flag and the field-level differences.

    Takes the ``Prior`` struct beside the current fields and drops it. Rows
    marked as duplicates get no flag.
    """
    compare = FieldComparison(submission_type)
    kept = ~F.col("IsDuplicate")
    matched = F.col("Prior").isNotNull()
    df = df.withColumn("_differs", kept & matched & ~compare.same())

    def when_different(value: Column) -> Column:
        return F.when(F.col("_differs"), value)

    df = df.withColumns(
        {
            "Rearranged": F.coalesce(when_different(compare.rearranged()), F.lit(False)),
            "FieldDifferences": or_blank(when_different(compare.text())),
            "AddedFields": or_blank(when_different(compare.added())),
            "ChangedFields": or_blank(when_different(compare.changed())),
            "RemovedFields": or_blank(when_different(compare.removed())),
        }
    )
    flag = (
        F.when(~kept, F.lit(None).cast("string"))
        .when(~matched, F.lit(NO_MATCH))
        .when(~F.col("_differs"), F.lit(EXACT))
        .when(F.col("Rearranged"), F.lit(REARRANGED))
        .when(compare.only_added(), F.lit(ENRICHED))
        .otherwise(F.lit(DIFFERENT))
    )
    return df.withColumn("MatchFlag", flag).drop("_differs", "Prior")


def date_changes(df: DataFrame) -> DataFrame:
    """Add the two dates and whether they differ; informational only.

    A change is logged if there was a date and it is not the same now, also
    when the current one cannot be read.
    """
    previous = F.col("Prior")[DATE]
    current = date_of(df, DATE)
    changed = ~F.col("IsDuplicate") & previous.isNotNull() & ~previous.eqNullSafe(current)
    return df.withColumns(
        {
            "PreviousDate": previous,
            "CurrentDate": current,
            "DateChanged": F.coalesce(changed, F.lit(False)),
        }
    )


def keys_ready(df: DataFrame) -> DataFrame:
    """The identity as non-null text; an absent or null part becomes ``""``.

    All inputs go through this, so that keys agree whatever their types. A date
    given as text is made non-null, too.
    """
    keys = {c: field_or_blank(df, c) for c in IDENTITY_KEY}
    if DATE in df.columns and df.schema[DATE].dataType.typeName() == "string":
        keys[DATE] = field_or_blank(df, DATE)
    return df.withColumns(keys)


def fields_ready(df: DataFrame, submission_type: str, normalize: bool = True) -> DataFrame:
    """Normalised identity and contact fields; an absent one becomes ``""``."""
    names = df.columns
    ready = normalized if normalize else filled
    return df.withColumns(
        {f: ready(f) if f in names else F.lit("") for f in hash_fields(submission_type)}
    )
