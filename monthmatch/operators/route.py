"""Where each classified record goes, and with which values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthmatch.fixed_values import (
    CATEGORY_CARRYOVER,
    CATEGORY_DIFFERENT,
    CATEGORY_EXACT_NOT_FOUND,
    CATEGORY_NO_MATCH,
    CATEGORY_REARRANGED_NOT_FOUND,
    DIFFERENT,
    ENRICHED,
    EXACT,
    MATCH_KEY,
    NO_MATCH,
    REARRANGED,
    SOURCE_CARRIED,
    SOURCE_ENRICHED,
    SOURCE_REARRANGED,
    hash_fields,
)

# (match flag, in clean) -> output. Enriched rows go out as submitted, whether
# or not there are verified values.
ROUTES = {
    (EXACT, True): "cleaned_output",
    (EXACT, False): "unl_output",
    (REARRANGED, True): "rearranged_output",
    (REARRANGED, False): "unl_output",
    (ENRICHED, True): "enriched_output",
    (ENRICHED, False): "enriched_output",
    (DIFFERENT, True): "unl_output",
    (DIFFERENT, False): "unl_output",
    (NO_MATCH, True): "unl_output",
    (NO_MATCH, False): "unl_output",
}
# match flag -> category in the exception queue, and that of an open exception
CATEGORIES = {
    EXACT: (CATEGORY_EXACT_NOT_FOUND, CATEGORY_CARRYOVER),
    REARRANGED: (CATEGORY_REARRANGED_NOT_FOUND, CATEGORY_CARRYOVER),
    DIFFERENT: (CATEGORY_DIFFERENT, CATEGORY_DIFFERENT),
    NO_MATCH: (CATEGORY_NO_MATCH, CATEGORY_NO_MATCH),
}
SOURCES = {
    "cleaned_output": SOURCE_CARRIED,
    "rearranged_output": SOURCE_REARRANGED,
    "enriched_output": SOURCE_ENRICHED,
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    """``table[key]`` as a literal map: the key expression appears only once."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _text(value: bool) -> str:
    return "true" if value else "false"


def in_clean() -> Column:
    return F.col("Clean").isNotNull()


def route() -> Column:
    """Name of the one output that receives the row."""
    table = {f"{flag}/{_text(clean)}": name for (flag, clean), name in ROUTES.items()}
    key = F.concat("MatchFlag", F.lit("/"), in_clean().cast("string"))
    return F.when(F.col("IsDuplicate"), F.lit("dedup_log")).otherwise(_looked_up(table, key))


def exception_category() -> Column:
    table = {
        f"{flag}/{_text(is_open)}": category
        for flag, categories in CATEGORIES.items()
        for is_open, category in zip((False, True), categories, strict=True)
    }
    key = F.concat("MatchFlag", F.lit("/"), F.col("InOpenUnl").cast("string"))
    return F.when(F.col("Route") == "unl_output", _looked_up(table, key))


def earlier_unl(df: DataFrame, sequence: str, heavy: bool = False) -> DataFrame:
    """Count a key as open if a lower sequence of the same period queued it.

    Files of one period are reconciled together, while a later sequence has to
    see the exceptions of the earlier ones. The lowest queued sequence per key
    decides that. For heavy keys it is a partially aggregated minimum (one row
    per key) broadcast back; otherwise a window on the distribution in place.
    """
    queued = F.min(F.when(F.col("Route") == "unl_output", F.col(sequence)))
    if heavy:
        lowest = df.groupBy(*MATCH_KEY).agg(queued.alias("_lowest"))
        df = df.join(F.broadcast(lowest), list(MATCH_KEY), "left")
    else:
        df = df.withColumn("_lowest", queued.over(W.partitionBy(*MATCH_KEY)))
    opened = F.coalesce(F.col("_lowest") < F.col(sequence), F.lit(False))
    return df.withColumn("InOpenUnl", F.col("InOpenUnl") | opened).drop("_lowest")


def published_fields(fields: Sequence[str]) -> Column:
    """The values a published row gets: verified ones if carried forward, else its own.

    A blank verified value replaces the current one, a missing one does not.
    """
    values = ", ".join(f"coalesce(_verified.`{f}`, `{f}`) AS `{f}`" for f in fields)
    return F.expr(f"IF(Source IS NULL, NULL, struct({values}))")


def routed(
    df: DataFrame, submission_type: str, sequence: str | None = None, heavy: bool = False
) -> DataFrame:
    """Add route, category, provenance and published values; drop the lookups.

    ``sequence`` names the file order within the period, if there are several
    files.
    """
    df = df.withColumns({"InClean": in_clean(), "Route": route()})
    if sequence is not None:
        df = earlier_unl(df, sequence, heavy)
    carried = F.col("Route").isin("cleaned_output", "rearranged_output")
    df = df.withColumns(
        {
            "ExceptionCategory": exception_category(),
            "Source": _looked_up(SOURCES, F.col("Route")),
            "_verified": F.when(carried, F.col("Clean")),
        }
    )
    published = published_fields(hash_fields(submission_type))
    return df.withColumn("Published", published).drop("Clean", "_verified")
