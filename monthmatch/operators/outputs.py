"""The six outputs of a reconciliation, as views of the tagged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.fixed_values import FACILITY_TYPE, FILE_PLACE, REPORT_HEADINGS
from monthmatch.functions.text import quoted

_DEDUP = ("CompositeKey", "ThisRowBalance", "KeptBalance", "DedupReason")
_MATCH = (
    "CompositeKey",
    "MatchFlag",
    "Rearranged",
    "FieldDifferences",
    "AddedFields",
    "ChangedFields",
    "RemovedFields",
)
# Everything a reconciliation adds to the submitted columns.
TAGS = frozenset(
    (
        *_DEDUP,
        *_MATCH,
        "IsDuplicate",
        "KeptOverThisRecordID",
        "PreviousDate",
        "CurrentDate",
        "DateChanged",
        "InClean",
        "InOpenUnl",
        "Route",
        "ExceptionCategory",
        "Source",
        "Published",
        FILE_PLACE,
    )
)


def submitted_columns(tagged: DataFrame) -> list[str]:
    return [c for c in tagged.columns if c not in TAGS]


def output_parts(tagged: DataFrame) -> dict[str, tuple[Column, list[Column]]]:
    """Of each of the six outputs which rows of ``tagged`` it has, and its columns."""
    own = [quoted(c) for c in submitted_columns(tagged)]
    fields = tagged.schema["Published"].dataType.fieldNames()
    published = [
        F.col("Published")[c].alias(c) if c in fields else quoted(c) for c in submitted_columns(tagged)
    ]
    kind = [F.col(FACILITY_TYPE)] if FACILITY_TYPE in tagged.columns else []
    match = [F.col(c) for c in _MATCH]
    parts = {
        "dedup_log": [*own, *map(F.col, _DEDUP), F.col("KeptOverThisRecordID")],
        "date_change_log": [*map(F.col, ("IdentityKey", "PreviousDate", "CurrentDate")), *kind],
        "cleaned_output": [*published, *match, F.col("Source")],
        "rearranged_output": [*published, *match, F.col("Source")],
        "enriched_output": [*published, *match, F.col("Source")],
        "unl_output": [*own, *match, F.col("ExceptionCategory")],
    }
    return {
        name: (F.col("DateChanged") if name == "date_change_log" else F.col("Route") == name, columns)
        for name, columns in parts.items()
    }


def outputs(tagged: DataFrame) -> dict[str, DataFrame]:
    """Six frames. Each is a filter on ``tagged``; write or persist that first
    if more than one of them is going to be evaluated."""
    return {name: tagged.filter(rows).select(*columns) for name, (rows, columns) in output_parts(tagged).items()}


def dedup_log(tagged: DataFrame) -> DataFrame:
    return outputs(tagged)["dedup_log"]


def date_change_log(tagged: DataFrame) -> DataFrame:
    return outputs(tagged)["date_change_log"]


def unl_output(tagged: DataFrame) -> DataFrame:
    return outputs(tagged)["unl_output"]


def report_headings(output: DataFrame) -> list[str]:
    """The names of an output's columns in the exported files."""
    return [REPORT_HEADINGS.get(c, c) for c in output.columns]
