"""Dates, amounts, periods and submission names parsed from text.

Nothing here raises on bad data: what cannot be parsed is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthmatch.fixed_values import (
    DATE_COMPACT,
    DATE_DAY_NAMED_MONTH,
    DATE_NAMED_MONTH_DAY,
    DATE_YEAR_FIRST,
    DATE_YEAR_LAST,
    DATE_YEAR_NAMED_MONTH,
    FILE_NAME_PATTERN,
    LAST_CENTURY_FROM,
    MONTHS,
    NULL_AMOUNT_WORDS,
)
from monthmatch.functions.text import quoted, strip

# A plain number; keeps Java's own literals ("1d", "NaN") out of the cast.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_date(column: Column) -> Column:
    """A date in one of the listed forms, else null.

    The form decides where year, month and day stand; they are put together in
    one way and read once.
    """
    text = strip(column.cast("string"))
    # A T before a digit begins a time of day, any other one belongs to a month's name.
    parts = F.split(text, r"[-/., ]+|T(?=\d)", 4)
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))

    def month(name: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("string")

    def full(year: Column) -> Column:
        century = F.when(year.cast("int") >= LAST_CENTURY_FROM, F.lit("19")).otherwise(F.lit("20"))
        return F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year)

    def day(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    written = (
        F.when(
            text.rlike(DATE_COMPACT),
            day(F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
        )
        .when(text.rlike(DATE_YEAR_FIRST), day(first, second, third))
        .when(
            text.rlike(DATE_YEAR_LAST),
            F.when((first.cast("int") > 31) & (F.length(third) == 2), day(full(first), second, third))
            .when(first.cast("int") <= 12, day(full(third), first, second))
            .otherwise(day(full(third), second, first)),
        )
        .when(text.rlike(DATE_DAY_NAMED_MONTH), day(full(third), month(second), first))
        .when(text.rlike(DATE_NAMED_MONTH_DAY), day(full(third), month(first), second))
        .when(text.rlike(DATE_YEAR_NAMED_MONTH), day(first, month(second), third))
    )
    return written.try_cast("date")


def date_of(df: DataFrame, name: str) -> Column:
    """The named column as a date, parsed only if it is not one already."""
    if isinstance(df.schema[name].dataType, T.DateType):
        return quoted(name)
    return parse_date(quoted(name))


def _amount_text(column: Column) -> Column:
    text = strip(column.cast("string"))
    plain = F.replace(F.when(~F.lower(text).isin(*NULL_AMOUNT_WORDS), text), F.lit(","), F.lit(""))
    return F.when(plain.rlike(_NUMBER), plain)


def parse_amount(column: Column) -> Column:
    """An amount as stored: two decimals, thousands separators dropped."""
    return _amount_text(column).try_cast("decimal(18,2)")


def amount_of(df: DataFrame, name: str) -> Column:
    """The named column as a double, at full precision, for comparing balances."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return quoted(name).cast("double")
    return _amount_text(quoted(name)).try_cast("double")


def previous_period(column: Column) -> Column:
    """The month before ``yyyy-MM``, across year ends."""
    return F.date_format(F.add_months(F.to_date(column, "yyyy-MM"), -1), "yyyy-MM")


def name_parts(name: Column) -> Column:
    """Subscriber, month, year, type and sequence of a submission's name; one item if it is not one."""
    marked = F.regexp_replace(name, FILE_NAME_PATTERN, "$1\x01$2\x01$3\x01$4\x01$5")
    return F.split(marked, "\x01", -1)


def submission_from(parts: Column) -> Column:
    """The submission that :func:`name_parts` names, as a struct; null if there is none."""
    code, month, year, kind, sequence = (F.get(parts, F.lit(i)) for i in range(5))
    number = F.when(sequence == "", F.lit(1).cast("bigint")).otherwise(sequence.try_cast("bigint"))
    return F.when(
        (F.size(parts) == 5) & number.isNotNull(),
        F.struct(
            F.upper(code).alias("SubscriberCode"),
            F.concat(F.lit("20"), year, F.lit("-"), month).alias("ReportingPeriod"),
            F.upper(kind).alias("SubmissionType"),
            number.alias("SequenceNumber"),
        ),
    )


def submission_of(name: Column) -> Column:
    """``<CODE><MMYY>_<IND|BUS>[_<SEQ>]`` as a struct; null if it is not one.

    The name may end in a file extension. Text after the sequence number, a
    month outside 1..12 or a sequence beyond 64 bits makes the name invalid.
    """
    return submission_from(name_parts(name))
