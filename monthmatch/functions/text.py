"""Text cleaning, keys and hashes as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthmatch.fixed_values import DELIMITER, IDENTITY_KEY, hash_fields

# Every Unicode character that counts as white space when text is stripped;
# SQL trim alone removes only the plain space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def quoted(name: str) -> Column:
    """A column by its exact name, even if the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITE_SPACE))


def or_blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def field_or_blank(df: DataFrame, name: str) -> Column:
    """The named column as text with null as ``""``; ``""`` if it is absent."""
    return or_blank(quoted(name).cast("string")) if name in df.columns else F.lit("")


def joined(columns: Iterable[Column]) -> Column:
    """Values joined by the delimiter; a null keeps its (empty) slot."""
    return F.concat_ws(DELIMITER, *[or_blank(c) for c in columns])


def concat_fields(df: DataFrame, names: Iterable[str]) -> Column:
    return joined([field_or_blank(df, name) for name in names])


def filled(name: str) -> Column:
    """The named column as text with null as ``""``."""
    return or_blank(quoted(name).cast("string"))


def normalized(name: str) -> Column:
    """The named column with null as ``""``, stripped, in upper case."""
    escaped = name.replace("`", "``")
    return F.expr(f"upper(btrim(coalesce(CAST(`{escaped}` AS STRING), ''), '{WHITE_SPACE}'))")


def normalize_fields(df: DataFrame, submission_type: str) -> DataFrame:
    """Normalise the identity and contact fields the frame has, in one select."""
    names = df.columns
    return df.withColumns({f: normalized(f) for f in hash_fields(submission_type) if f in names})


def identity_key() -> Column:
    return joined([F.col(c) for c in IDENTITY_KEY])


def content_hash(df: DataFrame, submission_type: str) -> Column:
    """SHA-256 over the delimited identity and contact fields."""
    return F.sha2(concat_fields(df, hash_fields(submission_type)), 256)


def surrogate_id(*columns: Column) -> Column:
    """A 60-bit id derived from a natural key.

    Being a pure function of the key it needs no counter, no global ordering
    and no coordination, and a recomputed task yields the same id again.
    """
    digest = F.sha2(joined([c.cast("string") for c in columns]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stringify(df: DataFrame, name: str) -> Column:
    """A typed cell as text: no trailing ``.0``, no scientific notation.

    A whole number is written as its digits (up to the 38 a decimal holds),
    any other number in its shortest form, a null or NaN as ``""``.
    """
    column = quoted(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.FloatType):
        column = column.cast("string").cast("double")
    elif not isinstance(kind, T.DoubleType):
        return strip(or_blank(column.cast("string")))
    digits = column.try_cast("decimal(38,0)").cast("string")
    return (
        F.when(column.isNull() | F.isnan(column), F.lit(""))
        .when((column % 1 == 0) & digits.isNotNull(), digits)
        .otherwise(_shortest(column))
    )


def text_cells(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The frame with those of the named columns that hold floats turned to text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    floats = [n for n in names if isinstance(kinds.get(n), (T.DoubleType, T.FloatType))]
    return df.withColumns({n: stringify(df, n) for n in floats}) if floats else df


def _shortest(column: Column) -> Column:
    text = column.cast("string")
    # Spark turns to an exponent outside 1e-3..1e7; down to 1e-4 the value is
    # written out, below it as 1.5e-05.
    plain = F.rtrim(text.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E-(\d+)$", 1)
    small = F.concat(
        mantissa, F.lit("e-"), F.when(F.length(exponent) < 2, F.lit("0")).otherwise(F.lit("")), exponent
    )
    return (
        F.when(~text.contains("E"), text)
        .when(F.abs(column) < 1e-4, small)
        .otherwise(F.coalesce(plain, text))
    )
