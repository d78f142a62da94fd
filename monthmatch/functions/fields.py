"""Type-specific fields packed into one map column and unpacked again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.fixed_values import hash_fields
from monthmatch.functions.text import or_blank, quoted


def pack(df: DataFrame, submission_type: str) -> Column:
    """The hash fields the frame has, as ``map<name, value>``."""
    pairs: list[Column] = []
    for field in hash_fields(submission_type):
        if field in df.columns:
            pairs += [F.lit(field), or_blank(quoted(field).cast("string"))]
    return F.create_map(*pairs)


def unpack(df: DataFrame, names: Iterable[str], packed: str = "IdentityFields") -> DataFrame:
    """Replace the packed map (or its JSON text) by one column per field."""
    if df.schema[packed].dataType.typeName() == "string":
        df = df.withColumn(packed, F.from_json(packed, "map<string,string>"))
    return df.withColumns({n: F.col(packed)[n] for n in names}).drop(packed)
