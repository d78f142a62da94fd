"""Field-by-field comparison of a record with its predecessor.

The results are SQL conditions over the fields of the current row and of a
struct with the previous ones. ``concat_ws`` skips nulls, so a list of the
fields that meet a condition needs neither an array nor a lambda and the
projection stays in generated code. Both sides hold normalised values: never
null, without white space around them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthmatch.fixed_values import DELIMITER, IDENTITY_FIELDS, hash_fields


class FieldComparison:
    """Comparison expressions for one submission type."""

    def __init__(self, submission_type: str, previous: str = "Prior"):
        self.fields = hash_fields(submission_type)
        self.group = IDENTITY_FIELDS[submission_type]
        self.previous = previous

    def _old(self, field: str) -> str:
        return f"`{self.previous}`.`{field}`"

    def _differs(self, field: str) -> str:
        return f"`{field}` <> {self._old(field)}"

    def _names_where(self, condition: Callable[[str], str]) -> Column:
        names = ", ".join(f"IF({condition(f)}, '{f}', NULL)" for f in self.fields)
        return F.expr(f"concat_ws(', ', {names})")

    def same(self) -> Column:
        """Equal content: the delimited texts, which is what the hash covers."""
        now = ", ".join(f"`{f}`" for f in self.fields)
        old = ", ".join(self._old(f) for f in self.fields)
        return F.expr(f"concat_ws('{DELIMITER}', {now}) = concat_ws('{DELIMITER}', {old})")

    def differing(self) -> Column:
        return self._names_where(self._differs)

    def added(self) -> Column:
        return self._names_where(lambda f: f"{self._old(f)} = '' AND `{f}` <> ''")

    def removed(self) -> Column:
        return self._names_where(lambda f: f"{self._old(f)} <> '' AND `{f}` = ''")

    def changed(self) -> Column:
        return self._names_where(
            lambda f: f"{self._old(f)} <> '' AND `{f}` <> '' AND {self._differs(f)}"
        )

    def only_added(self) -> Column:
        """No field that had a value has another one now, or none."""
        kept = [f"({self._old(f)} = '' OR NOT ({self._differs(f)}))" for f in self.fields]
        return F.expr(" AND ".join(kept))

    def text(self) -> Column:
        """``Field: 'old' -> 'new'`` for every differing field."""
        parts = ", ".join(
            f"""IF({self._differs(f)}, concat("{f}: '", {self._old(f)}, "' -> '", `{f}`, "'"), NULL)"""
            for f in self.fields
        )
        return F.expr(f"concat_ws('; ', {parts})")

    def rearranged(self) -> Column:
        """Some identity values moved between fields and nothing else happened.

        Both sides have the same number of identity fields, so comparing the
        sorted values with blanks included is comparing the non-blank values
        as multisets.
        """
        now = ", ".join(f"`{f}`" for f in self.group)
        old = ", ".join(self._old(f) for f in self.group)
        moved = " OR ".join(self._differs(f) for f in self.group)
        others = [f"NOT ({self._differs(f)})" for f in self.fields if f not in self.group]
        same_values = f"sort_array(array({now})) = sort_array(array({old}))"
        return F.expr(" AND ".join([f"({moved})", *others, same_values]))
