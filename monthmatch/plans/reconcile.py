"""Reconcile one period's records with the previous period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthmatch.fixed_values import BALANCE, DATE, MATCH_KEY, hash_fields
from monthmatch.functions.parse import amount_of
from monthmatch.functions.text import identity_key, text_cells
from monthmatch.operators.dedup import composite_key, mark_duplicates
from monthmatch.operators.match import (
    Lookups,
    classify,
    clean_lookup,
    date_changes,
    fields_ready,
    keys_ready,
    open_unl_lookup,
    prior_lookup,
)
from monthmatch.operators.route import routed
from monthmatch.operators.skew import HeavyKeys, find_heavy_keys, split

SEQUENCE = "SequenceNumber"
# Scopes of the search for duplicates.
FILE, PERIOD = "file", "period"


def duplicate_keys(df: DataFrame, scope: str = FILE) -> list[str]:
    """What rows must agree in to be duplicates: within one file, or all files of the period."""
    if scope not in (FILE, PERIOD):
        raise ValueError(f"scope is {FILE!r} or {PERIOD!r}, not {scope!r}")
    within = [SEQUENCE] if scope == FILE and SEQUENCE in df.columns else []
    return [*MATCH_KEY, *within, DATE]


def reconcile(
    current: DataFrame,
    prior_raw: DataFrame,
    prior_clean: DataFrame,
    submission_type: str,
    open_unl: DataFrame | None = None,
    *,
    order: Sequence[str] = ("RowOrder",),
    record_id: str | None = None,
    prior_order: Sequence[Column | str] | None = None,
    clean_order: Sequence[Column | str] | None = None,
    heavy: HeavyKeys | None = None,
    normalize: bool = True,
    dedup_scope: str = FILE,
) -> DataFrame:
    """All rows of ``current``, each tagged with what became of it.

    The result has one row per input row: duplicates are flagged, the others
    classified against ``prior_raw`` and routed (``Route``) to one of the
    outputs in :mod:`monthmatch.operators.outputs`. Every frame carries the
    identity as separate columns and holds rows of ``submission_type`` only.
    ``order`` is the file order of the rows and has to be unique in a file;
    the other orders default to it where the frame has those columns.
    ``normalize=False`` says that both sides' fields are normalised already.
    ``dedup_scope`` is where duplicates are looked for: in each file, or in all
    files of the period together.

    Each input is shuffled once, on the identity. The rows of identities in
    ``heavy`` (looked up if not given) stay where they are: what they join
    with is one row per key of a bounded list and is broadcast.
    """
    names = (*MATCH_KEY, *hash_fields(submission_type))
    current, prior_raw, prior_clean = (
        keys_ready(text_cells(df, names)) for df in (current, prior_raw, prior_clean)
    )
    if open_unl is not None:
        open_unl = keys_ready(text_cells(open_unl, MATCH_KEY))
    names = current.columns
    keys = duplicate_keys(current, dedup_scope)
    if heavy is None:
        heavy = find_heavy_keys(current, MATCH_KEY, keys)
    lookups = Lookups(
        prior_lookup(
            prior_raw, submission_type, prior_order or _own(prior_raw, order), normalize
        ),
        clean_lookup(prior_clean, submission_type, clean_order or _own(prior_clean, order)),
        None if open_unl is None else open_unl_lookup(open_unl),
    )

    def tagged(rows: DataFrame, hot: bool) -> DataFrame:
        if not hot:
            rows = rows.repartition(*MATCH_KEY)
        rows = fields_ready(rows, submission_type, normalize)
        rows = mark_duplicates(
            rows,
            keys,
            amount_of(current, BALANCE),
            order,
            record_id or order[-1],
            heavy.records if hot else (),
        )
        found = lookups.only(heavy.identities) if hot else lookups
        rows = date_changes(found.attach_prior(rows, broadcast=hot))
        rows = classify(rows, submission_type)
        rows = found.attach_clean(rows, broadcast=hot)
        rows = routed(rows, submission_type, SEQUENCE if SEQUENCE in names else None, heavy=hot)
        return rows.withColumns({"IdentityKey": identity_key(), "CompositeKey": composite_key()})

    if not heavy.identities:
        return tagged(current, hot=False)
    ordinary, hot = split(current, MATCH_KEY, heavy.identities)
    return tagged(ordinary, hot=False).unionByName(tagged(hot, hot=True))


def _own(df: DataFrame, order: Sequence[str]) -> list[Column | str]:
    """The order columns a lookup frame has; any of its rows if it has none."""
    return [c for c in order if c in df.columns] or [F.lit(0)]
