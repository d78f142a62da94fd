"""Month-over-month record reconciliation on PySpark DataFrames."""

from monthmatch.plans.backfill import run_backfill
from monthmatch.plans.batch import process_batch
from monthmatch.plans.reconcile import reconcile
from monthmatch.sources.registry import Registry

__all__ = ["Registry", "process_batch", "reconcile", "run_backfill"]
