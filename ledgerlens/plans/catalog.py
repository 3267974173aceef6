"""Import every query module so the registry is complete."""

from ledgerlens.plans import q_checks, q_files, q_grid, q_offsets, q_reconcile, q_results, q_sinks, q_text, q_units, q_views  # noqa: F401
from ledgerlens.plans.registry import QUERIES

__all__ = ["QUERIES"]
