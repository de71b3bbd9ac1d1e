"""Intermediate tables and bounded Arrow batches, as the rest of the library has them."""

from __future__ import annotations

from corpusloom.sources.shared import BATCH_BYTES, bounded_batches, frugal, materialize, new_path, shared_dir

__all__ = ["BATCH_BYTES", "bounded_batches", "frugal", "materialize", "new_path", "shared_dir"]
