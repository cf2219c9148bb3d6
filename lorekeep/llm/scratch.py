"""Tables in the shared folder, and what Python workers get at once."""

from __future__ import annotations

from ..sources.shared import BATCH_BYTES, BATCH_ROWS, bounded_batches, new_path, shared_folder, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "bounded_batches", "new_path", "shared_folder", "written"]
