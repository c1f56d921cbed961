"""Tables that cut lineage; the engine keeps them in the same way."""

from __future__ import annotations

from ..sources.scratch import Scratch, shared_folder, table

__all__ = ["Scratch", "shared_folder", "table"]
