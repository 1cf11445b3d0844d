"""Cutting lineage on storage that all executors share."""

from ..sources.shared import checkpointed as saved
from ..sources.shared import fresh_path

__all__ = ["fresh_path", "saved"]
