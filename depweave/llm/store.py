"""Intermediate tables in the folder that driver and executors share."""

from depweave.sources.scratch import cut as save
from depweave.sources.scratch import new_path, shared_dir

__all__ = ["new_path", "save", "shared_dir"]
