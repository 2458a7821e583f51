"""Intermediate tables in the cluster's shared folder; see ``tessella.storage``."""

from tessella.storage import Scratch, close_all, shared_folder

__all__ = ["Scratch", "close_all", "shared_folder"]
