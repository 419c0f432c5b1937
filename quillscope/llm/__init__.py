"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` registers what it
offers with the repository's entry module.
"""

from ._store import free_name, release, stash

__all__ = ["free_name", "release", "stash"]
