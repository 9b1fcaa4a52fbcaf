"""Queries over the project's tables, and whole operations on written ones."""

from . import core, upkeep  # noqa: F401  both register their queries
