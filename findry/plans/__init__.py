"""Registered queries: each a plan over the given tables, with its check in SQL."""

from findry.plans import (  # noqa: F401
    dataset,
    files,
    flows,
    measures,
    prompts,
    search,
    streams,
    text,
    training,
)
from findry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
