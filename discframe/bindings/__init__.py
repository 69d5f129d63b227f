"""Queries over the driver's tables; importing this package registers them all."""

from discframe.bindings import aggregate, classify, editions, functions, joins, plans, project, sequence, sources, streaming, timeline  # noqa: F401
from discframe.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
