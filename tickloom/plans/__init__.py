"""Every named query of the library but those on training text."""

from tickloom.plans import audits, checks, evaluation, inputs, models, relations, telemetry, timelines  # noqa: F401
from tickloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
