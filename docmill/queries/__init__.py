"""Queries over the test tables, with their oracle statements."""

from docmill.registry import Registry

REGISTRY = Registry()

from docmill.queries import core, problems, reports, coverage  # noqa: E402, F401
