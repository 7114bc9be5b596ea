"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from .data import Registered


def registered() -> dict[str, Registered]:
    from . import captures, groups, lines, plans, series, sinks, sqltext, trees

    return {**captures.QUERIES, **groups.QUERIES, **lines.QUERIES, **plans.QUERIES, **series.QUERIES, **sinks.QUERIES, **sqltext.QUERIES, **trees.QUERIES}
