"""Queries over the benchmark tables, each with an independent SQL statement."""

from __future__ import annotations

import importlib

TOPICS = ("archive_queries", "text_queries", "segment_queries", "search_queries", "upkeep_queries")


def load_all() -> None:
    for topic in TOPICS:
        importlib.import_module(f"{__name__}.{topic}")
