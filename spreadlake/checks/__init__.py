"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = (
    "money_checks", "match_checks", "quote_checks", "alert_checks", "state_checks", "monitor_checks",
    "source_checks", "stream_checks", "scan_checks",
)


def load() -> tuple[dict, dict]:
    """(queries, SQL) after importing every module that registers some."""
    from spreadlake.checks import registry

    for name in MODULES:
        importlib.import_module(f"spreadlake.checks.{name}")
    return registry.QUERIES, registry.ORACLES
