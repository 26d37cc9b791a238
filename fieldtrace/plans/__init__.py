"""Queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ("ot_queries", "it_queries", "behavior_queries", "alert_queries", "intel_queries", "web_queries", "capture_queries",
           "store_queries")


def all_queries():
    from fieldtrace.plans import registry
    for module in MODULES:
        importlib.import_module(f"fieldtrace.plans.{module}")
    return registry.QUERIES, registry.ORACLES
