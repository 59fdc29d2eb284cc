"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

_MODULES = ["q_files", "q_graph", "q_labels", "q_split", "q_eval", "q_context", "q_report", "q_sources"]


def all_queries():
    from reposcope.plans import catalog
    for m in _MODULES:
        importlib.import_module(f"reposcope.plans.{m}")
    return dict(catalog.REGISTRY)
