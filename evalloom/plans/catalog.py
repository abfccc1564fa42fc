"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from evalloom.registry import ORACLE, QUERIES, QueryFn

MODULES = ("q_ledger", "q_panel", "q_checks", "q_sampling", "q_reports", "q_logs", "q_sources", "q_similarity", "q_scalar", "q_archive", "q_geometry", "q_streams")


def load() -> dict[str, QueryFn]:
    for module in MODULES:
        importlib.import_module(f"evalloom.plans.{module}")
    return QUERIES


__all__ = ["ORACLE", "QUERIES", "load"]
