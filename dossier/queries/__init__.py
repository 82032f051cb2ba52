"""Registered queries over the given tables, each with its SQL equivalent where SQL can say it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("search", "corpus", "texts", "selection", "citing", "figuring", "layouts")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        part = getattr(import_module(f"dossier.queries.{module}"), name)
        if out.keys() & part.keys():
            raise ValueError(f"query registered twice: {out.keys() & part.keys()}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
