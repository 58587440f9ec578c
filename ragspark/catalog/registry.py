"""All registered queries."""

from importlib import import_module

MODULES = ("chunks", "search", "talk", "graphs", "documents", "agents", "stores")


def _merged(attribute):
    merged = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"ragspark.catalog.{name}"), attribute))
    return merged


def queries():
    return _merged("QUERIES")


def oracle_sql():
    return _merged("ORACLE")
