"""Named queries over the tables, one module for each workload."""

from importlib import import_module

MODULES = ("retrieval", "metrics", "conversation", "graph", "store", "sampling", "extraction", "requests", "code", "memory", "json_results", "index", "vault_requests", "reindex", "terminal", "sessions", "sql_surface", "patching", "planning")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
