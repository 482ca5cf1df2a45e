"""Jobs over the given tables: derived views and the checked queries."""

from importlib import import_module

_MODULES = (
    "mutation_queries", "event_queries", "typed_queries", "registry_queries", "catalog_queries", "storage_queries",
    "file_queries", "table_queries",
)


def load() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
