"""End-to-end jobs, serving queries and the registered query catalogue."""


def load_registry():
    """Import every query module (they self-register) and return the registry."""
    from . import queries_enrich, queries_fixed, queries_gold, queries_jobs, queries_lake, queries_ml, queries_serving, queries_silver, registry  # noqa: F401

    return registry
