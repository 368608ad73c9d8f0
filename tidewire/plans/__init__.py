"""All named queries."""

from importlib import import_module

_MODULES = ("catalog_reports", "text_columns", "fact_columns", "duplicates", "monitoring", "page_reports", "ingest_plan")


def _load():
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    from . import registry
    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
