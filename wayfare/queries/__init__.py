"""Every query with its check: a Spark callable and, where SQL can say it, the same in SQL."""

from importlib import import_module

from wayfare.queries.base import ORACLES, QUERIES

for _module in ("basics", "files", "trips", "routes", "profit", "network", "flights", "models",
                "streams"):
    import_module(f"wayfare.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]
