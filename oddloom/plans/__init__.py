"""Queries of every operator family, with the SQL that checks them."""

from importlib import import_module

MODULES = [
    "pool_plans", "arbitrage_plans", "stake_plans", "scout_plans", "alert_plans", "history_plans", "membership_plans", "quality_plans", "source_plans", "normalize_plans", "resolve_plans", "boost_plans", "stream_plans", "sink_plans",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
