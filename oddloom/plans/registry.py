"""Registered queries: name -> (job over a data folder, checking SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

_JOBS: dict[str, Job] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a job under its inventory name."""

    def keep(job: Job) -> Job:
        if name in _JOBS:
            raise ValueError(f"{name} is registered twice")
        _JOBS[name] = job
        if sql is not None:
            _SQL[name] = sql.strip()
        return job

    return keep


def with_ctes(*parts: str) -> str:
    """Join common table expressions and a final SELECT into one statement."""
    *ctes, body = [p.strip() for p in parts]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def jobs() -> dict[str, Job]:
    from . import load_all

    load_all()
    return dict(_JOBS)


def checks() -> dict[str, str]:
    from . import load_all

    load_all()
    return dict(_SQL)
