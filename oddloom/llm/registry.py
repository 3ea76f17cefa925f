"""Registered queries of this subpackage: name -> job, and name -> checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

_JOBS: dict[str, Job] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def keep(job: Job) -> Job:
        _JOBS[name] = job
        if sql is not None:
            _SQL[name] = sql.strip()
        return job

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def jobs() -> dict[str, Job]:
    from . import queries  # noqa: F401

    return dict(_JOBS)


def checks() -> dict[str, str]:
    from . import queries  # noqa: F401

    return dict(_SQL)
