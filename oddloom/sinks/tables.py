"""Where results are kept: history, caches, snapshots, report files, alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..operators.alerts import alert_text, drop_exact_duplicates, should_alert
from ..operators.history import report_columns


def append_history(rows: DataFrame, path: str, history: DataFrame | None = None) -> None:
    """Append detections, partitioned by sport and day; known ones are skipped."""
    new = drop_exact_duplicates(rows, history) if history is not None else rows
    new.withColumn("date", F.to_date("date_detection")).write.mode("append").partitionBy("sport", "date").parquet(path)


def cache_insert_if_absent(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with mappings of new keys added, existing ones untouched."""
    first = new.groupBy("cache_key").agg(
        F.min(F.struct(*[c for c in cache.columns if c != "cache_key"])).alias("m")).select("cache_key", "m.*")
    return cache.unionByName(first.join(cache.select("cache_key"), "cache_key", "left_anti"))


def dated_snapshot(tables: dict[str, DataFrame | None], path: str, day: str) -> DataFrame:
    """Every table as JSON under a dated folder, and the manifest of what was written.

    Rows are counted by the write itself. A table given as None is recorded
    as missing.
    """
    spark = next(df for df in tables.values() if df is not None).sparkSession
    lines = []
    for name, df in tables.items():
        if df is None:
            lines.append((day, name, None, "missing"))
            continue
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{path}/{day}/{name}")
        lines.append((day, name, seen.get["rows"], "saved"))
    manifest = spark.createDataFrame(lines, "day string, name string, rows bigint, status string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/{day}/_manifest")
    return manifest


def snapshots_to_drop(days: DataFrame, keep: int = 8) -> DataFrame:
    """Dated folders beyond the newest ``keep``; only names, a short list."""
    newest = Window.orderBy(F.desc("day"))
    return days.select("day").distinct().withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") > keep).select("day")


def report_file(opportunities: DataFrame, path: str) -> None:
    """The report columns as delimited text with a header."""
    report_columns(opportunities).write.mode("overwrite").option("header", True).csv(path)


def json_rows(rows: DataFrame) -> DataFrame:
    """Every row as one JSON document."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def alert_rows(opportunities: DataFrame, min_roi: float = 3.0, min_score: int = 70, only_bookmaker: str | None = None) -> DataFrame:
    """What is to be delivered: alertable rows over the thresholds, with their text."""
    chosen = should_alert(opportunities.filter("alertable"), min_roi, min_score, only_bookmaker)
    return alert_text(chosen)


def alert_table(opportunities: DataFrame, path: str, **limits) -> None:
    """Append the alerts to the delivery table."""
    alert_rows(opportunities, **limits).write.mode("append").parquet(path)
