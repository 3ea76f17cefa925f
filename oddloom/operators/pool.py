"""Scan scope: freshness, unions and per-bookmaker statistics of a quote pool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MAX_AGE_S
from ..functions import text
from ..schemas import as_quotes


def age_seconds(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1e6)


def fresh_only(quotes: DataFrame, as_of: Column, max_age_s: float = MAX_AGE_S) -> DataFrame:
    """Drop quotes older than ``max_age_s``.

    Written as a bound on the bare column so that the filter reaches the scan.
    """
    floor = as_of.cast("timestamp") - F.make_dt_interval(secs=F.lit(max_age_s).cast("decimal(18,6)"))
    return quotes.filter(F.col("scraped_at") >= floor)


def prematch_only(quotes: DataFrame, as_of: Column, grace_minutes: float = 0.0) -> DataFrame:
    """Matches that start strictly after ``as_of`` plus the grace."""
    cutoff = as_of.cast("timestamp") + F.make_dt_interval(
        secs=F.lit(grace_minutes * 60).cast("decimal(18,6)")
    )
    return quotes.filter(F.col("start_time") > cutoff)


def latest_contribution(batches: DataFrame, batch: str = "batch_ts") -> DataFrame:
    """Only each bookmaker's most recent batch; older quotes vanish.

    The newest batch per bookmaker is one small row each, sent to the big table,
    which is filtered where it lies: dealt out by bookmaker and batch, all of it
    would be written to disk on few keys before that row count is known.
    """
    newest = batches.groupBy("bookmaker").agg(F.max(batch).alias(batch))
    return batches.join(F.broadcast(newest), ["bookmaker", batch], "left_semi")


def pool_stats(quotes: DataFrame, as_of: Column, max_age_s: float = MAX_AGE_S) -> DataFrame:
    """Count, fresh count, last update and its age per bookmaker."""
    fresh = age_seconds(as_of, F.col("scraped_at")) <= max_age_s
    return (
        quotes.groupBy("bookmaker")
        .agg(
            F.count("*").alias("count"),
            F.count_if(fresh).alias("fresh_count"),
            F.max("scraped_at").alias("last_update"),
        )
        .withColumn("age_s", age_seconds(as_of, F.col("last_update")))
        .orderBy("bookmaker")
    )


def pool_union(pools: list[DataFrame], exclude: list[str] | None = None) -> DataFrame:
    """All contributions as one pool, without the excluded bookmakers."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pools)
    return merged.filter(~F.col("bookmaker").isin(exclude)) if exclude else merged


def operator_of(df: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """Add the owner group of every bookmaker."""
    return df.withColumn("operator", text.operator_of(F.col("bookmaker"), groups))


def scan_stats(quotes: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row of headline counts of a scan."""
    found = ranked.agg(
        F.struct(F.count_if(F.col("is_arbitrage")).alias("arbitrages"), F.count("*").alias("combos"))
    ).scalar()
    return quotes.agg(
        F.count_distinct("match_id").alias("matches_analysed"),
        F.array_join(F.sort_array(F.collect_set("bookmaker")), ",").alias("bookmakers"),
        F.count_distinct("bookmaker").alias("bookmakers_count"),
    ).select("*", found["arbitrages"].alias("arbitrages"), found["combos"].alias("combos"))


def reject_report(scan_log: DataFrame) -> DataFrame:
    """Outcome counts of a scan per bookmaker."""
    return scan_log.groupBy("bookmaker", "status").agg(F.count("*").alias("n"))


def branded_feed_union(parse, raws: dict[str, DataFrame]) -> DataFrame:
    """One feed layout published under several brands."""
    return pool_union([as_quotes(parse(raw, bookmaker=brand)) for brand, raw in raws.items()])
