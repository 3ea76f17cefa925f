"""Near misses, their trajectory, and what the opportunities are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import NEAR_HIGH, NEAR_LOW, TRAJECTORY_KEEP
from .arbitrage import best_combos, with_margin

TRAJECTORY_KEY = ["match_id", "market_type", "line", "legs_key"]


def near_misses(quotes: DataFrame, low: float = NEAR_LOW, high: float = NEAR_HIGH) -> DataFrame:
    """Q01: best combinations with low <= M < high, owners not considered."""
    return with_margin(best_combos(quotes)).filter((F.col("margin") >= low) & (F.col("margin") < high))


def legs_key(legs: Column) -> Column:
    """Who takes which side, sorted: the part of the tracking key without prices."""
    return F.array_join(
        F.array_sort(F.transform(legs, lambda leg: F.concat_ws(":", leg["bookmaker"], leg["selection"]))), "+"
    )


def margin_trajectory(observations: DataFrame, keep: int = TRAJECTORY_KEEP) -> DataFrame:
    """Q02: the last ``keep`` margins per tracked key and whether they improve.

    ``observations`` has the key columns, ``ts`` and ``margin``. The rank
    limit also runs before the shuffle, so a long history is cut early.
    """
    recent = Window.partitionBy(*TRAJECTORY_KEY).orderBy(F.desc("ts"), F.desc("margin"))
    points = (
        observations.select(*TRAJECTORY_KEY, "ts", "margin")
        .withColumn("rank", F.row_number().over(recent))
        .filter(F.col("rank") <= keep)
        .groupBy(*TRAJECTORY_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("ts", "margin"))).alias("points"))
    )
    return points.withColumn("is_improving", improving(F.col("points")))


def improving(points: Column) -> Column:
    last = F.element_at(points, -1)["margin"]
    return (F.size(points) >= 2) & (last < points[0]["margin"])


def hot_markets(opportunities: DataFrame, top_n: int = 5) -> DataFrame:
    """Q03: market types with the most opportunities."""
    counts = opportunities.groupBy("market_type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "market_type").limit(top_n)


def leg_counts(opportunities: DataFrame) -> DataFrame:
    return (
        opportunities.select(F.explode("legs").alias("leg"))
        .groupBy(F.col("leg.bookmaker").alias("bookmaker")).agg(F.count("*").alias("n"))
    )


def hot_bookmakers(opportunities: DataFrame, top_n: int = 5) -> DataFrame:
    """Q04: bookmakers with the most legs."""
    return leg_counts(opportunities).orderBy(F.desc("n"), "bookmaker").limit(top_n)


def scrape_priority(opportunities: DataFrame) -> DataFrame:
    """Q05: each bookmaker's share of all legs."""
    counts = leg_counts(opportunities)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("bookmaker", (F.col("n") / total).alias("share"))


def template_explanation(opportunities: DataFrame) -> DataFrame:
    """Q06: the fixed multi-line text of an opportunity."""
    lines = F.transform(
        "legs",
        lambda leg: F.format_string(
            "- %s @ %s chez %s : %.0f HTG", leg["selection"], leg["odds"].cast("string"), leg["bookmaker"],
            F.bround(leg["stake"], 0)),
    )
    head = F.array(
        F.format_string("Surebet %.1f%% sur %s (%s).", F.bround("roi_pct", 1), "match_label", "market_type"),
        F.format_string("Profit garanti : %.0f HTG pour %.0f HTG mises.", F.bround("profit", 0), F.bround("bankroll", 0)),
    )
    text = F.array_join(F.concat(head, lines, F.array(F.lit("Fè vit, kòt yo ka chanje!"))), "\n")
    return opportunities.withColumn("explanation", text)
