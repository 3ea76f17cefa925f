"""Flat history of detections and the reports over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ALERT_SCORE, REPORT_COLUMNS, VERDICT_ERRORS
from ..functions.odds import half_even
from .arbitrage import null_safe
from .running import middle_values, running_sums

DETECTION_KEYS = ["match", "event_a", "cote_a", "event_b", "cote_b", "cote_c"]


def legs_to_wide(opportunities: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Legs as three column groups, the third one NULL for two legs."""
    cols: list[Column] = [F.col(c) for c in (keep or [])]
    cols += [
        F.col("detected_at").alias("date_detection"), F.col("match_label").alias("match"), F.col("sport"),
        F.col("match_date"), F.col("n_outcomes").alias("n_issues"),
    ]
    for i, tag in enumerate("abc"):
        leg = F.get(F.col("legs"), F.lit(i))
        cols += [
            leg["bookmaker"].alias(f"bookmaker_{tag}"), leg["event_label"].alias(f"event_{tag}"),
            leg["odds"].alias(f"cote_{tag}"), leg["stake"].alias(f"mise_{tag}"), leg["url"].alias(f"url_{tag}"),
        ]
    cols += [
        F.col("margin").alias("marge_m"), F.col("roi_pct"), F.col("profit"), F.col("bankroll").alias("init_balance"),
        (F.col("bankroll") + F.col("profit")).alias("final_balance"), F.col("score_ia"), F.col("explanation"),
        F.col("status").alias("statut"),
    ]
    return opportunities.select(*cols)


def list_recent(history: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows first."""
    return history.orderBy(F.desc("date_detection"), F.desc("id")).limit(limit)


def bankroll_curve(history: DataFrame) -> DataFrame:
    """Profit accumulated in detection order, two decimals."""
    curve = running_sums(
        history.select("id", "date_detection", F.coalesce("profit", F.lit(0.0)).alias("p")),
        ["date_detection", "id"], {"cumulative": F.col("p")},
    )
    return curve.select("id", F.col("date_detection").alias("t"), F.round("cumulative", 2).alias("cumulative_profit"))


def alert_pass_rate(history: DataFrame, threshold: int = ALERT_SCORE) -> DataFrame:
    """Share of scored rows at or over the threshold, one decimal."""
    rate = 100.0 * F.count_if(F.col("score_ia") >= threshold) / F.nullif(F.count("score_ia"), F.lit(0))
    return history.agg(F.coalesce(half_even(rate, 1), F.lit(0.0)).alias("pass_rate"))


def distinct_detections(history: DataFrame, sport: str | None = None, only_open: bool = False) -> DataFrame:
    """One row per detection, represented by its lowest id."""
    rows = history
    if only_open:
        rows = rows.filter(F.col("statut") == "detected")
    if sport:
        rows = rows.filter(F.col("sport") == sport)
    rest = [
        "sport", "bookmaker_a", "bookmaker_b", "bookmaker_c", "event_c", "roi_pct", "score_ia", "statut",
    ]
    out = rows.groupBy(*DETECTION_KEYS).agg(
        F.min("id").alias("id"), F.min("date_detection").alias("seen"),
        F.min_by(F.struct(*rest), "id").alias("rep"),
    )
    return out.select("id", "seen", *DETECTION_KEYS, *[F.col(f"rep.{c}").alias(c) for c in rest])


def apply_verdicts(history: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Write a verdict to every row of its detection."""
    h, v = history.alias("h"), verdicts.select(*DETECTION_KEYS, F.col("verdict")).alias("v")
    return h.join(v, null_safe("h", "v", DETECTION_KEYS), "left").select(
        *[F.col(f"h.{c}") for c in history.columns if c != "statut"],
        F.coalesce(F.col("v.verdict"), F.col("h.statut")).alias("statut"),
    )


def reliability_report(history: DataFrame, as_of: Column, days: int = 7, sport: str | None = None) -> DataFrame:
    """How many detections were right, late or wrong, and the reading of it."""
    since = as_of.cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    rows = distinct_detections(history, sport).filter(F.col("seen") >= since)
    status = F.col("statut")
    counts = rows.agg(
        F.count("*").alias("detections"), F.count_if(status != "detected").alias("reviewed"),
        F.count_if(status == "ok").alias("ok"), F.count_if(status == "partie").alias("late"),
        F.count_if(status.isin(VERDICT_ERRORS)).alias("errors"), F.count_if(status == "doute").alias("doubt"),
        F.avg(F.when(status == "ok", F.col("roi_pct"))).alias("ok_roi"),
    )
    base = F.col("ok") + F.col("late") + F.col("errors")

    def pct(part: Column) -> Column:
        return F.try_divide(100.0 * part, base)

    return counts.withColumn("right_pct", pct(F.col("ok") + F.col("late"))).withColumn(
        "late_pct", pct(F.col("late"))
    ).withColumn("error_pct", pct(F.col("errors"))).withColumn(
        "band",
        F.when(F.col("right_pct") >= 90, "reliable").when(F.col("right_pct") >= 70, "review")
        .when(F.col("right_pct").isNotNull(), "not ready"),
    )


def repetition_report(history: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Detections alerted more than once and whether their prices moved.

    Prices are first reduced to the distinct ones per detection.
    """
    since = as_of.cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    keys = ["match", "event_a", "event_b", "bookmaker_a", "bookmaker_b"]
    pair = F.concat_ws("/", F.col("cote_a").cast("string"), F.col("cote_b").cast("string"))
    points = history.filter(F.col("date_detection") >= since).groupBy(*keys, pair.alias("pair")).agg(
        F.count("*").alias("n"), F.min("date_detection").alias("first"), F.max("date_detection").alias("last"),
        F.min("sport").alias("sport"),
    )
    return (
        points.groupBy(*keys)
        .agg(
            F.min("sport").alias("sport"), F.sum("n").alias("alerts"), F.count("*").alias("price_sets"),
            F.min("first").alias("first"), F.max("last").alias("last"),
            F.array_join(F.sort_array(F.collect_list("pair")), ",").alias("prices"),
        )
        .filter(F.col("alerts") > 1)
        .withColumn("diagnosis", F.when(F.col("price_sets") == 1, "dedup failure").otherwise("price drift"))
        .orderBy(F.desc("alerts"), *keys)
    )


def _book_rows(history: DataFrame) -> DataFrame:
    books = F.array_compact(F.array("bookmaker_a", "bookmaker_b", "bookmaker_c"))
    return history.withColumn("books", F.array_distinct(books)).withColumn("bookmaker", F.explode("books"))


def bookmaker_value(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """In how many opportunities a bookmaker is present, and indispensable."""
    since = as_of.cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    rows = history.filter(F.col("date_detection") >= since)
    needed = F.size("books") - 1 < 2
    per = _book_rows(rows).groupBy("bookmaker").agg(
        F.count("*").alias("present"), F.count_if(needed).alias("indispensable")
    )
    total = rows.agg(F.count("*")).scalar()
    return per.select(
        "bookmaker", "present", (100.0 * F.col("present") / total).alias("present_pct"),
        "indispensable", (100.0 * F.col("indispensable") / total).alias("indispensable_pct"),
        (F.col("indispensable") / F.lit(days)).alias("loss_per_day"),
    )


def upper_median_roi(history: DataFrame) -> DataFrame:
    """The upper middle return per bookmaker, missing returns as 0."""
    rows = _book_rows(history).select("bookmaker", F.coalesce("roi_pct", F.lit(0.0)).alias("roi"))
    return middle_values(rows, ["bookmaker"], "roi").select("bookmaker", F.col("upper_middle").alias("median_roi"))


def report_columns(opportunities: DataFrame) -> DataFrame:
    """The twenty report columns, blank third leg where there is none."""
    def day(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))

    values = [
        day("detected_at"), day("match_date"), half_even(F.col("bankroll"), 2),
        half_even(F.col("bankroll") + F.col("profit"), 2), half_even(F.col("roi_pct"), 2), half_even(F.col("profit"), 2), F.col("sport"), F.col("match_label"),
    ]
    for i in range(3):
        leg = F.get(F.col("legs"), F.lit(i))
        cells = [leg["bookmaker"], leg["event_label"], leg["odds"], half_even(leg["stake"], 2)]
        values += [F.coalesce(c.cast("string"), F.lit("")) for c in cells] if i == 2 else cells
    return opportunities.select(*[v.alias(name) for v, name in zip(values, REPORT_COLUMNS)])


def boost_listing(valuations: DataFrame) -> DataFrame:
    """Valuations with their conditions, rounded for display; by shown edge, those without one last, ties by id."""
    legs = F.transform("legs", lambda leg: leg.withField("fair_odds", half_even(leg["fair_odds"], 2)))
    shown = valuations.withColumn("legs", legs).withColumn("fair_odds", half_even(F.col("fair_odds"), 2)).withColumn(
        "edge_pct", half_even(F.col("edge_pct"), 1))
    return shown.orderBy(F.col("edge_pct").desc_nulls_last(), "boost_id")
