"""Scoring, de-duplication and alert selection of opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ALERT_SCORE
from ..functions import odds as O
from ..functions import scoring as S
from ..functions.text import escape_markup
from .arbitrage import leg_odds, null_safe
from .running import trailing_window

# Identity of a detection: same match, same legs, same prices.
DUPLICATE_KEYS = [
    "match", "n_issues", "event_a", "cote_a", "bookmaker_a", "event_b", "cote_b", "bookmaker_b",
    "event_c", "cote_c", "bookmaker_c",
]


def price_volatility(ticks: DataFrame, by: list[str], window_s: int = 300) -> DataFrame:
    """Deviation of the price over its mean in the trailing window, and its score."""
    spread = trailing_window(ticks, by, "ts", window_s, F.col("price"), {"__dev": "deviation", "__mean": "mean"})
    return (
        spread.withColumn("volatility", F.coalesce(F.try_divide("__dev", "__mean"), F.lit(0.0)))
        .withColumn("volatility_score", S.volatility_score(F.col("volatility")))
        .drop("__dev", "__mean")
    )


def score_opportunity(opportunities: DataFrame, now: Column, context: dict[str, Column] | None = None) -> DataFrame:
    """Add ``score_ia``; context columns default to the neutral values."""
    ctx = context or {}
    books = F.transform("legs", lambda leg: leg["bookmaker"])
    score = S.combine_scores(
        S.freshness_score(F.col("detected_at"), now),
        S.confidence_score(ctx.get("confidences", F.lit(None).cast("array<double>"))),
        S.stability_score(books, ctx.get("stability", F.lit(None).cast("map<string,double>"))),
        S.volatility_score(ctx.get("volatility", F.lit(0.0))),
        S.plausibility(F.col("market_type"), F.col("roi_pct")),
    )
    return opportunities.withColumn("score_ia", score)


def should_alert(
    opportunities: DataFrame, min_roi: float = 3.0, min_score: int = ALERT_SCORE, only_bookmaker: str | None = None
) -> DataFrame:
    """Scored rows over both thresholds, optionally with a leg at one bookmaker."""
    keep = (F.col("roi_pct") >= min_roi) & (F.col("score_ia") >= min_score)
    if only_bookmaker and only_bookmaker.strip():
        wanted = only_bookmaker.strip().casefold()
        books = (
            F.transform("legs", lambda leg: leg["bookmaker"]) if "legs" in opportunities.columns
            else F.array("bookmaker_a", "bookmaker_b", "bookmaker_c")
        )
        keep = keep & F.exists(books, lambda b: F.coalesce(F.lower(F.trim(b)) == wanted, F.lit(False)))
    return opportunities.filter(keep)


def drop_exact_duplicates(new: DataFrame, history: DataFrame) -> DataFrame:
    """Rows that history does not hold with the same prices, once each: the earliest, best, lowest-numbered one.

    The kept row is a minimum per key, folded before the shuffle, so that a
    replay with other partitions keeps the same rows.
    """
    whole = F.struct(*new.columns)
    first = F.struct("date_detection", -F.col("roi_pct"), "id")
    kept = new.groupBy(*DUPLICATE_KEYS).agg(F.min_by(whole, first).alias("row")).select("row.*").alias("n")
    seen = history.select(*DUPLICATE_KEYS).distinct().alias("h")
    return kept.join(seen, null_safe("n", "h", DUPLICATE_KEYS), "left_anti")


def first_signal_per_match(new: DataFrame, history: DataFrame, row_id: str = "id") -> DataFrame:
    """Add ``alertable``: the first stored row of a match and sport, ever.

    The first row per match is a plain minimum (folded before the shuffle) and
    is found again by its unique id, so a match with very many rows never
    meets in one task.
    """
    firsts = new.groupBy("match", "sport").agg(
        F.min_by(row_id, F.struct("date_detection", -F.col("roi_pct"), row_id)).alias(row_id)
    )
    known = history.select("match", "sport").distinct()
    fresh = firsts.join(known, ["match", "sport"], "left_anti").select(row_id, F.lit(True).alias("alertable"))
    return new.join(fresh, row_id, "left").withColumn("alertable", F.coalesce("alertable", F.lit(False)))


def cycle_counters(
    new: DataFrame, history: DataFrame, min_roi: float = 3.0, min_score: int = ALERT_SCORE
) -> DataFrame:
    """P10: detected, duplicate, silent and alerted counts of one cycle."""
    stored = first_signal_per_match(drop_exact_duplicates(new, history), history)
    hit = F.col("alertable") & (F.col("roi_pct") >= min_roi) & (F.col("score_ia") >= min_score)
    kept = stored.agg(
        F.count("*").alias("stored"), F.count_if(~F.col("alertable")).alias("silent"), F.count_if(hit).alias("alerted")
    )
    detected = new.agg(F.count("*")).scalar()
    return kept.select(detected.alias("detected"), "stored", "silent", "alerted").select(
        "detected", (F.col("detected") - F.col("stored")).alias("duplicates"), "silent", "alerted"
    )


def alert_text(opportunities: DataFrame) -> DataFrame:
    """Add the markup message of an alert as ``text``."""
    esc = escape_markup
    line = F.when(F.col("line").isNotNull(), F.concat(F.lit(" · ligne "), esc(F.col("line")))).otherwise("")
    score = F.coalesce(F.concat(F.col("score_ia").cast("string"), F.lit("/100")), F.lit("—"))
    legs = F.transform(
        "legs",
        lambda leg, i: F.concat(
            (i + 1).cast("string"), F.lit(". <b>"), esc(leg["selection"]), F.lit("</b> @ <code>"), esc(leg["odds"]),
            F.lit("</code> chez <b>"), esc(leg["bookmaker"]), F.lit("</b> → miser <code>"),
            F.format_string("%.0f", F.bround(leg["stake"], 0)), F.lit('</code> HTG\n   <a href="'), esc(leg["url"]),
            F.lit('">Placer le pari</a>'),
        ),
    )
    note = F.when(
        F.coalesce(F.col("explanation"), F.lit("")) != "",
        F.concat(F.lit("\n\n<i>"), esc(F.col("explanation")), F.lit("</i>")),
    ).otherwise("")
    text = F.concat(
        F.format_string("<b>SUREBET %.2f%%</b> — ", "roi_pct"), esc(F.col("match_label")), F.lit("\n<i>"),
        esc(F.col("sport")), F.lit(" · "), esc(F.col("market_type")), line, F.lit(" · "),
        F.col("n_outcomes").cast("string"), F.lit(" issues</i>\n\n"),
        F.format_string("Marge M : <code>%.4f</code>\n", "margin"),
        F.format_string(
            "Bankroll : <code>%.0f</code> HTG → Profit garanti : <b>%.0f HTG</b>\n",
            F.bround("bankroll", 0), F.bround("profit", 0)),
        F.lit("Score IA : <code>"), score, F.lit("</code>\n\n"), F.array_join(legs, "\n"), note,
    )
    return opportunities.withColumn("text", text)


def safe_after_rounding(opportunities: DataFrame) -> DataFrame:
    """Keep opportunities that still win after their stakes were rounded."""
    stakes = F.transform("legs", lambda leg: leg["stake"])
    return opportunities.filter(O.min_gain(stakes, leg_odds(F.col("legs"))) > F.col("bankroll"))
