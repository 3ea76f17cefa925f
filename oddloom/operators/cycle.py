"""One collection cycle from a pool of quotes to the alerts it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ALERT_SCORE, MAX_AGE_S
from ..schemas import MARKET_KEYS
from ..session import cut_lineage
from .alerts import drop_exact_duplicates, first_signal_per_match, score_opportunity, should_alert
from .arbitrage import evaluate
from .history import legs_to_wide
from .pool import fresh_only, prematch_only


def detection_id() -> Column:
    """A number for what is detected: the market, whatever its prices."""
    market = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in MARKET_KEYS])
    return F.conv(F.substring(F.sha1(market), 1, 15), 16, 10).cast("bigint")


def detect(quotes: DataFrame, as_of: Column, max_age_s: float = MAX_AGE_S, bankroll: float = 50_000.0, min_roi: float = 1.0) -> DataFrame:
    """The cycle's scored detections as history rows: fresh quotes of matches still to come, reconciled and evaluated."""
    pool = prematch_only(fresh_only(quotes, as_of, max_age_s), as_of)
    found = evaluate(pool, min_roi, bankroll, detected_at=as_of.cast("timestamp"))
    return legs_to_wide(score_opportunity(found, as_of).withColumn("id", detection_id()), ["id"])


def store_and_alert(
    detections: DataFrame, history: DataFrame, min_roi: float = 3.0, min_score: int = ALERT_SCORE, only_bookmaker: str | None = None
) -> DataFrame:
    """The rows to append to history, with ``alertable`` (first signal of its match) and ``alert`` (to be sent).

    A detection that history holds at the same prices is not stored again. Of a match only the first stored row may
    alert, even where that one fails the thresholds.
    """
    stored = first_signal_per_match(drop_exact_duplicates(detections, history), history)
    sent = should_alert(stored.filter("alertable"), min_roi, min_score, only_bookmaker).select("id", F.lit(True).alias("alert"))
    return stored.join(sent, "id", "left").withColumn("alert", F.coalesce("alert", F.lit(False)))


def run_cycle(
    quotes: DataFrame, history: DataFrame, as_of: Column, max_age_s: float = MAX_AGE_S, bankroll: float = 50_000.0,
    min_roi: float = 1.0, min_roi_alert: float = 3.0, min_score: int = ALERT_SCORE, only_bookmaker: str | None = None,
) -> DataFrame:
    """The whole cycle; the detections are written once, whatever is asked of them."""
    found = cut_lineage(detect(quotes, as_of, max_age_s, bankroll, min_roi), "detections")
    return store_and_alert(found, history, min_roi_alert, min_score, only_bookmaker)
