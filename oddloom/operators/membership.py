"""Subscription, publication and engagement metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .running import running_sums

MONEY = "decimal(38,6)"


def _ago(as_of: Column, **span: int) -> Column:
    return as_of.cast("timestamp") - F.make_dt_interval(**{k: F.lit(v) for k, v in span.items()})


def _hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier)) / F.lit(3_600_000_000)


def setting_lookup(settings: DataFrame, key: str, default: str, kind: str = "string") -> DataFrame:
    """One row with a setting, its default when empty or missing."""
    found = settings.filter(F.col("key") == key).agg(F.max("value").alias("v"))
    return found.select(F.coalesce(F.nullif(F.col("v"), F.lit("")), F.lit(default)).cast(kind).alias("value"))


def weekly_production(signals: DataFrame) -> DataFrame:
    """Signals per ISO week, newest first."""
    return (
        signals.groupBy(F.date_trunc("week", "created_at").cast("date").alias("week"))
        .agg(
            F.count("*").alias("signals"), F.round(F.avg(F.col("roi").cast(MONEY)), 2).alias("avg_roi"),
            F.round(F.max("roi"), 2).alias("max_roi"), F.count_distinct("author_id").alias("publishers"),
        )
        .orderBy(F.desc("week"))
    )


def value_per_subscription(payments: DataFrame, signals: DataFrame, days: int | Column = 7) -> DataFrame:
    """Signals published inside every approved subscription.

    No subscription is paired with its signals. Window edges are placed among
    the signals in time order, counts and returns are accumulated once over
    the whole line, and each window is the difference at its two edges.
    """
    span = days if isinstance(days, Column) else F.lit(days)
    windows = payments.filter(F.col("status") == "approved").select(
        "id", "username", F.coalesce("reviewed_at", "created_at").alias("start")
    ).withColumn("end", F.col("start") + F.make_dt_interval(days=span))
    edges = windows.select(
        F.explode(F.array(
            F.struct(F.lit("s").alias("edge"), F.col("start").alias("ts")),
            F.struct(F.lit("e").alias("edge"), F.col("end").alias("ts")),
        )).alias("x"), "id",
    ).select("x.ts", "id", "x.edge", F.lit(0).alias("n"), F.lit(0).cast(MONEY).alias("roi"))
    # An edge sorts before the signals of its own instant: starts count them, ends do not.
    points = signals.groupBy(F.col("created_at").alias("ts")).agg(
        F.count("*").cast("int").alias("n"), F.sum(F.col("roi").cast(MONEY)).cast(MONEY).alias("roi")
    ).select("ts", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("edge"), "n", "roi")
    line = edges.withColumn("order", F.lit(0)).unionByName(points.withColumn("order", F.lit(1)))
    sums = running_sums(line, ["ts", "order", "id", "edge"], {
        "upto": F.col("n").cast("bigint"), "roi_upto": F.col("roi")})
    at = sums.filter(F.col("edge").isNotNull()).groupBy("id").agg(
        F.max(F.when(F.col("edge") == "s", F.col("upto"))).alias("n0"),
        F.max(F.when(F.col("edge") == "e", F.col("upto"))).alias("n1"),
        F.max(F.when(F.col("edge") == "s", F.col("roi_upto"))).alias("r0"),
        F.max(F.when(F.col("edge") == "e", F.col("roi_upto"))).alias("r1"),
    )
    received = F.col("n1") - F.col("n0")
    mean = F.try_divide((F.col("r1") - F.col("r0")).cast("double"), received)
    return windows.join(at, "id").select(
        "id", "username", F.col("start").cast("date").alias("start"), received.alias("received"),
        F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_roi"),
        F.when(received == 0, "no signal").when(received < 4, "too few").otherwise("ok").alias("verdict"),
    )


def renewal_rate(payments: DataFrame) -> DataFrame:
    """How many paying members came back."""
    per = payments.filter(F.col("status") == "approved").groupBy("user_id").agg(F.count("*").alias("n"))
    again = F.count_if(F.col("n") >= 2)
    return per.agg(
        F.count("*").alias("clients"), F.count_if(F.col("n") == 1).alias("once"), again.alias("renewed"),
        F.round(F.try_divide(100.0 * again, F.count("*")), 1).alias("renewal_pct"),
        F.round(F.avg("n"), 2).alias("avg_payments"),
    )


def kpi_summary(
    signals: DataFrame, profiles: DataFrame, payments: DataFrame, as_of: Column, days: int = 7
) -> DataFrame:
    """The headline row; each figure is its own one-row aggregate."""
    week, before = _ago(as_of, days=7), _ago(as_of, days=14)
    at = F.col("created_at")
    subs = profiles.agg(F.count_if(F.col("sub_expires_at") > as_of.cast("timestamp"))).scalar()
    mean = value_per_subscription(payments, signals, days).agg(
        F.round(F.coalesce(F.avg("received"), F.lit(0.0)), 1)).scalar()
    renewal = renewal_rate(payments).select("renewal_pct").scalar()
    recent = signals.filter(at >= before).agg(
        F.count_if(at >= week).alias("signals_7d"),
        F.count_if(at < week).alias("signals_prev_7d"),
        F.round(F.coalesce(F.avg(F.when(at >= week, F.col("roi"))), F.lit(0)), 2).alias("avg_roi_7d"),
    )
    return recent.select(
        "*", subs.alias("active_subscribers"), mean.alias("signals_per_subscription"), renewal.alias("renewal_pct")
    )


def last_publication(signals: DataFrame, as_of: Column) -> DataFrame:
    """When the last signal was published and how many came in 7 days."""
    return signals.agg(
        F.max("created_at").alias("published_at"),
        F.count_if(F.col("created_at") >= _ago(as_of, days=7)).alias("signals_7d"),
    ).withColumn("hours_since", F.round(_hours_between(as_of, F.col("published_at")), 1))


def teaser(signals: DataFrame, as_of: Column) -> DataFrame:
    """Active signals and the best return among them."""
    return signals.filter(F.col("expires_at") > as_of.cast("timestamp")).agg(
        F.count("*").alias("active_count"), F.coalesce(F.max("roi"), F.lit(0)).alias("best_roi")
    )


def _won(bets: DataFrame, profiles: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Profit and number of recent won bets per username; folded per user before the join."""
    profit = F.coalesce(F.get_json_object("payload", "$.profit").try_cast(MONEY), F.lit(0).cast(MONEY))
    per_user = (
        bets.filter((F.col("status") == "won") & (F.col("created_at") >= _ago(as_of, days=days)))
        .groupBy("user_id").agg(F.sum(profit).alias("p"), F.count("*").alias("n"))
    )
    names = profiles.filter(F.col("username").isNotNull()).select(F.col("id").alias("user_id"), "username")
    return per_user.join(names, "user_id").groupBy("username").agg(
        F.sum("p").alias("real_profit"), F.sum("n").alias("bets")
    )


def leaderboard_amounts(
    bets: DataFrame, profiles: DataFrame, as_of: Column, limit: int = 20, only_positive: bool = True, days: int = 7
) -> DataFrame:
    """Best winners of the week with amounts; the admin form keeps losers too."""
    rows = _won(bets, profiles, as_of, days)
    if only_positive:
        rows = rows.filter(F.col("real_profit") > 0)
    out = rows.select("username", F.round("real_profit", 2).alias("profit"), "bets")
    return out.orderBy(F.desc("profit"), "username").limit(limit)


def leaderboard_tiers(
    bets: DataFrame, profiles: DataFrame, as_of: Column, limit: int = 20, days: int = 7
) -> DataFrame:
    """Ranks and tiers without amounts. Ranks are given to the kept rows only."""
    top = (
        _won(bets, profiles, as_of, days).filter(F.col("real_profit") > 0)
        .orderBy(F.desc("real_profit"), "username").limit(limit)
    )
    p = F.col("real_profit")
    return top.select(
        "username", F.row_number().over(Window.orderBy(F.desc("real_profit"), "username")).alias("rank"),
        F.when(p >= 20000, "excellent").when(p >= 5000, "tres bon").when(p >= 1000, "bon").otherwise("positif").alias("tier"),
    )


def passive_accounts(
    profiles: DataFrame, bets: DataFrame, bankroll: DataFrame, messages: DataFrame, as_of: Column
) -> DataFrame:
    """Members who paid, are a week old and never placed a bet."""
    now = as_of.cast("timestamp")
    paid = profiles.filter(
        (F.col("role") == "user") & F.col("sub_expires_at").isNotNull() & (F.col("created_at") < _ago(as_of, days=7))
    )

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias(name))

    days = F.floor(_hours_between(as_of, F.col("created_at")) / 24)
    return (
        paid.join(count(bets, "bets"), "id", "left").filter("bets IS NULL").join(count(bankroll, "movements"), "id", "left").join(count(messages, "messages"), "id", "left")
        .select(
            "id", "username", "email", F.greatest(F.lit(0), days).cast("int").alias("days_since_signup"),
            (F.col("sub_expires_at") > now).alias("subscribed"), F.coalesce("bets", F.lit(0)).alias("bets"),
            F.coalesce("movements", F.lit(0)).alias("movements"), F.coalesce("messages", F.lit(0)).alias("messages"),
            "created_at",
        )
        .orderBy("created_at", "id")
    )


def publication_health(signals: DataFrame, as_of: Column) -> DataFrame:
    """Alert when publication stopped or is too thin."""
    last = last_publication(signals, as_of)
    return last.select(
        F.when(F.col("published_at").isNull(), "alert").when(F.col("hours_since") > 48, "alert")
        .when(F.col("signals_7d") < 4, "alert").otherwise("ok").alias("status"),
        F.when(F.col("published_at").isNull(), "never published").when(F.col("hours_since") > 48, "last publication too old")
        .when(F.col("signals_7d") < 4, "too few signals").otherwise("publishing").alias("detail"),
    )
