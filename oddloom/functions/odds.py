"""Odds algebra and stake arithmetic over array columns.

A list of prices is an ``array<double>``; sums run in array order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def implied_margin(odds: Column) -> Column:
    """Sum of 1/price; infinite for an empty list or a price that is not positive."""
    bad = (F.size(odds) == 0) | F.exists(odds, lambda o: o.isNull() | (o <= 0))
    total = F.aggregate(odds, F.lit(0.0), lambda acc, o: acc + F.try_divide(F.lit(1.0), o))
    return F.when(bad | odds.isNull(), F.lit(float("inf"))).otherwise(total)


def is_arbitrage(odds: Column, threshold: float = 1.0) -> Column:
    """Margin strictly below the threshold."""
    return implied_margin(odds) < threshold


def roi_of_margin(margin: Column) -> Column:
    """Return in percent for a margin; 0 where the margin is not finite."""
    finite = margin.isNotNull() & (margin < float("inf")) & (margin > 0)
    return F.when(finite, (F.try_divide(F.lit(1.0), margin) - 1.0) * 100.0).otherwise(F.lit(0.0))


def roi_percent(odds: Column) -> Column:
    """(1/M - 1) * 100."""
    return roi_of_margin(implied_margin(odds))


def counter_odd(odd: Column) -> Column:
    """Lowest opposite price that makes a pair break even; NULL up to 1."""
    rest = 1.0 - F.try_divide(F.lit(1.0), odd)
    return F.when((odd > 1) & (rest > 0), F.try_divide(F.lit(1.0), rest))


def half_even(value: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value, which keeps 4.515 (just below in binary) at 4.51."""
    scale = float(10 ** digits)
    return F.bround(value * scale, 0) / scale if digits else F.bround(value, 0)


def residual_adjust(stakes: Column, odds: Column, bankroll) -> Column:
    """The leg with the highest price (first on ties) takes what is left."""
    top = F.array_position(odds, F.array_max(odds)) - 1
    others = F.aggregate(
        F.transform(stakes, lambda s, i: F.when(i == top, F.lit(0.0)).otherwise(s)),
        F.lit(0.0), lambda acc, s: acc + s,
    )
    return F.transform(
        stakes, lambda s, i: F.when(i == top, F.bround(_col(bankroll) - others, 0)).otherwise(s)
    )


def split_stakes(odds: Column, bankroll, round_to: int | None = 1) -> Column:
    """Stakes that return the same on every outcome, half-even rounding."""
    margin = implied_margin(odds)
    raw = F.transform(odds, lambda o: F.try_divide(_col(bankroll), o * margin))
    if round_to is None:
        return raw
    rounded = F.transform(raw, lambda s: half_even(s, round_to))
    if round_to != 0:
        return rounded
    return F.when(F.size(odds) > 1, residual_adjust(rounded, odds, bankroll)).otherwise(rounded)


def guaranteed_profit(bankroll, odds: Column) -> Column:
    """Bankroll * (1/M - 1)."""
    return _col(bankroll) * (F.try_divide(F.lit(1.0), implied_margin(odds)) - 1.0)


def gains_per_leg(stakes: Column, odds: Column) -> Column:
    """Stake times price."""
    return F.zip_with(stakes, odds, lambda s, o: s * o)


def min_gain(stakes: Column, odds: Column) -> Column:
    """The worst return."""
    return F.array_min(gains_per_leg(stakes, odds))


def clamp_limits(stakes: Column, lows: Column, highs: Column) -> Column:
    """Every stake inside its bookmaker's limits."""
    return F.transform(
        F.arrays_zip(stakes.alias("s"), lows.alias("lo"), highs.alias("hi")),
        lambda t: F.greatest(t["lo"], F.least(t["hi"], t["s"])),
    )


def stakes_from_fixed(fixed_stake, index, odds: Column) -> Column:
    """One stake is imposed; the others equalise the return."""
    place = F.greatest(F.lit(0), F.least(_col(index), F.size(odds) - 1))
    target = _col(fixed_stake) * F.get(odds, place)
    return F.transform(odds, lambda o: F.try_divide(target, o))


def round_to_step(stakes: Column, step) -> Column:
    """Nearest multiple of ``step``, halves up; unchanged for step <= 0."""
    s = _col(step)
    return F.when(
        s > 0, F.transform(stakes, lambda x: F.floor(F.try_divide(x, s.cast("double")) + 0.5) * s.cast("double"))
    ).otherwise(stakes)


def realized_outcome(stakes: Column, odds: Column) -> Column:
    """What the actual stakes return, whichever outcome wins."""
    total = F.aggregate(stakes, F.lit(0.0), lambda acc, s: acc + s)
    worst = F.coalesce(min_gain(stakes, odds), F.lit(0.0))
    profit = worst - total
    return F.struct(
        total.alias("total"),
        gains_per_leg(stakes, odds).alias("returns"),
        worst.alias("min_return"),
        profit.alias("profit"),
        F.when(total > 0, F.try_divide(profit, total) * 100.0).otherwise(F.lit(0.0)).alias("roi"),
    )
