"""Market labels in free text -> canonical markets, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..schemas import MAPPING_TYPE
from .similarity import named_side
from .text import canonical_name, once, resolve_alias


def _has(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike("(?iuU)" + pattern), F.lit(False))


def _mapping(market, selection, n, line=None, scope=None, confidence=1.0) -> Column:
    def lit(v, kind):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return F.struct(
        lit(market, "string").alias("market_type"),
        lit(selection, "string").alias("selection"),
        lit(n, "int").alias("n_outcomes"),
        lit(line, "double").alias("line"),
        lit(scope, "string").alias("team_scope"),
        lit(confidence, "double").alias("confidence"),
    )


def _first_number(col: Column) -> Column:
    return F.translate(F.regexp_extract(col, C.LABEL_NUMBER, 1), ",", ".").try_cast("double")


def _half_suffix(col: Column) -> Column:
    return (
        F.when(_has(col, C.LABEL_FIRST_HALF), "_1h").when(_has(col, C.LABEL_SECOND_HALF), "_2h").otherwise("")
    )


def _over_under(col: Column) -> Column:
    return (
        F.when(_has(col, C.LABEL_OVER), "over")
        .when(_has(col, C.LABEL_UNDER), "under")
        .when(_has(col, C.LABEL_YES), "over")
        .when(_has(col, C.LABEL_NO), "under")
    )


def _family(market: Column) -> Column:
    """First stat family the market label belongs to."""
    expr = F.lit(None).cast("string")
    for name, pattern in reversed(C.LABEL_FAMILIES):
        hit = _has(market, pattern)
        if name == "goals":
            hit = hit & ~_has(market, C.LABEL_GOALS_EXCLUDE)
        expr = F.when(hit, F.lit(name)).otherwise(expr)
    return expr


def team_scope_score(label: Column, home: Column, away: Column, threshold: int = C.MATCH_THRESHOLD) -> Column:
    """Which team a label names, home winning ties; NULL for neither.

    Texts are brought to their canonical form once a row and then decided in batches.
    """
    text, *names = [canonical_name(resolve_alias(c)) for c in (label, F.coalesce(home, F.lit("")), F.coalesce(away, F.lit("")))]
    return named_side(text, *names, threshold)


def normalize_market_label(
    df: DataFrame,
    market: str = "market_label",
    selection: str = "selection_label",
    home: str = "home_team",
    away: str = "away_team",
    sport: str = "sport",
    output: str = "mapping",
) -> DataFrame:
    """Add the mapping of every label pair; NULL where no rule applies.

    The rules run in their published order. No shuffle: the only non-JVM step
    is the team-name score, fed NULL for rows whose rule does not need it.
    """
    m, s = F.coalesce(F.col(market), F.lit("")), F.coalesce(F.col(selection), F.lit(""))
    n_or_more = F.regexp_extract(s, "(?iuU)" + C.LABEL_N_OR_MORE, 1).try_cast("int")
    parts = F.struct(
        _family(m).alias("family"), F.when(n_or_more.isNotNull(), "over").otherwise(_over_under(s)).alias("pick"),
        F.coalesce(n_or_more - 0.5, _first_number(s)).alias("line"))
    staged = once(df, "__parts", parts).select(
        "*", F.col("__parts.family").alias("__family"), F.col("__parts.pick").alias("__pick"), F.col("__parts.line").alias("__line")
    ).drop("__parts")
    ready = F.col("__family").isNotNull() & F.col("__pick").isNotNull() & F.col("__line").isNotNull()
    staged = staged.withColumn(
        "__scope", team_scope_score(F.when(ready, m), F.col(home), F.col(away))
    )

    handicap = _has(m, C.LABEL_HANDICAP)
    result = _has(m, C.LABEL_RESULT)
    is_home, is_draw, is_away = _has(s, C.LABEL_HOME), _has(s, C.LABEL_DRAW), _has(s, C.LABEL_AWAY)
    nothing = F.lit(None).cast(MAPPING_TYPE)

    regular = _has(m, C.LABEL_REGULAR_TIME)
    hoops_pick = F.when(is_home, "home").when(is_away, "away").when(is_draw & regular, "draw")
    hoops = F.when(
        hoops_pick.isNotNull() & regular,
        _mapping(F.concat(F.lit("bb_result_reg"), _half_suffix(m)), hoops_pick, 3, confidence=0.96),
    ).when(
        hoops_pick.isNotNull(),
        _mapping(F.concat(F.lit("bb_moneyline"), _half_suffix(m)), hoops_pick, 2, confidence=0.97),
    )

    both_score = F.coalesce(_over_under(s), _over_under(m))
    three_way = F.when(is_home, "home").when(is_draw, "draw").when(is_away, "away")
    base = F.concat(F.col("__family"), F.lit("_total"))
    scoped = F.concat(F.col("__family"), F.when(F.col("__scope").isNull(), "_total").otherwise("_team"))

    mapping = (
        F.when(_has(F.concat_ws(" ", m, s), C.LABEL_PROMO), nothing)
        .when(
            (F.coalesce(F.col(sport), F.lit("football")) == "basketball") & ~handicap
            & (_has(m, C.LABEL_WINNER) | result),
            hoops,
        )
        .when(
            _has(m, C.LABEL_BTTS),
            F.when(both_score.isNotNull(), _mapping("btts", both_score, 2, confidence=0.97)),
        )
        .when(
            result & ~handicap,
            F.when(
                three_way.isNotNull(),
                _mapping(F.concat(F.lit("1x2"), _half_suffix(m)), three_way, 3, confidence=0.98),
            ),
        )
        .when(
            handicap,
            _mapping("handicap_ambiguous", "home", 3, _first_number(F.concat_ws(" ", m, s)), confidence=0.4),
        )
        .when(
            F.col("__family").isNotNull(),
            F.when(
                ready,
                _mapping(
                    F.concat(scoped, _half_suffix(m)), F.col("__pick"), 2, F.col("__line"),
                    F.col("__scope"), 0.95,
                ),
            ).otherwise(_mapping(base, "over", 2, F.col("__line"), None, 0.5)),
        )
    )
    return once(staged, output, mapping).drop("__family", "__pick", "__line", "__scope")
