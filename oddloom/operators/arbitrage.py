"""Best-price selection and arbitrage detection.

The selection runs in two shuffles whatever the skew. Quotes are first folded
map-side into price points (market, selection, bookmaker, price), which bounds
a hot market by its distinct prices; only those narrow rows meet on the market
key. URLs and team names stay out of both shuffles and are fetched at the end,
for the rows that survived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import odds as O
from ..functions import text
from ..schemas import MARKET_KEYS
from ..session import cut_lineage
from .running import middle_values


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    """Equality of ``keys`` between two aliased frames, NULL equal to NULL."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def market_groups(quotes: DataFrame) -> DataFrame:
    """Size of every market group; NULL keys are equal."""
    return quotes.groupBy(*MARKET_KEYS).agg(F.count("*").alias("n_quotes"))


# The line as text: a floating-point key is normalised anew in every operator,
# which would hide that the rows are already partitioned on it.
POINT_KEYS = ["match_id", "market_type", "line_key", "team_scope"]


def price_points(quotes: DataFrame) -> DataFrame:
    """Distinct prices per market, selection and bookmaker with their first position."""
    keyed = quotes.withColumn("line_key", (F.col("line") + 0.0).cast("string"))
    return keyed.groupBy(*POINT_KEYS, "n_outcomes", "selection", "bookmaker", "odds").agg(
        F.min("ingest_seq").alias("seq")
    )


def _side(n: Column, selection: Column) -> Column:
    return (
        F.when((n == 2) & selection.isin("over", "home"), "a")
        .when((n == 2) & selection.isin("under", "away"), "b")
        .when((n == 3) & (selection == "home"), "a")
        .when((n == 3) & (selection == "draw"), "d")
        .when((n == 3) & (selection == "away"), "b")
    )


def side_tops(quotes: DataFrame) -> DataFrame:
    """Per market: the best leg of each side and the best leg at another bookmaker.

    ``a1``/``b1``/``d1`` hold the highest price (first on ties), ``a2``/``b2``/
    ``d2`` the highest price outside the first one's bookmaker. The first
    quote of a market decides its number of outcomes.
    """
    first = Window.partitionBy(*POINT_KEYS).orderBy("seq", "n_outcomes")
    ranked = Window.partitionBy(*POINT_KEYS, "side").orderBy(F.desc("odds"), "seq", "bookmaker")
    sided = (
        price_points(quotes).withColumn("n_group", F.first("n_outcomes").over(first))
        .withColumn("side", _side(F.col("n_group"), F.col("selection")))
        .filter(F.col("side").isNotNull())
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("top_book", F.first("bookmaker").over(ranked))
        .withColumn("leg", F.struct("selection", "bookmaker", "odds", "seq"))
    )
    aggs = []
    for side in "abd":
        mine = F.col("side") == side
        aggs.append(F.min_by("leg", F.when(mine, F.col("rank"))).alias(side + "1"))
        other = mine & (F.col("bookmaker") != F.col("top_book"))
        aggs.append(F.min_by("leg", F.when(other, F.col("rank"))).alias(side + "2"))
    tops = sided.groupBy(*POINT_KEYS).agg(F.max("n_group").alias("n_outcomes"), *aggs)
    return tops.withColumn("line", F.col("line_key").cast("double")).drop("line_key")


def _two_way_legs() -> Column:
    a1, a2, b1, b2 = (F.col(c) for c in ("a1", "a2", "b1", "b2"))
    swap_b = b2.isNotNull() & (a2.isNull() | (b2["odds"] >= a2["odds"]))
    return (
        F.when(a1.isNull() | b1.isNull(), F.lit(None))
        .when(a1["bookmaker"] != b1["bookmaker"], F.array(a1, b1))
        .when(swap_b, F.array(a1, b2))
        .when(a2.isNotNull(), F.array(a2, b1))
    )


def _three_way_legs() -> Column:
    h, d, a = F.col("a1"), F.col("d1"), F.col("b1")
    one_book = (h["bookmaker"] == d["bookmaker"]) & (d["bookmaker"] == a["bookmaker"])

    def candidate(*legs: Column) -> Column:
        whole = legs[0].isNotNull() & legs[1].isNotNull() & legs[2].isNotNull()
        margin = 1.0 / legs[0]["odds"] + 1.0 / legs[1]["odds"] + 1.0 / legs[2]["odds"]
        order = [x["seq"].alias(f"s{i}") for i, x in enumerate(legs)]
        return F.when(whole, F.struct(margin.alias("m"), *order, F.array(*legs).alias("legs")))

    # Replacing one leg of a one-bookmaker triplet is never worse than replacing two.
    best = F.least(
        candidate(F.col("a2"), d, a), candidate(h, F.col("d2"), a), candidate(h, d, F.col("b2"))
    )
    return (
        F.when(h.isNull() | d.isNull() | a.isNull(), F.lit(None))
        .when(~one_book, F.array(h, d, a))
        .otherwise(best["legs"])
    )


def best_combos(quotes: DataFrame, n_outcomes: int | None = None) -> DataFrame:
    """Best cross-bookmaker combination per market as an ordered ``legs`` array."""
    tops = side_tops(quotes)
    if n_outcomes is not None:
        tops = tops.filter(F.col("n_outcomes") == n_outcomes)
    legs = {2: _two_way_legs, 3: _three_way_legs}
    expr = (
        legs[n_outcomes]() if n_outcomes
        else F.when(F.col("n_outcomes") == 2, _two_way_legs()).otherwise(_three_way_legs())
    )
    return tops.select(*MARKET_KEYS, "n_outcomes", expr.alias("legs")).filter(F.col("legs").isNotNull())


def best_two_way(quotes: DataFrame) -> DataFrame:
    """Best pair of opposite sides at different bookmakers."""
    return best_combos(quotes, 2).select(
        *MARKET_KEYS, F.col("legs")[0].alias("leg_a"), F.col("legs")[1].alias("leg_b")
    )


def best_three_way(quotes: DataFrame) -> DataFrame:
    """Best home, draw and away at two or more bookmakers."""
    return best_combos(quotes, 3).select(
        *MARKET_KEYS, F.col("legs")[0].alias("leg_h"), F.col("legs")[1].alias("leg_d"),
        F.col("legs")[2].alias("leg_a"),
    )


def best_per_outcome(quotes: DataFrame) -> DataFrame:
    """First-best quote per market and selection.

    The rank limit is applied before the shuffle as well as after it.
    """
    ranked = Window.partitionBy(*MARKET_KEYS, "selection").orderBy(F.desc("odds"), "ingest_seq", "bookmaker")
    return (
        quotes.select(*MARKET_KEYS, "selection", "bookmaker", "odds", "ingest_seq")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") == 1)
        .drop("rank", "ingest_seq")
    )


def two_way_pairs(quotes: DataFrame) -> DataFrame:
    """Every pair of opposite sides at different bookmakers.

    Quadratic in the quotes of a market by definition. Nothing in this package
    builds on it: A04 finds the best pair by aggregation, and
    ``two_way_pair_summary`` counts and bounds the pairs without listing them.
    """
    a = quotes.filter(F.col("selection").isin("over", "home")).alias("a")
    b = quotes.filter(F.col("selection").isin("under", "away")).alias("b")
    cond = (F.col("a.bookmaker") != F.col("b.bookmaker")) & null_safe("a", "b", MARKET_KEYS)
    pick = [F.col(f"a.{k}").alias(k) for k in MARKET_KEYS]
    for side in "ab":
        pick += [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("bookmaker", "selection", "odds")]
    return a.join(b, cond).select(*pick)


def three_way_triplets(quotes: DataFrame) -> DataFrame:
    """Every home, draw, away triplet over two or more bookmakers (see A02)."""
    parts = {
        "h": quotes.filter(F.col("selection") == "home").alias("h"),
        "d": quotes.filter(F.col("selection") == "draw").alias("d"),
        "a": quotes.filter(F.col("selection") == "away").alias("a"),
    }

    one_book = (F.col("h.bookmaker") == F.col("d.bookmaker")) & (F.col("d.bookmaker") == F.col("a.bookmaker"))
    pick = [F.col(f"h.{k}").alias(k) for k in MARKET_KEYS]
    for side in "hda":
        pick += [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("bookmaker", "odds")]
    return (
        parts["h"].join(parts["d"], null_safe("h", "d", MARKET_KEYS))
        .join(parts["a"], null_safe("h", "a", MARKET_KEYS)).filter(~one_book).select(*pick)
    )


def combination_summary(quotes: DataFrame, sides: dict[str, list[str]]) -> DataFrame:
    """Number of combinations over two or more bookmakers, per market.

    All combinations minus those inside one bookmaker, from per-bookmaker
    counts: exact, linear, and no combination is built.
    """
    counts = quotes.groupBy(*MARKET_KEYS, "bookmaker").agg(
        *[F.count_if(F.col("selection").isin(v)).alias(f"n_{k}") for k, v in sides.items()]
    )

    def product(cols: list[Column]) -> Column:
        out = cols[0]
        for c in cols[1:]:
            out = out * c
        return out

    inside = product([F.col(f"n_{k}").cast("decimal(20,0)") for k in sides])
    total = counts.groupBy(*MARKET_KEYS).agg(
        *[F.sum(f"n_{k}").alias(f"t_{k}") for k in sides], F.sum(inside).alias("inside")
    )
    n = product([F.col(f"t_{k}").cast("decimal(20,0)") for k in sides]) - F.col("inside")
    return total.select(*MARKET_KEYS, n.alias("n_combinations")).filter(F.col("n_combinations") > 0)


def two_way_pair_summary(quotes: DataFrame) -> DataFrame:
    """A02 in summary: how many pairs each market has."""
    return combination_summary(quotes, {"a": ["over", "home"], "b": ["under", "away"]})


def three_way_triplet_summary(quotes: DataFrame) -> DataFrame:
    """A03 in summary: how many triplets each market has."""
    return combination_summary(quotes, {"h": ["home"], "d": ["draw"], "a": ["away"]})


def leg_odds(legs: Column) -> Column:
    return F.transform(legs, lambda leg: leg["odds"])


def distinct_operators(legs: Column) -> Column:
    return F.size(F.array_distinct(F.transform(legs, lambda leg: text.operator_of(leg["bookmaker"]))))


def with_margin(combos: DataFrame) -> DataFrame:
    """Margin and return of every combination."""
    margin = O.implied_margin(leg_odds(F.col("legs")))
    return combos.withColumn("margin", margin).withColumn("roi_pct", O.roi_of_margin(F.col("margin")))


#: Legs up to which their places (a number each) are sent to the quotes.
FEW_LEGS = 2_000_000


def attach_quotes(combos: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fetch what the legs' quotes say (URL, teams, start) for chosen combinations.

    ``combos`` is the survivor set, written once and counted. The places of
    few legs are sent to the scan of ``quotes``, so that only quotes in such a
    place are joined or shuffled; the rest meet on the quote's identity.
    """
    combos = cut_lineage(combos, "combos")
    keys = [*MARKET_KEYS, "selection", "bookmaker", "odds"]
    facts = ["url", "sport", "competition", "home_team", "away_team", "start_time"]
    legs = combos.select(*MARKET_KEYS, F.posexplode("legs").alias("pos", "leg")).select(
        *MARKET_KEYS, "pos", "leg.selection", "leg.bookmaker", "leg.odds", F.col("leg.seq").alias("ingest_seq")
    )
    info = quotes.select(*keys, "ingest_seq", *facts)
    if (combos.agg(F.sum(F.size("legs"))).first()[0] or 0) <= FEW_LEGS:
        places = legs.select(F.xxhash64("ingest_seq").alias("place")).distinct()
        # asked as a filter, which Spark moves below the joins that made the quotes, as it does no join
        info = info.filter(F.xxhash64("ingest_seq").isin(places.hint("broadcast")))
    payload = F.struct(
        *[F.col(f"l.{c}") for c in ("pos", "bookmaker", "selection", "odds")], *[F.col(f"q.{c}") for c in facts]
    )
    gathered = (
        legs.alias("l").join(info.alias("q"), null_safe("l", "q", [*keys, "ingest_seq"]))
        .select(*[F.col(f"l.{k}") for k in MARKET_KEYS], F.col("l.pos"), payload.alias("leg"))
        .groupBy(*MARKET_KEYS, "pos").agg(F.min("leg").alias("leg"))
        .groupBy(*MARKET_KEYS)
        .agg(F.array_sort(F.collect_list("leg")).alias("full"))  # two or three legs
    )
    return (
        combos.alias("c").join(gathered.alias("g"), null_safe("c", "g", MARKET_KEYS))
        .select(*[F.col(f"c.{c}") for c in combos.columns if c != "legs"], F.col("g.full"))
    )


def _event_label(market: Column, leg: Column, line: Column) -> Column:
    tail = F.when(line.isNotNull(), F.concat(F.lit(" "), line.cast("string"))).otherwise(F.lit(""))
    return F.concat(market, F.lit(" "), leg["selection"], tail)


def make_opportunity(
    combos: DataFrame, quotes: DataFrame, bankroll: float = 0.0, min_roi: float = 1.0,
    detected_at: Column | None = None,
) -> DataFrame:
    """A10: playable combinations as opportunities.

    Needs two or more owner groups, a margin below 1 and the minimum return.
    The owner rule comes after the best prices are chosen, as published.
    """
    keep = (
        with_margin(combos)
        .filter(distinct_operators(F.col("legs")) >= 2)
        .filter((F.col("margin") < 1.0) & (F.col("roi_pct") >= min_roi))
    )
    full = attach_quotes(keep, quotes)
    ref = F.col("full")[0]
    legs = F.transform(
        F.col("full"),
        lambda leg: F.struct(
            leg["bookmaker"].alias("bookmaker"), leg["selection"].alias("selection"), leg["odds"].alias("odds"),
            leg["url"].alias("url"), _event_label(F.col("market_type"), leg, F.col("line")).alias("event_label"),
            F.lit(0.0).alias("stake"),
        ),
    )
    return full.select(
        "match_id",
        ref["sport"].alias("sport"),
        F.concat(ref["home_team"], F.lit(" - "), ref["away_team"]).alias("match_label"),
        ref["start_time"].alias("match_date"),
        "market_type", "line", "team_scope",
        F.size("full").alias("n_outcomes"),
        legs.alias("legs"),
        "margin", "roi_pct",
        F.lit(float(bankroll)).alias("bankroll"),
        (F.lit(float(bankroll)) * (1.0 / F.col("margin") - 1.0)).alias("profit"),
        (detected_at if detected_at is not None else F.lit(None)).cast("timestamp").alias("detected_at"),
        F.lit(None).cast("int").alias("score_ia"),
        F.lit(None).cast("string").alias("explanation"),
        F.lit("detected").alias("status"),
    )


def find_two_way(quotes: DataFrame, min_roi: float = 1.0, bankroll: float = 0.0, **kw) -> DataFrame:
    """Two-outcome opportunities."""
    return make_opportunity(best_combos(quotes, 2), quotes, bankroll, min_roi, **kw)


def find_three_way(quotes: DataFrame, min_roi: float = 1.0, bankroll: float = 0.0, **kw) -> DataFrame:
    """Three-outcome opportunities."""
    return make_opportunity(best_combos(quotes, 3), quotes, bankroll, min_roi, **kw)


def assign_stakes(opportunities: DataFrame, round_to: int | None = 0) -> DataFrame:
    """Stakes of every leg."""
    stakes = O.split_stakes(leg_odds(F.col("legs")), F.col("bankroll"), round_to)
    return opportunities.withColumn("__stakes", stakes).withColumn(
        "legs",
        F.zip_with("legs", "__stakes", lambda leg, s: leg.withField("stake", s)),
    ).drop("__stakes")


def evaluate(
    quotes: DataFrame, min_roi: float = 1.0, bankroll: float = 50_000.0, reconcile: bool = True, **kw
) -> DataFrame:
    """Every opportunity of a pool with whole-unit stakes.

    Both market kinds come out of one pass over the quotes.
    """
    if reconcile:
        from .resolve import reconcile_pool

        quotes = reconcile_pool(quotes)
    return assign_stakes(make_opportunity(best_combos(quotes), quotes, bankroll, min_roi, **kw))


def rank_cross_book(
    quotes: DataFrame, as_of: Column, bankroll: float = 50_000.0, limit: int = 40, reconcile: bool = True
) -> DataFrame:
    """Best combination per market by margin, near misses included."""
    from .pool import prematch_only

    pool = prematch_only(quotes, as_of)
    if reconcile:
        from .resolve import reconcile_pool

        pool = reconcile_pool(pool)
    top = (
        with_margin(best_combos(pool))
        .filter(distinct_operators(F.col("legs")) >= 2)
        .orderBy("margin", *MARKET_KEYS)
        .limit(limit)
    )
    full = attach_quotes(top, pool)
    prices = leg_odds(F.col("full"))
    stakes = F.when(F.col("margin") < 1.0, O.split_stakes(prices, bankroll, 0)).otherwise(
        F.transform(F.col("full"), lambda _: F.lit(0.0))
    )
    ref = F.col("full")[0]
    legs = F.zip_with(
        F.col("full"), stakes,
        lambda leg, s: F.struct(
            leg["bookmaker"].alias("bookmaker"), leg["selection"].alias("selection"),
            text.outcome_label(leg["selection"], F.col("line"), F.col("team_scope")).alias("outcome"),
            leg["odds"].alias("odds"), s.alias("stake"), leg["url"].alias("url"),
        ),
    )
    return full.select(
        F.concat(ref["home_team"], F.lit(" - "), ref["away_team"]).alias("match"),
        ref["sport"].alias("sport"), ref["competition"].alias("competition"),
        text.market_label(F.col("market_type"), F.col("line")).alias("market"),
        "match_id", "market_type", "line", "team_scope",
        F.size("full").alias("n_issues"), "margin", "roi_pct",
        (F.lit(float(bankroll)) * (1.0 / F.col("margin") - 1.0)).alias("profit"),
        F.lit(float(bankroll)).alias("bankroll"),
        (F.col("margin") < 1.0).alias("is_arbitrage"),
        legs.alias("legs"),
    ).orderBy("margin", *MARKET_KEYS)


def live_filter(ranked: DataFrame, min_roi: float) -> DataFrame:
    """Minimum return, only when one is asked for."""
    return ranked.filter(F.col("roi_pct") >= min_roi) if min_roi > 0 else ranked


def intra_book_margin(quotes: DataFrame) -> DataFrame:
    """Each bookmaker's own overround per market type.

    Uses the best price a bookmaker shows per outcome, over markets where it
    quotes all of them.
    """
    best = quotes.groupBy(*MARKET_KEYS, "n_outcomes", "bookmaker", "selection").agg(F.max("odds").alias("odds"))
    own = (
        best.groupBy(*MARKET_KEYS, "n_outcomes", "bookmaker")
        .agg(F.sum(1.0 / F.col("odds")).alias("m"), F.count("*").alias("outcomes"))
        .filter(F.col("outcomes") == F.col("n_outcomes"))
        .withColumn("overround_pct", (F.col("m") - 1.0) * 100.0)
    )
    return own.groupBy("bookmaker", "market_type").agg(
        F.count("*").alias("markets"),
        F.avg("overround_pct").alias("mean_pct"),
        F.min("overround_pct").alias("min_pct"),
        F.max("overround_pct").alias("max_pct"),
    ).join(
        middle_values(own, ["bookmaker", "market_type"], "overround_pct").select(
            "bookmaker", "market_type", ((F.col("lower_middle") + F.col("upper_middle")) / 2).alias("median_pct")
        ),
        ["bookmaker", "market_type"],
    )


def cross_book_price_agreement(quotes: DataFrame) -> DataFrame:
    """Share of comparable quotes two bookmakers price alike.

    A market outcome is first reduced to a pattern: who quotes it, and which
    of them share a price. Pairs are read off the distinct patterns, weighted
    by how often each occurs, so no pair is formed per outcome.
    """
    keys = [*MARKET_KEYS, "selection"]
    last = F.max(F.struct("ingest_seq", "odds"))["odds"].alias("odds")
    per_book = quotes.groupBy(*keys, "bookmaker").agg(last)
    pattern = (
        per_book.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("bookmaker", "odds"))).alias("q"))
        .filter(F.size("q") > 1)
        # a price is replaced by the position of its first holder
        .select(F.transform(
            "q",
            lambda x: F.struct(
                x["bookmaker"].alias("book"),
                F.array_position(F.transform("q", lambda y: y["odds"]), x["odds"]).alias("level"),
            ),
        ).alias("pattern"))
        .groupBy("pattern").agg(F.count("*").alias("weight"))
    )
    left = pattern.select("pattern", "weight", F.explode("pattern").alias("a"))
    pairs = left.select("weight", "a", F.explode("pattern").alias("b")).filter(
        F.col("a.book") < F.col("b.book")
    )
    same = F.sum(F.when(F.col("a.level") == F.col("b.level"), F.col("weight")).otherwise(0))
    return (
        pairs.groupBy(F.col("a.book").alias("book_a"), F.col("b.book").alias("book_b"))
        .agg(F.sum("weight").alias("comparable"), same.alias("identical"))
        .withColumn("pct", 100.0 * F.col("identical") / F.col("comparable"))
    )


def overlap_matrix(quotes: DataFrame) -> DataFrame:
    """Matches and markets each pair of bookmakers shares (see A18)."""

    def shared(keys: list[str], name: str) -> DataFrame:
        books = quotes.select(*keys, "bookmaker").distinct().groupBy(*keys).agg(
            F.sort_array(F.collect_set("bookmaker")).alias("books")
        )
        sets = books.filter(F.size("books") > 1).groupBy("books").agg(F.count("*").alias("w"))
        a = sets.select("books", "w", F.explode("books").alias("book_a"))
        return (
            a.select("w", "book_a", F.explode("books").alias("book_b"))
            .filter(F.col("book_a") < F.col("book_b"))
            .groupBy("book_a", "book_b").agg(F.sum("w").alias(name))
        )

    matches = shared(["match_id"], "shared_matches")
    markets = shared(MARKET_KEYS, "shared_markets")
    return matches.join(markets, ["book_a", "book_b"], "left").na.fill(0, ["shared_markets"])
