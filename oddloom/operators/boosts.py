"""Boosted combination bets: parsing, pricing and hedging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions.labels import team_scope_score
from ..functions.similarity import similar_ratio
from ..functions.text import lookup, plain_number, same_squad_level, strip_accents
from ..session import cut_lineage, shuffled
from ..sources.feeds import split_pair
from .resolve import SIDE, canonical_key, similar_matches, with_side_keys


def _has(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike("(?iuU)" + pattern), F.lit(False))


def parse_boost(boosts: DataFrame) -> DataFrame:
    """one row per fragment of the offer, with both teams."""
    home, away = split_pair(F.col("match"))
    clean = F.trim(F.regexp_replace("description", "(?iuU)" + C.BOOST_SOURCE_NOTE, ""))
    parts = F.filter(F.split(clean, "(?iuU)" + C.BOOST_SPLIT), lambda p: F.trim(p) != "")
    return boosts.select(
        "boost_id", home.alias("home_team"), away.alias("away_team"), F.posexplode(parts).alias("pos", "part")
    ).select("boost_id", "pos", F.regexp_replace("part", r"^\s+|\s+$", "").alias("fragment"), "home_team", "away_team")


def condition_team(fragments: DataFrame) -> DataFrame:
    """add the team a fragment names, NULL for neither."""
    side = team_scope_score(
        F.col("fragment"), F.coalesce("home_team", F.lit("")), F.coalesce("away_team", F.lit("")))
    return fragments.withColumn("__side", side).withColumn(
        "named_team", F.when(F.col("__side") == "home", F.col("home_team")).when(F.col("__side") == "away", F.col("away_team"))
    ).drop("__side")


def parse_condition(fragments: DataFrame) -> DataFrame:
    """fragments as conditions: both score, threshold, win, else unknown."""
    text = F.col("fragment")
    rows = condition_team(fragments)
    pattern = "(?iuU)" + C.BOOST_THRESHOLD
    word = F.lower(F.trim(strip_accents(F.regexp_extract(text, pattern, 2))))
    n = F.regexp_extract(text, pattern, 1).try_cast("int")
    rows = rows.withColumn("__stat", lookup(C.BOOST_STATS, word)).withColumn("__n", n)
    kind = (
        F.when(_has(text, C.BOOST_BTTS), "btts").when(F.col("__n").isNotNull() & F.col("__stat").isNotNull(), "threshold")
        .when(_has(text, C.BOOST_WIN), "win").otherwise("unknown")
    )
    is_kind = F.col("kind")
    rows = rows.withColumn("kind", kind)
    each = (is_kind == "threshold") & _has(text, C.BOOST_EACH_TEAM)
    before_verb = F.trim(F.regexp_extract(text, "(?iuU)" + C.BOOST_WIN, 1))
    team = F.when((is_kind == "threshold") & ~each, F.col("named_team")).when(
        is_kind == "win", F.coalesce("named_team", before_verb))
    return rows.select(
        "boost_id", "pos", "kind", team.alias("team"), each.alias("each_team"),
        F.when(is_kind == "threshold", F.col("__stat")).alias("stat"),
        F.when(is_kind == "threshold", F.col("__n") - 0.5).cast("double").alias("line"),
        text.alias("raw"), (is_kind == "unknown").alias("unknown"),
    )


def is_parsable(conditions: DataFrame) -> DataFrame:
    """offers with at least one condition and none unknown."""
    return conditions.groupBy("boost_id").agg((~F.bool_or("unknown")).alias("parsable"), F.count("*").alias("n_conditions"))


# --- the quotes of an offer's match -----------------------------------------------------

def _offer_sides(boosts: DataFrame) -> DataFrame:
    home, away = split_pair(F.col("match"))
    sides = boosts.select("boost_id", home.alias("home_team"), away.alias("away_team"))
    return with_side_keys(sides.filter(F.col("home_team").isNotNull() & F.col("away_team").isNotNull()))


def match_pools(boosts: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which quoted matches belong to which offer, and each offer's first quote: the index all pricing shares.

    Returns (boost_id + side keys of the quotes, boost_id + reference teams
    and bookmaker). Quotes are first reduced to one row per spelled match; the
    index is written once, and callers that price an offer several ways pass it on.
    """
    offers = _offer_sides(boosts).select("boost_id", *SIDE)
    # By bookmaker first: whole numbers are reduced as they are read, texts would be sorted by match for it.
    first = quotes.groupBy("home_team", "away_team", "bookmaker").agg(F.min("ingest_seq").alias("seq"))
    spelled = cut_lineage(with_side_keys(
        first.groupBy("home_team", "away_team").agg(F.min("seq").alias("seq"), F.min_by("bookmaker", "seq").alias("bookmaker"))
    ).groupBy(*SIDE).agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("home_team", "away_team", "bookmaker"), "seq").alias("ref")), "spelled")
    wanted = cut_lineage(offers.select(*SIDE).distinct(), "wanted")
    hits = similar_matches(
        wanted.withColumn("o_home", F.col("home_key")).withColumn("o_away", F.col("away_key")), spelled, [])
    linked = hits.select(
        F.col("l.home_level").alias("home_level"), F.col("l.o_home").alias("home_key"), F.col("l.away_level").alias("away_level"),
        F.col("l.o_away").alias("away_key"), F.col("r.home_key").alias("q_home"), F.col("r.away_key").alias("q_away"),
        F.col("r.seq").alias("seq"), F.col("r.ref").alias("ref"))
    pool = cut_lineage(offers.join(linked, SIDE), "offer-matches")
    refs = pool.groupBy("boost_id").agg(F.min_by("ref", "seq").alias("ref")).select(
        "boost_id", F.col("ref.home_team").alias("ref_home"), F.col("ref.away_team").alias("ref_away"),
        F.col("ref.bookmaker").alias("book"))
    keys = pool.select(
        "boost_id", "home_level", F.col("q_home").alias("home_key"), "away_level", F.col("q_away").alias("away_key"))
    return keys, refs


def _sided(conditions: DataFrame, refs: DataFrame) -> DataFrame:
    """Conditions with their offer's first quote and the side of their team; read twice, so written once."""
    return cut_lineage(conditions.join(shuffled(refs), "boost_id", "left").withColumn("side", _side_of(F.col("team"))), "conditions")


def _side_of(team: Column) -> Column:
    """home or away, by similarity to the reference teams."""
    def like(ref: str) -> Column:
        close = similar_ratio(canonical_key(team), canonical_key(F.col(ref))) >= C.MATCH_THRESHOLD
        return F.coalesce(same_squad_level(team, F.col(ref)) & close, F.lit(False))

    return F.when(team.isNull(), F.lit(None)).when(like("ref_home"), "home").when(like("ref_away"), "away")


def _priced_stat(scoped: Column) -> Column:
    known = F.col("stat").isin(C.BOOST_PRICED_STATS)
    return F.when(known, F.concat("stat", F.when(scoped, "_team").otherwise("_total")))


def _scope_key(col: str) -> Column:
    return F.coalesce(col, F.lit("")).alias("scope")


def price_condition(conditions: DataFrame, boosts: DataFrame, quotes: DataFrame, feed: str | None = None) -> DataFrame:
    """add fair odds, bookmaker and detail to every condition; with ``feed`` by that bookmaker's prices alone."""
    quotes = quotes if feed is None else quotes.filter(F.col("bookmaker") == feed)
    keys, refs = match_pools(boosts, quotes)
    rows = _sided(conditions, refs)
    kind, each = F.col("kind"), F.col("each_team")
    market = (
        F.when(kind == "win", "1x2").when(kind == "btts", "btts")
        .when(kind == "threshold", _priced_stat(each | F.col("team").isNotNull()))
    )
    pick = F.when(kind == "win", F.col("side")).otherwise("over")
    scope = F.when((kind == "threshold") & F.col("team").isNotNull(), F.col("side"))
    scopes = F.when(each, F.array(F.lit("home"), F.lit("away"))).otherwise(F.array(scope))
    needs = rows.filter(market.isNotNull() & pick.isNotNull()).select(
        "boost_id", "pos", market.alias("market_type"), pick.alias("selection"), "line", F.explode(scopes).alias("team_scope"))
    # Needs are placed on the quoted matches first: the joins with prices are then equalities, by line where one is asked.
    best = with_side_keys(quotes.groupBy("home_team", "away_team", "market_type", "selection", "line", "team_scope").agg(
        F.max("odds").alias("odds")))
    market_keys = [*SIDE, "market_type", "selection", "scope"]
    priced = cut_lineage(best.select(*SIDE, "market_type", "selection", _scope_key("team_scope"), "line", "odds"), "prices")
    placed = cut_lineage(needs.join(shuffled(keys), "boost_id").select(
        "boost_id", "pos", *SIDE, "market_type", "selection", "line", _scope_key("team_scope")), "needs")
    lined = placed.filter("line IS NOT NULL").join(priced, [*market_keys, "line"])
    loose = placed.filter("line IS NULL").drop("line").join(priced.groupBy(*market_keys).agg(F.max("odds").alias("odds")), market_keys)
    fits = ["boost_id", "pos", "scope", "odds"]
    legs = lined.select(*fits).unionByName(loose.select(*fits)).groupBy("boost_id", "pos").agg(
        F.max(F.when(F.col("scope") != "away", F.col("odds"))).alias("o1"), F.max(F.when(F.col("scope") == "away", F.col("odds"))).alias("o2"))
    out = rows.join(shuffled(legs), ["boost_id", "pos"], "left")
    fair = F.when(each, F.col("o1") * F.col("o2")).otherwise(F.coalesce("o1", "o2"))
    out = out.withColumn("fair_odds", fair)
    count = plain_number(F.col("line") + 0.5)
    unknown_stat = F.concat(F.lit("stat "), F.col("stat"), F.lit(" inconnue"))
    found = F.col("fair_odds").isNotNull()
    detail = (
        F.when(F.col("book").isNull(), "match absent de 1xBet")
        .when((kind == "win") & F.col("side").isNull(), "equipe non identifiee").when(kind == "win", "victoire (1X2)")
        .when(kind == "btts", "BTTS oui")
        .when((kind == "threshold") & ~F.col("stat").isin(C.BOOST_PRICED_STATS), unknown_stat)
        .when((kind == "threshold") & each & found, F.concat("stat", F.lit(" >= "), count, F.lit(" chaque equipe")))
        .when((kind == "threshold") & each, F.concat("stat", F.lit(" par equipe absent de 1xBet")))
        .when((kind == "threshold") & found, F.concat("stat", F.lit(" >= "), count))
        .when(kind == "threshold", F.concat("stat", F.lit(" (ligne "), F.col("line").cast("string"), F.lit(") absent de 1xBet")))
        .otherwise("condition non reconnue")
    )
    no_book = (kind == "unknown") | ((kind == "win") & F.col("side").isNull()) | ((kind == "threshold") & ~found)
    return out.select(*conditions.columns, "fair_odds", F.when(~no_book, F.col("book")).alias("bookmaker"), detail.alias("detail"))


def value_boost(boosts: DataFrame, priced: DataFrame) -> DataFrame:
    """fair price and edge of offers whose conditions are all priced, with the conditions as ``legs`` in their order."""
    leg = F.struct("pos", F.coalesce("detail", "raw").alias("label"), "raw", "fair_odds", "bookmaker")
    per = priced.groupBy("boost_id").agg(
        F.count_if(F.col("fair_odds").isNull()).alias("unpriced_count"), F.array_sort(F.collect_list(leg)).alias("legs"))
    fair = F.aggregate("legs", F.lit(1.0), lambda acc, x: acc * x["fair_odds"])
    out = boosts.join(shuffled(per), "boost_id", "left").withColumn("unpriced_count", F.coalesce("unpriced_count", F.lit(0)))
    complete = F.col("legs").isNotNull() & (F.col("unpriced_count") == 0)
    return out.withColumn("complete", complete).withColumn("fair_odds", F.when(complete, fair)).withColumn(
        "edge_pct", (F.try_divide(F.col("boosted_odds"), F.col("fair_odds")) - 1.0) * 100.0)


def complement_quote(
    conditions: DataFrame, boosts: DataFrame, quotes: DataFrame, excluded: str = C.BOOST_BOOKMAKER,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """add ``cover``: the best opposite quote elsewhere, NULL when in doubt.

    ``index``: the ``match_pools`` of the quotes without the excluded bookmaker, where the caller has it.
    """
    others = quotes.filter(F.col("bookmaker") != excluded)
    keys, refs = index or match_pools(boosts, others)
    rows = _sided(conditions, refs)
    kind = F.col("kind")
    usable = (kind == "threshold") & ~F.col("each_team") & (F.col("team").isNull() | F.col("side").isNotNull())
    market = F.when(kind == "btts", "btts").when(usable, _priced_stat(F.col("team").isNotNull()))
    needs = rows.select("boost_id", "pos", "kind", market.alias("market_type"), "line", F.col("side").alias("team_scope")).filter(
        F.col("market_type").isNotNull())
    under = others.filter(F.col("selection") == "under")
    info = F.struct(
        "bookmaker", "market_type", "selection", F.col("line").alias("line"), "team_scope", "odds", "url", "match_id", "sport",
        "home_team", "away_team", "start_time")
    best = with_side_keys(
        under.groupBy("home_team", "away_team", "market_type", "line", "team_scope").agg(
            F.max_by(info, F.struct("odds", -F.col("ingest_seq"))).alias("q"),
            F.max(F.struct("odds", -F.col("ingest_seq"))).alias("rank")))
    priced = cut_lineage(best.select(*SIDE, "market_type", _scope_key("team_scope"), "line", "q", "rank"), "prices")
    placed = cut_lineage(needs.join(shuffled(keys), "boost_id").select(
        "boost_id", "pos", "kind", *SIDE, "market_type", "line", _scope_key("team_scope")), "needs")
    market_keys = [*SIDE, "market_type"]
    # both teams scoring has neither line nor scope to meet; a threshold has to meet both
    loose = placed.filter("kind = 'btts'").drop("line", "scope").join(
        priced.groupBy(*market_keys).agg(F.max_by("q", "rank").alias("q"), F.max("rank").alias("rank")), market_keys)
    lined = placed.filter("kind <> 'btts'").join(priced, [*market_keys, "line", "scope"])
    fits = ["boost_id", "pos", "q", "rank"]
    covers = lined.select(*fits).unionByName(loose.select(*fits)).groupBy("boost_id", "pos").agg(F.max_by("q", "rank").alias("cover"))
    return rows.select(*conditions.columns).join(shuffled(covers), ["boost_id", "pos"], "left")


def _significant_words(team: Column) -> Column:
    words = F.split(F.replace(F.lower(F.coalesce(team, F.lit(""))), F.lit("-"), F.lit(" ")), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(C.TEAM_NOISE_WORDS))


def named_team_guard(conditions: DataFrame, boosts: DataFrame) -> DataFrame:
    """add ``ambiguous``: no team attached although the text names one."""
    home, away = split_pair(F.col("match"))
    teams = boosts.select("boost_id", home.alias("__h"), away.alias("__a"))
    words = F.concat(_significant_words(F.col("__h")), _significant_words(F.col("__a")))
    hit = F.exists(words, lambda w: F.lower("raw").contains(w))
    return conditions.join(shuffled(teams), "boost_id", "left").withColumn(
        "ambiguous", F.col("team").isNull() & F.coalesce(hit, F.lit(False))).drop("__h", "__a")


def _covered(boosts: DataFrame, conditions: DataFrame, quotes: DataFrame, excluded: str, index=None) -> DataFrame:
    """Offers with their conditions, covers and doubts, one row each."""
    flagged = named_team_guard(complement_quote(conditions, boosts, quotes, excluded, index), boosts)
    cell = F.struct("pos", "raw", "kind", "each_team", "unknown", "ambiguous", "cover")
    per = flagged.groupBy("boost_id").agg(F.array_sort(F.collect_list(cell), lambda a, b: a["pos"] - b["pos"]).alias("conds"))
    return boosts.join(shuffled(per), "boost_id", "left").withColumn("conds", F.coalesce("conds", F.array()))


def _margin() -> Column:
    return F.try_divide(F.lit(1.0), F.col("boosted_odds")) + F.aggregate(
        "conds", F.lit(0.0), lambda acc, c: acc + F.coalesce(1.0 / c["cover"]["odds"], F.lit(0.0)))


def find_boost_arbitrage(
    boosts: DataFrame, quotes: DataFrame, bankroll: float = 0.0, min_roi: float = 1.0, excluded: str = C.BOOST_BOOKMAKER,
    conditions: DataFrame | None = None, max_conditions: int = C.BOOST_MAX_CONDITIONS,
    index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """offers that distinct opposite quotes cover completely at a profit."""
    conds = conditions if conditions is not None else parse_condition(parse_boost(boosts))
    rows = _covered(boosts, conds, quotes, excluded, index)
    size = F.size("conds")
    marks = F.transform("conds", lambda c: F.struct(
        c["cover"]["bookmaker"].alias("a"), c["cover"]["market_type"].alias("b"), c["cover"]["line"].alias("c"),
        c["cover"]["team_scope"].alias("d")))
    ok = (
        (size >= 1) & (size <= max_conditions) & (F.col("boosted_odds") > 1)
        & F.forall("conds", lambda c: ~c["unknown"] & ~c["ambiguous"] & c["cover"].isNotNull())
        & (F.size(F.array_distinct(marks)) == size)
    )
    bank = F.lit(float(bankroll))
    good = rows.filter(ok).withColumn("margin", _margin()).withColumn("roi_pct", (1.0 / F.col("margin") - 1.0) * 100.0).filter(
        (F.col("margin") < 1.0) & (F.col("roi_pct") >= min_roi))
    margin = F.col("margin")

    def leg(book, selection, odds, url, label) -> Column:
        return F.struct(
            book.alias("bookmaker"), selection.alias("selection"), odds.alias("odds"), url.alias("url"), label.alias("event_label"),
            (bank / odds / margin).alias("stake"))

    own = leg(F.lit(C.BOOST_BOOKMAKER), F.lit("funbet"), F.col("boosted_odds"), F.coalesce("event_url", F.lit("")),
              F.concat(F.lit("Funbet : "), F.col("description")))
    covers = F.transform("conds", lambda c: leg(
        c["cover"]["bookmaker"], c["cover"]["selection"], c["cover"]["odds"], c["cover"]["url"],
        F.concat(F.lit("inverse de « "), c["raw"], F.lit(" » : "), c["cover"]["market_type"], F.lit(" "), c["cover"]["selection"],
                 F.when(c["cover"]["line"].isNotNull(), F.concat(F.lit(" "), c["cover"]["line"].cast("string"))).otherwise(""))))
    ref = F.col("conds")[0]["cover"]
    return good.select(
        "boost_id", ref["match_id"].alias("match_id"), ref["sport"].alias("sport"), F.col("match").alias("match_label"),
        ref["start_time"].alias("match_date"), F.lit("funbet_couvert").alias("market_type"), F.lit(None).cast("double").alias("line"),
        F.lit(None).cast("string").alias("team_scope"), (size + 1).alias("n_outcomes"), F.concat(F.array(own), covers).alias("legs"),
        "margin", "roi_pct", bank.alias("bankroll"), (bank * (1.0 / margin - 1.0)).alias("profit"))


def diagnose_boost(
    boosts: DataFrame, quotes: DataFrame, excluded: str = C.BOOST_BOOKMAKER, conditions: DataFrame | None = None,
    max_conditions: int = C.BOOST_MAX_CONDITIONS, index: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """all reasons why an offer cannot be covered, or its margin; a display may shorten them."""
    conds = conditions if conditions is not None else parse_condition(parse_boost(boosts))
    rows = _covered(boosts, conds, quotes, excluded, index)
    missing = F.array_compact(F.transform("conds", lambda c: F.when(
        c["kind"] == "win", "une condition de victoire (son inverse demande 2 paris)"
    ).when(c["each_team"], "un « chaque equipe » (inverse non unitaire)").when(
        c["ambiguous"], F.concat(F.lit("« "), c["raw"], F.lit(" » nomme une equipe mais est lue comme un total de match"))
    ).when(c["cover"].isNull(), F.concat(F.lit("pas de cote inverse pour « "), c["raw"], F.lit(" »")))))
    size, m = F.size("conds"), _margin()
    unknown = F.exists("conds", lambda c: c["unknown"])
    reason = (
        F.when((size == 0) | unknown, "libelle non analysable")
        .when(~F.coalesce(F.col("boosted_odds") > 1, F.lit(False)), "cote absente ou invalide")
        .when(size > max_conditions, F.concat(size.cast("string"), F.lit(" conditions : trop pour une couverture utile")))
        .when(F.size(missing) > 0, F.array_join(missing, "; "))
        .when(m < 1.0, F.concat(F.lit("COUVRABLE : marge "), F.format_string("%.3f", m)))
        .otherwise(F.concat(
            F.format_string("marge %.3f (il manque %.3f) : ", m, m - 1.0),
            F.lit("les couvertures coutent trop cher pour une cote de "), plain_number(F.col("boosted_odds"))))
    )
    return rows.select("boost_id", reason.alias("reason"))


def wanted_stats_by_match(conditions: DataFrame, boosts: DataFrame) -> DataFrame:
    """the stats the offers of each match need, sorted."""
    home, away = split_pair(F.col("match"))
    teams = boosts.select("boost_id", home.alias("home_team"), away.alias("away_team")).filter(
        F.col("home_team").isNotNull() & F.col("away_team").isNotNull())
    stats = conditions.filter((F.col("kind") == "threshold") & F.col("stat").isNotNull())
    return stats.join(shuffled(teams), "boost_id").groupBy("home_team", "away_team").agg(
        F.array_join(F.sort_array(F.collect_set("stat")), ",").alias("stats"))
