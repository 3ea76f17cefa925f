"""Landed feed payloads -> canonical quotes.

A raw table has one JSON document per row (``payload``) and its arrival number
(``feed_seq``). Everything is explode, filter and small-table lookup, so a feed
is flattened in the scan's own tasks without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import constants as C
from ..functions.text import lookup, make_match_id, once, strip_accents
from ..schemas import GROUPED_FEED, LINE_FEED, STAT_MAIN, STAT_SUB, TREE_FEED, as_quotes
from ..session import shuffled


def values_dim(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table of the fixed code lists, known to the optimizer as such."""

    def text(v) -> str:
        if v is None:
            return "CAST(NULL AS STRING)"
        return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def _seq(place: Column) -> Column:
    """Arrival order: the document's number, then the entry's place among all entries of the document.

    A place is an array position and so below 2^31, however many levels the document has.
    """
    return F.shiftleft(F.col("feed_seq").cast("bigint"), 31) + place


def _count(col: Column) -> Column:
    return F.coalesce(F.size(col), F.lit(0))


def _total(elements: Column, leaves: Callable[[Column], Column]) -> Column:
    """How many leaves all elements have together; a missing array or element has none."""
    return F.coalesce(F.aggregate(elements, F.lit(0), lambda total, x: total + F.coalesce(leaves(x), F.lit(0))), F.lit(0))


def _numbered(elements: Column, leaves: Callable[[Column], Column], first: Column | None = None) -> Column:
    """Each element as ``x`` with the place ``at`` of its first leaf: ``first`` and the leaves of the elements before it.

    Levels are exploded one by one with these places, so that nothing above a leaf is copied into it.
    """
    size = F.size(elements)
    before = F.slice(elements, F.lit(1), size - 1)  # nothing comes after the last element
    begin = F.array(F.lit(0) if first is None else first)
    counted = F.aggregate(before, begin, lambda done, x: F.array_append(done, F.element_at(done, -1) + F.coalesce(leaves(x), F.lit(0))))
    places = F.when(size > 1, counted).otherwise(begin)
    # zipped whole: a function of each pair would copy every element once more
    placed = F.arrays_zip(F.struct(elements.alias("x"))["x"], F.struct(places.alias("at"))["at"])
    return F.when(size > 0, placed)


def _has(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike("(?i)" + pattern), F.lit(False))


def linefeed_explode(
    raw: DataFrame, bookmaker: str = "1xBet", sport: str = "football", base_url: str = "https://line.example/fr",
    scraped_at: Column | None = None,
) -> DataFrame:
    """Coded line feed. Unknown codes, excluded groups and prices up to 1 are dropped."""
    codes = values_dim(
        raw.sparkSession, ["g", "t", "market_type", "n_outcomes", "selection", "team_scope"], C.LINE_FEED_CODES
    )
    events = raw.select("feed_seq", F.from_json("payload", LINE_FEED)["Value"].alias("root")).select(
        "feed_seq", F.explode(_numbered(F.col("root"), lambda ev: _count(ev["E"]))).alias("n")
    ).select("feed_seq", "n.at", F.col("n.x").alias("ev")).filter(
        (F.coalesce("ev.O1", F.lit("")) != "") & (F.coalesce("ev.O2", F.lit("")) != "") & (F.coalesce("ev.S", F.lit(0)) != 0))
    entries = events.select("feed_seq", "at", "ev", F.posexplode("ev.E").alias("j", "e")).filter(
        ~F.col("e.G").isin(C.LINE_FEED_EXCLUDED_GROUPS) & (F.col("e.C") > 1.0))
    start = F.timestamp_seconds("ev.S")
    rows = entries.join(F.broadcast(codes), (F.col("e.G") == F.col("g")) & (F.col("e.T") == F.col("t")))
    return as_quotes(rows.select(
        F.lit(bookmaker).alias("bookmaker"), F.lit(sport).alias("sport"),
        F.coalesce("ev.L", F.lit("")).alias("competition"),
        make_match_id(F.col("ev.O1"), F.col("ev.O2"), start).alias("match_id"),
        F.col("ev.O1").alias("home_team"), F.col("ev.O2").alias("away_team"), start.alias("start_time"),
        "market_type", "n_outcomes", "selection", F.col("e.P").alias("line"), "team_scope", F.col("e.C").alias("odds"),
        F.concat(F.lit(base_url + "/line/football/"), F.coalesce(F.col("ev.I").cast("string"), F.lit(""))).alias("url"),
        (scraped_at if scraped_at is not None else F.lit(None)).alias("scraped_at"),
        _seq(F.col("at") + F.col("j")).alias("ingest_seq"),
    ))


def _stat_of(name: Column, words: list[tuple[str, str]]) -> Column:
    expr = F.lit(None).cast("string")
    for pattern, stat in reversed(words):
        expr = F.when(_has(name, pattern), F.lit(stat)).otherwise(expr)
    return expr


def tree_pattern_market(name: Column) -> Column:
    """Over/under stat market recognised by the words of its type name, or NULL."""
    stat = _stat_of(name, C.TREE_STAT_WORDS)
    scope = F.when(_has(name, C.TREE_HOME), "home").when(_has(name, C.TREE_AWAY), "away")
    half = F.when(_has(name, C.TREE_FIRST_HALF), "_1h").when(_has(name, C.TREE_SECOND_HALF), "_2h").otherwise("")
    ok = (F.coalesce(name, F.lit("")) != "") & ~_has(name, C.TREE_EXCLUDE) & _has(name, C.TREE_OVER_UNDER) & stat.isNotNull()
    market = F.concat(stat, F.when(scope.isNull(), "_total").otherwise("_team"), half)
    return F.when(ok, F.struct(
        market.alias("market_type"), F.lit(2).alias("n_outcomes"), scope.alias("team_scope")))


def tree_market_resolve(df: DataFrame, type_col: str = "type") -> DataFrame:
    """Add ``resolved`` (market, outcomes, scope): listed names first, then word patterns."""
    listed = values_dim(
        df.sparkSession, ["__type", "__market", "__n", "__scope"], C.TREE_MARKETS
    )
    known = F.struct(
        F.col("__market").alias("market_type"), F.col("__n").alias("n_outcomes"), F.col("__scope").alias("team_scope"))
    joined = df.join(F.broadcast(listed), F.col(type_col) == F.col("__type"), "left")
    resolved = F.when(F.col("__type").isNotNull(), known).otherwise(tree_pattern_market(F.col(type_col)))
    # made once a row: with the patterns in a filter as well, the generated method is too long to be compiled
    return once(joined, "resolved", resolved).drop("__type", "__market", "__n", "__scope")


def tree_flatten(
    raw: DataFrame, bookmaker: str = "Golcash", sport: str = "football", base_url: str = "https://tree.example",
    scraped_at: Column | None = None,
) -> DataFrame:
    """Feed of maps keyed by id, sport -> competition -> game -> market -> event."""
    def of_market(market: Column) -> Column:
        return _count(market["event"])

    def of_game(game: Column) -> Column:
        return _total(F.map_values(game["market"]), of_market)

    def of_competition(comp: Column) -> Column:
        return _total(F.map_values(comp["game"]), of_game)

    def of_sport(sport: Column) -> Column:
        return _total(F.map_values(sport["competition"]), of_competition)

    def level(rows: DataFrame, keep: list, elements: Column, leaves: Callable[[Column], Column], first: Column | None = None) -> DataFrame:
        return rows.select(*keep, F.explode(_numbered(elements, leaves, first)).alias("n"))

    at = F.col("n.at")
    root = raw.select("feed_seq", F.from_json("payload", TREE_FEED)["sport"].alias("root"))
    sports = level(root, ["feed_seq"], F.map_values("root"), of_sport)
    comps = level(sports, ["feed_seq"], F.map_values("n.x.competition"), of_competition, at)
    games = level(comps, ["feed_seq", F.coalesce("n.x.name", F.lit("")).alias("competition")], F.map_values("n.x.game"), of_game, at)
    named = games.filter(
        (F.coalesce("n.x.team1_name", F.lit("")) != "") & (F.coalesce("n.x.team2_name", F.lit("")) != "")
        & (F.coalesce("n.x.start_ts", F.lit(0)) != 0))
    teams = [F.col("n.x.id").alias("game_id"), F.col("n.x.team1_name").alias("home_team"), F.col("n.x.team2_name").alias("away_team"),
             F.timestamp_seconds("n.x.start_ts").alias("start_time")]
    markets = level(named, ["feed_seq", "competition", *teams], F.map_values("n.x.market"), of_market, at).withColumn("type", F.col("n.x.type"))
    known = tree_market_resolve(markets).filter(F.col("resolved").isNotNull())
    resolved = known.select(*[c for c in known.columns if c != "n"], at.alias("at"), F.posexplode(F.map_values("n.x.event")).alias("j", "ev"))
    selection = lookup(C.TREE_SELECTIONS, F.col("ev.type"))
    rows = resolved.withColumn("selection", selection).filter(F.col("selection").isNotNull() & (F.col("ev.price") > 1.0))
    return as_quotes(rows.select(
        F.lit(bookmaker).alias("bookmaker"), F.lit(sport).alias("sport"), "competition",
        make_match_id(F.col("home_team"), F.col("away_team"), F.col("start_time")).alias("match_id"),
        "home_team", "away_team", "start_time", "resolved.market_type", "resolved.n_outcomes", "selection",
        F.regexp_extract("ev.name", r"(\d+(?:\.\d+)?)", 1).try_cast("double").alias("line"), "resolved.team_scope",
        F.col("ev.price").alias("odds"),
        F.concat(F.lit(base_url + "/fr/sports/event/"), F.col("game_id").cast("string")).alias("url"),
        (scraped_at if scraped_at is not None else F.lit(None)).alias("scraped_at"),
        _seq(F.col("at") + F.col("j")).alias("ingest_seq"),
    ))


def market_from_name(name: Column) -> Column:
    """Stat total recognised by the words of its market name, or NULL."""
    stat = _stat_of(name, C.GROUPED_STAT_WORDS)
    scope = F.when(_has(name, "team1"), "home").when(_has(name, "team2"), "away")
    ok = (F.coalesce(name, F.lit("")) != "") & ~_has(name, C.GROUPED_EXCLUDE) & _has(name, "total") & stat.isNotNull()
    market = F.concat(stat, F.when(scope.isNull(), "_total").otherwise("_team"))
    return F.when(ok, F.struct(
        market.alias("market_type"), F.lit(2).alias("n_outcomes"), scope.alias("team_scope")))


def code_market_resolve(df: DataFrame, tp: str = "tp", nm: str = "nm", pn: str = "pn") -> DataFrame:
    """Add ``resolved``; rows of unknown markets or periods are dropped."""
    listed = values_dim(df.sparkSession, ["__tp", "__market", "__n", "__scope"], C.GROUPED_MARKETS)
    known = F.struct(
        F.col("__market").alias("market_type"), F.col("__n").alias("n_outcomes"), F.col("__scope").alias("team_scope"))
    joined = df.join(F.broadcast(listed), F.col(tp) == F.col("__tp"), "left")
    base = F.when(F.col("__tp").isNotNull(), known).otherwise(market_from_name(F.col(nm)))
    # made once a row: with the patterns in a filter as well, the generated method is too long to be compiled
    out = once(joined, "__base", base).withColumn("__suffix", lookup(C.GROUPED_PERIODS, F.col(pn)))
    return (
        out.filter(F.col("__base").isNotNull() & F.col("__suffix").isNotNull())
        .withColumn("resolved", F.col("__base").withField("market_type", F.concat("__base.market_type", "__suffix")))
        .drop("__tp", "__market", "__n", "__scope", "__base", "__suffix")
    )


def split_pair(name: Column) -> tuple[Column, Column]:
    """Both sides of "A - B" at the first separator, blank as NULL."""
    at = F.instr(name, " - ")
    return (
        F.when(at > 0, F.nullif(F.trim(F.substring(name, F.lit(1), at - 1)), F.lit(""))),
        F.when(at > 0, F.nullif(F.trim(F.substring(name, at + 3, F.length(name))), F.lit(""))),
    )


def grouped_feed_flatten(
    raw: DataFrame, sport_id: int = 1, bookmaker: str = "Paryaj Pam", sport: str = "football",
    base_url: str = "https://grouped.example", scraped_at: Column | None = None,
) -> DataFrame:
    """Feed of event groups per sport id, outcomes in lists of one-key maps."""
    blank = F.lit("")

    def of_market(market: Column) -> Column:
        return _total(market["ou"], lambda o: _count(o))

    def of_event(ev: Column) -> Column:
        return _total(F.map_values(ev["mr"]), of_market)

    at = F.col("n.at")
    groups = raw.select(
        "feed_seq", F.try_element_at(F.from_json("payload", GROUPED_FEED), F.lit(str(sport_id))).alias("root")
    ).select("feed_seq", F.explode(_numbered(F.col("root"), lambda grp: _total(grp["events"], of_event))).alias("n"))
    competition = F.coalesce(F.nullif("n.x.trn", blank), F.nullif("n.x.ctn", blank), blank).alias("competition")
    listed = groups.select("feed_seq", competition, F.explode(_numbered(F.col("n.x.events"), of_event, at)).alias("n"))
    left, right = split_pair(F.col("n.x.nm"))
    teams = F.col("n.x.cms")
    one, two = F.get(teams, F.lit(0)), F.get(teams, F.lit(1))
    named = (F.size(teams) == 2) & (F.coalesce(one, blank) != "") & (F.coalesce(two, blank) != "")
    # made once a row: a filter would make them anew
    events = once(listed, "of", F.struct(
        F.when(named, one).otherwise(left).alias("home_team"), F.when(named, two).otherwise(right).alias("away_team"),
        F.col("n.x.tm").try_cast("timestamp").alias("start_time"),
    )).select("feed_seq", "competition", "n", F.col("n.x.id").alias("event_id"), "of.*").filter(
        F.col("home_team").isNotNull() & F.col("away_team").isNotNull() & F.col("start_time").isNotNull())
    facts = ["feed_seq", "competition", "event_id", "home_team", "away_team", "start_time"]
    markets = code_market_resolve(events.select(*facts, F.explode(_numbered(F.map_values("n.x.mr"), of_market, at)).alias("n")).select(
        *facts, "n", F.col("n.x.tp").alias("tp"), F.col("n.x.nm").alias("nm"), F.col("n.x.pn").alias("pn")))
    outs = F.flatten(F.transform(F.filter("n.x.ou", lambda o: o.isNotNull()), lambda o: F.map_values(o)))
    outcomes = markets.select(*facts, "resolved", F.col("n.x.vl").alias("market_vl"), at.alias("at"), F.posexplode(outs).alias("j", "out"))
    selection = lookup(C.GROUPED_SELECTIONS, F.col("out.nm"))
    line = F.coalesce(
        F.nullif("out.vl", blank).try_cast("double"), F.nullif("market_vl", blank).try_cast("double"))
    rows = outcomes.withColumn("selection", selection).filter(F.col("selection").isNotNull() & (F.col("out.kf") > 1.0))
    return as_quotes(rows.select(
        F.lit(bookmaker).alias("bookmaker"), F.lit(sport).alias("sport"), "competition",
        make_match_id(F.col("home_team"), F.col("away_team"), F.col("start_time")).alias("match_id"),
        "home_team", "away_team", "start_time", "resolved.market_type", "resolved.n_outcomes", "selection",
        line.alias("line"), "resolved.team_scope", F.col("out.kf").alias("odds"),
        F.concat(F.lit(base_url + "/en/sport/event/"), F.col("event_id")).alias("url"),
        (scraped_at if scraped_at is not None else F.lit(None)).alias("scraped_at"),
        _seq(F.col("at") + F.col("j")).alias("ingest_seq"),
    ))


def stat_subgame_explode(
    main: DataFrame, subgames: DataFrame, wanted: list[str] | None = None, bookmaker: str = "1xBet"
) -> DataFrame:
    """over/under quotes of the first sub-game per wanted stat.

    ``main``: ``event_id``, match columns and the main ``payload``; ``subgames``:
    ``sub_id``, ``feed_seq`` and the sub-game's ``payload``.
    """
    match = ["event_id", "home_team", "away_team", "competition", "start_time", "url", "scraped_at"]
    stat = lookup(C.STAT_NAMES, F.trim(F.lower(strip_accents(F.col("sg.TG")))))
    listed = main.select(
        *match, F.posexplode(F.from_json("payload", STAT_MAIN)["SG"]).alias("pos", "sg")
    ).withColumn("stat", stat).filter(F.col("stat").isNotNull() & (F.coalesce("sg.I", F.lit(0)) != 0))
    if wanted is not None:
        listed = listed.filter(F.col("stat").isin(wanted))
    chosen = listed.groupBy(*match, "stat").agg(F.min_by("sg.I", "pos").alias("sub_id"))
    codes = values_dim(main.sparkSession, ["g", "t", "selection", "team_scope"], C.STAT_CODES)
    entries = subgames.select("sub_id", "feed_seq", F.posexplode(F.from_json("payload", STAT_SUB)["E"]).alias("j", "e")).filter(
        (F.col("e.C") > 1.0) & F.col("e.P").isNotNull()
    ).join(F.broadcast(codes), (F.col("e.G") == F.col("g")) & (F.col("e.T") == F.col("t")))
    rows = entries.join(shuffled(chosen), "sub_id")
    return as_quotes(rows.select(
        F.lit(bookmaker).alias("bookmaker"), F.lit("football").alias("sport"), "competition",
        make_match_id(F.col("home_team"), F.col("away_team"), F.col("start_time")).alias("match_id"),
        "home_team", "away_team", "start_time",
        F.concat("stat", F.when(F.col("team_scope").isNull(), "_total").otherwise("_team")).alias("market_type"),
        F.lit(2).alias("n_outcomes"), "selection", F.col("e.P").alias("line"), "team_scope", F.col("e.C").alias("odds"),
        "url", "scraped_at", _seq(F.col("j")).alias("ingest_seq"),
    ))


def history_scan(spark: SparkSession, path: str) -> DataFrame:
    """The whole history in detection order."""
    return spark.read.parquet(path).orderBy("date_detection", "id")
