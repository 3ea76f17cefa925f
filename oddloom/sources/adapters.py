"""The driver's tables seen as quotes, ticks, history and membership tables.

Each adapter is a narrow projection of one table (or one join of two), so its
work and its scan grow with the table it reads. The same definitions in SQL
live next to the plans that check them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import make_match_id
from ..schemas import QUOTE_COLUMNS
from ..session import cut_lineage, prepare

# Owner groups of the derived bookmakers.
OWNERS = {"book_0": "north-group", "book_1": "north-group", "book_2": "north-group"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows over the session's shuffle partitions.

    For jobs that spend their time per row (text, nested payloads), whatever
    the files and row groups are like.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _ts(col: Column) -> Column:
    return col.cast("timestamp")


def quote_projection(lineitem: DataFrame) -> DataFrame:
    """Quotes from line items; works on batch and streaming frames alike."""
    kind = F.col("l_linenumber") % 3
    disc = F.round(F.col("l_discount") * 100).cast("int")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    market = (
        F.when(kind == 0, "1x2").when(kind == 1, "goals_total")
        .when(F.col("l_linenumber") == 5, "corners_team").otherwise("corners_total")
    )
    selection = (
        F.when((kind == 0) & (F.col("l_returnflag") == "A"), "home")
        .when((kind == 0) & (F.col("l_returnflag") == "N"), "draw")
        .when(kind == 0, "away")
        .when(F.col("l_linestatus") == "O", "over").otherwise("under")
    )
    cents = F.when(kind == 0, 150 + 18 * disc + 7 * tax).otherwise(120 + 8 * disc + 3 * tax)
    part = F.col("l_partkey").cast("string")
    book = F.concat(F.lit("book_"), (F.col("l_suppkey") % 6).cast("string"))
    return lineitem.select(
        book.alias("bookmaker"),
        F.when(F.col("l_partkey") % 4 == 0, "basketball").otherwise("football").alias("sport"),
        F.concat(F.lit("League "), (F.col("l_partkey") % 10).cast("string")).alias("competition"),
        part.alias("match_id"),
        F.concat(F.lit("Home "), part).alias("home_team"),
        F.concat(F.lit("Away "), part).alias("away_team"),
        F.timestamp_seconds(F.lit(820454400) + (F.col("l_partkey") % 2000) * 86400 + 64800).alias("start_time"),
        market.alias("market_type"),
        F.when(kind == 0, 3).otherwise(2).alias("n_outcomes"),
        selection.alias("selection"),
        F.when(kind != 0, 0.5 + (F.col("l_quantity").cast("int") % 3)).cast("double").alias("line"),
        F.when(F.col("l_linenumber") == 5, F.when(F.col("l_quantity").cast("int") % 2 == 0, "home").otherwise("away"))
        .alias("team_scope"),
        (cents / 100.0).cast("double").alias("odds"),
        F.concat(F.lit("https://"), book, F.lit(".example/e/"), part).alias("url"),
        _ts(F.col("l_shipdate")).alias("scraped_at"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 10000 + F.col("l_suppkey") % 10000).alias("ingest_seq"),
    ).select(*QUOTE_COLUMNS)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_projection(table(spark, sf_dir, "lineitem"))


def spread_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_projection(spread(table(spark, sf_dir, "lineitem"), "l_orderkey"))


# The same projection for the SQL engine that checks results.
QUOTES_SQL = """
quotes AS (
  SELECT concat('book_', l_suppkey % 6) AS bookmaker,
    CASE WHEN l_partkey % 4 = 0 THEN 'basketball' ELSE 'football' END AS sport,
    concat('League ', l_partkey % 10) AS competition,
    CAST(l_partkey AS VARCHAR) AS match_id,
    concat('Home ', l_partkey) AS home_team, concat('Away ', l_partkey) AS away_team,
    TIMESTAMP '1996-01-01 18:00:00' + to_days(CAST(l_partkey % 2000 AS INTEGER)) AS start_time,
    CASE WHEN l_linenumber % 3 = 0 THEN '1x2' WHEN l_linenumber % 3 = 1 THEN 'goals_total'
         WHEN l_linenumber = 5 THEN 'corners_team' ELSE 'corners_total' END AS market_type,
    CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE 2 END AS n_outcomes,
    CASE WHEN l_linenumber % 3 = 0 THEN CASE l_returnflag WHEN 'A' THEN 'home' WHEN 'N' THEN 'draw' ELSE 'away' END
         ELSE CASE l_linestatus WHEN 'O' THEN 'over' ELSE 'under' END END AS selection,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(0.5 + CAST(l_quantity AS INTEGER) % 3 AS DOUBLE) END AS line,
    CASE WHEN l_linenumber = 5 THEN CASE WHEN CAST(l_quantity AS INTEGER) % 2 = 0 THEN 'home' ELSE 'away' END END
      AS team_scope,
    CAST(CASE WHEN l_linenumber % 3 = 0
      THEN 150 + 18 * CAST(round(l_discount * 100) AS INTEGER) + 7 * CAST(round(l_tax * 100) AS INTEGER)
      ELSE 120 + 8 * CAST(round(l_discount * 100) AS INTEGER) + 3 * CAST(round(l_tax * 100) AS INTEGER) END
      AS DOUBLE) / 100.0 AS odds,
    concat('https://book_', l_suppkey % 6, '.example/e/', l_partkey) AS url,
    l_shipdate AS scraped_at,
    (l_orderkey * 8 + l_linenumber) * 10000 + l_suppkey % 10000 AS ingest_seq
  FROM lineitem)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations from events."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id",
        F.col("event_type").alias("bookmaker"),
        F.col("user_id").cast("string").alias("match_id"),
        _ts(F.col("ts")).alias("ts"),
        (1.01 + F.col("value") / 50).alias("price"),
        (k % 3).alias("pick"),
        (k / 100.0).alias("confidence"),
    )


def collection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection cycles from events: ``error`` events are failures."""
    return log_projection(table(spark, sf_dir, "events"))


def log_projection(events: DataFrame) -> DataFrame:
    ok = F.col("event_type") != "error"
    return events.select(
        "event_id",
        F.concat(F.lit("book_"), (F.col("user_id") % 5).cast("string")).alias("bookmaker"),
        _ts(F.col("ts")).alias("ts"),
        ok.alias("ok"),
        F.when(ok, F.floor("value")).otherwise(0).cast("bigint").alias("n_quotes"),
        F.when(~ok, "unavailable").alias("reason"),
    )


LOG_SQL = """
log AS (
  SELECT event_id, concat('book_', user_id % 5) AS bookmaker, ts, event_type <> 'error' AS ok,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS n_quotes,
    event_type, value
  FROM events)"""



def team_name(part_name: Column, variant: Column) -> Column:
    """A spelling variant of a part name as a team name."""
    forms = [
        F.concat(F.lit("FC "), part_name), F.concat(part_name, F.lit(" United")),
        F.concat(part_name, F.lit(" U-23")), part_name, F.concat(F.initcap(part_name), F.lit(" Reserves")),
    ]
    return F.get(F.array(*forms), variant.cast("int"))


TEAM_NAME_SQL = """CASE {v} WHEN 0 THEN concat('FC ', {n}) WHEN 1 THEN concat({n}, ' United')
  WHEN 2 THEN concat({n}, ' U-23') WHEN 3 THEN {n}
  ELSE concat(upper(substr(split_part({n}, ' ', 1), 1, 1)), substr(split_part({n}, ' ', 1), 2), ' ',
              upper(substr(split_part({n}, ' ', 2), 1, 1)), substr(split_part({n}, ' ', 2), 2), ' Reserves') END"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member profiles from customers."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    role = (
        F.when(key % 97 == 0, "admin").when(key % 53 == 0, "publisher").when(key % 41 == 0, "moderator")
        .otherwise("user")
    )
    domain = F.when(key % 3 == 0, "gmail.com").when(key % 3 == 1, "googlemail.com").otherwise("mail.example")
    return c.select(
        key.alias("id"),
        F.concat(
            F.lit("User."), (key - key % 2).cast("string"),
            F.when(key % 2 == 1, "+promo").otherwise(""), F.lit("@"), domain,
        ).alias("email"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("Name"), (key - key % 5).cast("string"),
                                                             F.when(key % 5 == 0, "").otherwise("x"))).alias("username"),
        role.alias("role"),
        F.when(key % 7 == 0, "pending").otherwise("active").alias("status"),
        F.timestamp_seconds(F.lit(788918400) + key % 2000 * 86400).alias("created_at"),
        F.when(F.col("c_acctbal") > 0, F.timestamp_seconds(
            F.lit(946684800) + F.floor(F.col("c_acctbal")).cast("bigint") * 3600 * 2)).alias("sub_expires_at"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("sub_plan"),
    )


PROFILES_SQL = """
profiles AS (
  SELECT c_custkey AS id,
    concat('User.', c_custkey - c_custkey % 2, CASE WHEN c_custkey % 2 = 1 THEN '+promo' ELSE '' END, '@',
      CASE c_custkey % 3 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'googlemail.com' ELSE 'mail.example' END) AS email,
    CASE WHEN c_custkey % 11 <> 0 THEN concat('Name', c_custkey - c_custkey % 5,
      CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'x' END) END AS username,
    CASE WHEN c_custkey % 97 = 0 THEN 'admin' WHEN c_custkey % 53 = 0 THEN 'publisher'
         WHEN c_custkey % 41 = 0 THEN 'moderator' ELSE 'user' END AS role,
    CASE WHEN c_custkey % 7 = 0 THEN 'pending' ELSE 'active' END AS status,
    TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) AS created_at,
    CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2000-01-01' + to_hours(2 * CAST(floor(c_acctbal) AS BIGINT)) END
      AS sub_expires_at,
    CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS sub_plan
  FROM customer)"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment requests from orders."""
    o = table(spark, sf_dir, "orders")
    at = _ts(F.col("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "P", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("Name"), F.col("o_custkey").cast("string")).alias("username"),
        status.alias("status"),
        at.alias("created_at"),
        F.when(F.col("o_orderkey") % 2 == 0, at + F.expr("INTERVAL 6 HOURS")).alias("reviewed_at"),
    )


PAYMENTS_SQL = """
payments AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, concat('Name', o_custkey) AS username,
    CASE o_orderstatus WHEN 'P' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
    o_orderdate AS created_at,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 6 HOURS END AS reviewed_at
  FROM orders)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published signals: one per line item shipped in small quantities."""
    li = table(spark, sf_dir, "lineitem")
    at = _ts(F.col("l_shipdate")) + F.make_dt_interval(hours=F.col("l_linenumber"))
    legs = F.concat(
        F.lit('[{"odd": '), (F.round(F.col("l_discount") * 100).cast("int") + 150).cast("string"), F.lit("e-2}, "),
        F.when(F.col("l_linenumber") == 7, F.lit('{"odd": "none"}')).otherwise(
            F.concat(F.lit('{"odd": '), (F.round(F.col("l_tax") * 100).cast("int") * 30 + 140).cast("string"),
                     F.lit("e-2}"))),
        F.when(F.col("l_linenumber") == 6, F.lit("")).otherwise(F.lit("]")),
    )
    return li.select(
        F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 7).alias("author_id"),
        F.concat(F.lit("Signal "), F.col("l_partkey").cast("string")).alias("title"),
        F.when(F.col("l_linenumber") == 5, F.lit('{"odd": 2}')).otherwise(legs).alias("legs"),
        F.round(F.col("l_discount") * 100 + F.col("l_tax") * 100, 2).cast("decimal(18,2)").alias("roi"),
        at.alias("created_at"),
        F.when(F.col("l_linenumber") % 4 != 0,
               at + F.make_dt_interval(mins=F.col("l_quantity").cast("int") * 4 - 20)).alias("expires_at"),
    )


SIGNALS_SQL = """
signals AS (
  SELECT l_orderkey AS id, l_suppkey % 7 AS author_id, concat('Signal ', l_partkey) AS title,
    CASE WHEN l_linenumber = 5 THEN '{"odd": 2}' ELSE concat('[{"odd": ', CAST(round(l_discount * 100) AS INTEGER) + 150, 'e-2}, ',
      CASE WHEN l_linenumber = 7 THEN '{"odd": "none"}'
           ELSE concat('{"odd": ', CAST(round(l_tax * 100) AS INTEGER) * 30 + 140, 'e-2}') END,
      CASE WHEN l_linenumber = 6 THEN '' ELSE ']' END) END AS legs,
    CAST(round(l_discount * 100 + l_tax * 100, 2) AS DECIMAL(18,2)) AS roi,
    l_shipdate + to_hours(l_linenumber) AS created_at,
    CASE WHEN l_linenumber % 4 <> 0
      THEN l_shipdate + to_hours(l_linenumber) + to_minutes(CAST(l_quantity AS INTEGER) * 4 - 20) END AS expires_at,
    l_linenumber, l_discount, l_tax
  FROM lineitem)"""


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets from orders, the amount inside a JSON payload."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "won").otherwise("open").alias("status"),
        _ts(F.col("o_orderdate")).alias("created_at"),
        F.to_json(F.struct(F.round(F.col("o_totalprice") - 150000, 2).alias("profit"))).alias("payload"),
    )


BETS_SQL = """
bets AS (
  SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'won' ELSE 'open' END AS status,
    o_orderdate AS created_at, round(o_totalprice - 150000, 2) AS profit
  FROM orders)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages from conversations."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id"), F.col("turn"), (F.col("conv_id") % 150).alias("user_id"),
        F.when(F.col("conv_id") % 3 == 0, "surebets").when(F.col("conv_id") % 3 == 1, "general").alias("room"),
        "text",
    )


MESSAGES_SQL = """
messages AS (
  SELECT conv_id, turn, conv_id % 150 AS user_id,
    CASE conv_id % 3 WHEN 0 THEN 'surebets' WHEN 1 THEN 'general' END AS room, text
  FROM conversations)"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of members: a user's events of one type and day part are one session."""
    ev = table(spark, sf_dir, "events")
    sid = F.concat_ws("-", F.col("event_type"), (F.hour(_ts(F.col("ts"))) % 4).cast("string"))
    return ev.groupBy("user_id", sid.alias("session_id")).agg(
        F.min(_ts(F.col("ts"))).alias("first_seen"), F.max(_ts(F.col("ts"))).alias("last_seen")
    )


DEVICES_SQL = """
devices AS (
  SELECT user_id, concat(event_type, '-', hour(ts) % 4) AS session_id, min(ts) AS first_seen, max(ts) AS last_seen
  FROM events GROUP BY 1, 2)"""


def stamp(col: Column) -> Column:
    """A time stamp as text, the form results are compared in."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def canonical_mail_sql(col: str) -> str:
    return (
        f"CASE WHEN split_part(lower({col}), '@', 2) IN ('gmail.com', 'googlemail.com') THEN "
        f"concat(replace(split_part(split_part(lower({col}), '@', 1), '+', 1), '.', ''), '@gmail.com') "
        f"ELSE lower({col}) END"
    )




BRAND_NAMES = {"book_0": "1xBet", "book_1": "MelBet", "book_2": "Line Bet"}


def branded(quotes_df: DataFrame) -> DataFrame:
    """Quotes with three bookmakers named as the fixed owner table names them."""
    name = F.col("bookmaker")
    for book, brand in BRAND_NAMES.items():
        name = F.when(F.col("bookmaker") == book, brand).otherwise(name)
    return quotes_df.withColumn("bookmaker", name)


def spelled(quotes_df: DataFrame, parts: DataFrame) -> DataFrame:
    """The quotes with matches named after parts, the home team spelled the bookmaker's way, two of them alike."""
    p = parts.select(F.col("p_partkey").alias("l_partkey"), "p_name", F.concat_ws(" ", F.col("p_brand"), F.col("p_type")).alias("away"))
    joined = quotes_df.alias("q").join(p, F.col("q.match_id").cast("bigint") == p["l_partkey"])
    form = F.get(F.array(*[F.lit(x) for x in (0, 3, 3, 2, 4, 1)]), F.right(F.col("bookmaker"), F.lit(1)).cast("int"))
    start = F.timestamp_seconds(F.lit(820454400) + (F.col("l_partkey") % 365) * 86400 + 64800)
    return branded(
        joined.withColumn("home_team", team_name(F.col("p_name"), form)).withColumn("away_team", F.col("away"))
        .withColumn("start_time", start)
        .withColumn("match_id", make_match_id(F.col("home_team"), F.col("away_team"), F.col("start_time")))
        .select(*quotes_df.columns))


def spelled_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(spread_quotes(spark, sf_dir), table(spark, sf_dir, "part"))


def season_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes pooled by fixture (twenty parts) and year: one detection cycle a year."""
    number = F.floor(F.col("match_id").cast("bigint") / 20).cast("bigint")
    q = branded(quotes(spark, sf_dir)).withColumn("fixture", number)
    fixture, name = F.col("fixture"), F.col("fixture").cast("string")
    return (
        q.withColumn("sport", F.when(fixture % 4 == 0, "basketball").otherwise("football"))
        .withColumn("match_id", F.concat(name, F.lit("@"), F.year("scraped_at").cast("string")))
        .withColumn("home_team", F.concat(F.lit("Home "), name))
        .withColumn("away_team", F.concat(F.lit("Away "), name))
        .withColumn("url", F.concat(F.lit("https://x.example/?a=1&b="), F.col("bookmaker")))
        .withColumn("start_time", F.timestamp_seconds(F.lit(820454400) + (fixture % 2000) * 86400 + 64800))
        .drop("fixture")
    )


def season_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities of the yearly pools with an id, a time, stakes and a score."""
    from ..operators.alerts import score_opportunity
    from ..operators.arbitrage import evaluate

    opp = evaluate(season_quotes(spark, sf_dir), bankroll=1000.0, reconcile=False)
    fixture = F.split_part(F.col("match_id"), F.lit("@"), F.lit(1)).cast("bigint")
    year = F.split_part(F.col("match_id"), F.lit("@"), F.lit(2)).cast("bigint")
    market = F.when(F.col("market_type") == "1x2", 0).when(F.col("market_type") == "goals_total", 1).when(
        F.col("market_type") == "corners_total", 2).otherwise(3)
    line = F.coalesce(F.col("line") * 2, F.lit(0.0)).cast("bigint") * 4
    scope = F.when(F.col("team_scope") == "home", 1).when(F.col("team_scope") == "away", 2).otherwise(0)
    ident = ((fixture * 100 + (year - 1990)) * 4 + market) * 64 + line + scope
    at = F.make_timestamp(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(
        F.col("id") % 300, F.lit(0), F.lit(0), (F.col("id") % 86400).cast("decimal(18,6)"))
    dated = opp.withColumn("id", ident).withColumn("detected_at", at)
    age = F.make_dt_interval(secs=(F.col("id") % 120).cast("decimal(18,6)"))
    scored = score_opportunity(dated, F.col("detected_at") + age)
    verdicts = F.array(*[F.lit(v) for v in ("ok", "partie", "fausse", "marche", "match", "doute", "detected")])
    return scored.withColumn("status", F.get(verdicts, (F.col("id") % 7).cast("int")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history: every detection, a third seen again, half of those at a new price."""
    from ..operators.history import legs_to_wide

    first = legs_to_wide(season_opportunities(spark, sf_dir), ["id"]).withColumn("copy", F.lit(0))
    twice = F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    again = first.drop("copy").withColumn("copy", twice)
    moved = (F.col("copy") == 1) & (F.col("id") % 2 == 0)
    return cut_lineage(
        again.withColumn("cote_a", F.when(moved, F.round(F.col("cote_a") + 0.05, 2)).otherwise(F.col("cote_a")))
        .withColumn("date_detection", F.when(
            F.col("copy") == 1, F.col("date_detection") + F.expr("INTERVAL 2 HOURS")).otherwise(F.col("date_detection")))
        .withColumn("id", F.col("id") * 2 + F.col("copy")), "history")
