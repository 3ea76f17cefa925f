"""Normalisation and validation N01-N13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.labels import normalize_market_label
from ..operators import normalize as N
from ..sources import adapters as src
from ..sources.feeds import values_dim
from .common import QUOTES_SQL, global_walk_sql
from .label_cases import AWAY, CASES, HOME, sql_values
from .registry import query, with_ctes


@query("n01_normalize_team_name", """
SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents""")
def fold(spark, sf_dir):
    d = src.spread(src.table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", F.md5(X.normalize_team_name(F.col("text"))).alias("folded"))


@query("n02_make_match_id", """
SELECT doc_id, substr(sha1(concat(n, '|', lang, '|', strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id), '%Y-%m-%d'))), 1, 16) AS match_id
FROM (SELECT doc_id, lang, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents)""")
def match_id(spark, sf_dir):
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return src.table(spark, sf_dir, "documents").select(
        "doc_id", X.make_match_id(F.col("text"), F.col("lang"), start).alias("match_id"))


def _bent(spark, sf_dir):
    q = src.quotes(spark, sf_dir)
    seq = F.col("ingest_seq")
    return q.select(
        "ingest_seq", "bookmaker", F.when(seq % 13 == 0, 4).otherwise(F.col("n_outcomes")).alias("n_outcomes"),
        F.when(seq % 17 == 0, "both").otherwise(F.col("selection")).alias("selection"),
        F.when(seq % 19 == 0, "left").otherwise(F.col("team_scope")).alias("team_scope"), (F.col("odds") - 0.3).alias("odds"))


@query("n03_quote_contract", with_ctes(QUOTES_SQL, """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN ingest_seq % 13 = 0 THEN 'n_outcomes' WHEN ingest_seq % 17 = 0 THEN 'selection'
  WHEN ingest_seq % 19 = 0 THEN 'team_scope' WHEN odds - 0.3 <= 1 THEN 'odds' ELSE 'valid' END AS reason FROM quotes) GROUP BY 1"""))
def contract(spark, sf_dir):
    good, bad = N.quote_contract(_bent(spark, sf_dir))
    both = good.withColumn("reason", F.lit("valid")).unionByName(bad)
    return both.groupBy("reason").agg(F.count("*").alias("n"))


@query("n04_parse_odds_value", """
SELECT DISTINCT l_quantity, l_linenumber % 4 AS form, CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_quantity / 20 > 1
  THEN round(l_quantity / 20, 6) END AS odds FROM lineitem""")
def parse(spark, sf_dir):
    kind, q = F.col("l_linenumber") % 4, F.col("l_quantity") / 20
    plain = F.format_string("%.2f", q)
    raw = (
        F.when(kind == 0, F.translate(plain, ".", ",")).when(kind == 1, F.concat(F.lit("  "), plain, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("0 0"), plain)).otherwise("N/A")
    )
    rows = src.table(spark, sf_dir, "lineitem").select("l_quantity", kind.alias("form"), raw.alias("raw"))
    return rows.select("l_quantity", "form", F.round(X.parse_odds_value(F.col("raw")), 6).alias("odds")).distinct()


CASE_SQL = f"cases AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {sql_values(CASES)}) t(m, s, market, pick, line, scope, sport))"


def _labelled(spark, sf_dir):
    """Every line item shown under one of the label cases (a fixed list, broadcast)."""
    cases = values_dim(spark, ["i", "market_label", "selection_label", "sport"], [(i, c[0], c[1], c[6]) for i, c in enumerate(CASES)])
    li = src.spread(src.table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("i", (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(CASES))
    return li.join(F.broadcast(cases), "i").withColumn("home_team", F.lit(HOME)).withColumn("away_team", F.lit(AWAY))


SURE = f"(SELECT l.*, c.* FROM lineitem l JOIN cases c ON c.i = (l_orderkey * 7 + l_linenumber) % {len(CASES)})"


@query("n06_normalize_market_label", with_ctes(CASE_SQL, f"""
SELECT m AS market_label, s AS selection_label, market AS market_type, pick AS selection, line, scope AS team_scope, count(*) AS n
FROM {SURE} GROUP BY ALL"""))
def label(spark, sf_dir):
    rows = normalize_market_label(_labelled(spark, sf_dir))
    sure = F.col("mapping.confidence") >= 0.9
    return rows.select(
        "market_label", "selection_label",
        *[F.when(sure, F.col(f"mapping.{c}")).alias(c) for c in ("market_type", "selection", "line", "team_scope")],
    ).groupBy("market_label", "selection_label", "market_type", "selection", "line", "team_scope").agg(F.count("*").alias("n"))


@query("n05_raw_to_quotes", with_ctes(CASE_SQL, f"""
SELECT market AS market_type, pick AS selection, line, scope AS team_scope, round(l_quantity / 20, 6) AS odds,
  substr(sha1(concat('{HOME.lower()}|{AWAY.lower()}|', strftime(l_shipdate, '%Y-%m-%d'))), 1, 16) AS match_id
FROM {SURE} WHERE market IS NOT NULL AND l_quantity / 20 > 1"""))
def raw_quotes(spark, sf_dir):
    raw = _labelled(spark, sf_dir).select(
        *N.LABEL_COLS, F.translate(F.format_string("%.2f", F.col("l_quantity") / 20), ".", ",").alias("odds_text"),
        F.col("l_shipdate").cast("timestamp").alias("start_time"))
    q = N.raw_to_quotes(raw)
    return q.select("market_type", "selection", "line", "team_scope", F.round("odds", 6).alias("odds"), "match_id")


@query("n07_team_scope_in_label", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'home' WHEN p_partkey % 3 = 1 THEN
  CASE WHEN h = a THEN 'home' ELSE 'away' END END AS team_scope
FROM (SELECT p_partkey, p_name AS h, concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) AS a FROM part)""")
def scope(spark, sf_dir):
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    df = src.spread(src.table(spark, sf_dir, "part"), "p_partkey").select(
        k, F.col("p_name").alias("home"), F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0))).alias("away"))
    label = F.when(k % 3 == 0, F.concat(F.lit("Total de buts de "), "home")).when(
        k % 3 == 1, F.concat(F.lit("Total de buts de "), "away")).otherwise("Quelque match 1ere mi-temps")
    return N.team_scope_in_label(df.withColumn("label", label), "label", "home", "away").select("p_partkey", "team_scope")


@query("n08_normalization_cache_join", with_ctes(CASE_SQL, f"""
SELECT m AS market_label, s AS selection_label, CASE WHEN market IS NULL AND i % 2 = 0 THEN 'cache' ELSE 'rule' END AS source,
  CASE WHEN market IS NOT NULL THEN market WHEN i % 2 = 0 THEN concat('cached_', i) END AS market_type, count(*) AS n
FROM {SURE} GROUP BY ALL"""))
def cache(spark, sf_dir):
    labels = normalize_market_label(_labelled(spark, sf_dir))
    known = values_dim(spark, ["i", "market_label", "selection_label", "sport"], [(i, c[0], c[1], c[6]) for i, c in enumerate(CASES) if i % 2 == 0])
    stored = N.with_cache_key(known.select(
        "*", F.lit(HOME).alias("home_team"), F.lit(AWAY).alias("away_team"))).select(
        F.col("cache_key"), F.concat(F.lit("cached_"), F.col("i").cast("string")).alias("market_type"), F.lit("over").alias("selection"),
        F.lit(1.5).alias("line"), F.lit(None).cast("string").alias("team_scope"), F.lit(0.8).alias("confidence"))
    out = N.normalization_cache_join(labels, stored)
    # An unsure rule result that no cache entry replaces stays as it is; only sure ones are compared.
    named = F.when((F.col("source") == "cache") | (F.col("mapping.confidence") >= 0.9), F.col("mapping.market_type"))
    return out.groupBy("market_label", "selection_label", "source", named.alias("market_type")).agg(F.count("*").alias("n"))


def _replies(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_type")
    good = F.concat(
        F.lit('Voici: {"market_type": "goals_total", "selection": "'), F.when(k % 3 == 0, "over").when(k % 3 == 1, "home").otherwise("both"),
        F.lit('", "line": '), F.when(k % 2 == 0, "2.5").otherwise("null"), F.lit(', "confidence": '), (k / 80.0).cast("string"), F.lit("} merci"))
    reply = F.when(e == "error", "pas de json").when(e == "signup", '{"market_type": "", "selection": "over", "confidence": 0.5}').when(
        e == "view", '{"market_type": "x", "selection": "over"').otherwise(good)
    return src.table(spark, sf_dir, "events").select("event_id", k.alias("k"), reply.alias("reply"))


REPLY_SQL = """
rep AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type IN ('click', 'purchase') AS good FROM events),
val AS (SELECT event_id, k, good AND k % 3 < 2 AND k / 80 <= 1 AS ok FROM rep)"""


@query("n09_llm_reply_validate", with_ctes(REPLY_SQL, """
SELECT event_id, CASE WHEN ok THEN 'goals_total' END AS market_type, CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 'over' ELSE 'home' END END AS selection,
  CASE WHEN ok THEN CASE k % 3 WHEN 0 THEN 2 ELSE 3 END END AS n_outcomes, CASE WHEN ok AND k % 2 = 0 THEN 2.5 END AS line,
  CASE WHEN ok THEN round(k / 80, 6) END AS confidence FROM val"""))
def reply(spark, sf_dir):
    r = _replies(spark, sf_dir).withColumn("m", N.reply_validate(F.col("reply")))
    return r.select("event_id", "m.market_type", "m.selection", "m.n_outcomes", "m.line", F.round("m.confidence", 6).alias("confidence"))


@query("n10_pick_best_mapping", with_ctes(REPLY_SQL, """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN ok THEN 'goals_total' END
  WHEN ok AND k / 80 > 0.5 THEN 'goals_total' ELSE 'rule' END AS market_type FROM val"""))
def best(spark, sf_dir):
    rule = F.when(F.col("event_id") % 4 != 0, F.struct(
        F.lit("rule").alias("market_type"), F.lit("over").alias("selection"), F.lit(2).alias("n_outcomes"),
        F.lit(None).cast("double").alias("line"), F.lit(None).cast("string").alias("team_scope"), F.lit(0.5).alias("confidence")))
    m = N.pick_best_mapping(rule, N.reply_validate(F.col("reply")))
    return _replies(spark, sf_dir).select("event_id", m["market_type"].alias("market_type"))


@query("n11_hourly_budget_flag", """
WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT event_id, user_id, t, rn, TRUE AS granted, [t] AS open FROM r WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.user_id, n.t, n.rn, len(list_filter(w.open, lambda x: n.t - x <= 172800000000)) < 4,
    CASE WHEN len(list_filter(w.open, lambda x: n.t - x <= 172800000000)) < 4
      THEN list_append(list_filter(w.open, lambda x: n.t - x <= 172800000000), n.t)
      ELSE list_filter(w.open, lambda x: n.t - x <= 172800000000) END
  FROM walk w JOIN r n ON n.user_id = w.user_id AND n.rn = w.rn + 1)
SELECT event_id, granted FROM walk""")
def budget(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return N.hourly_budget_flag(ev, 4, ["user_id"], 2 * 86400, order="event_id").select("event_id", "granted")


@query("n11_global_budget", f"""
WITH RECURSIVE {global_walk_sql(20, 6 * 3600, ">")}
SELECT event_id, walk.rn IS NOT NULL AS granted FROM r LEFT JOIN walk USING (rn)""")
def global_budget(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events").select("event_id", "ts")
    return N.hourly_budget_flag(ev, 20, window_s=6 * 3600, order="event_id").select("event_id", "granted")


@query("n12_outcome_market_label", with_ctes(QUOTES_SQL, """
SELECT CASE WHEN selection IN ('over', 'under') THEN concat(CASE selection WHEN 'over' THEN 'Plus de ' ELSE 'Moins de ' END, line,
    CASE team_scope WHEN 'home' THEN ' dom.' WHEN 'away' THEN ' ext.' ELSE '' END)
  ELSE CASE selection WHEN 'home' THEN 'Victoire Domicile (1)' WHEN 'draw' THEN 'Nul (X)' ELSE 'Victoire Extérieur (2)' END END AS outcome,
  CASE market_type WHEN '1x2' THEN '3-Way (1X2)' WHEN 'goals_total' THEN concat('Total buts ', line)
    WHEN 'corners_total' THEN concat('Total corners ', line) ELSE 'Corners équipe' END AS market, count(*) AS n FROM quotes GROUP BY ALL"""))
def labels(spark, sf_dir):
    q = src.quotes(spark, sf_dir)
    return q.groupBy(
        X.outcome_label(F.col("selection"), F.col("line"), F.col("team_scope")).alias("outcome"),
        X.market_label(F.col("market_type"), F.col("line")).alias("market"),
    ).agg(F.count("*").alias("n"))


@query("n13_ambiguous_queue", with_ctes(CASE_SQL, f"""
SELECT concat('football|', lower(m), '|', lower(s), '|{HOME.lower()}|{AWAY.lower()}') AS cache_key, m AS market_label, s AS selection_label, count(*) AS n
FROM {SURE} WHERE market IS NULL GROUP BY ALL"""))
def queue(spark, sf_dir):
    return N.ambiguous_queue(normalize_market_label(_labelled(spark, sf_dir)))
