"""Stake planning K01-K08, over every best combination of the pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import arbitrage as A
from ..schemas import MARKET_KEYS
from ..sources import adapters as src
from .common import COMBOS_SQL, QUOTES_SQL, K
from .registry import query, with_ctes


def _prices(spark, sf_dir):
    c = A.best_combos(src.quotes(spark, sf_dir))
    return c.select(*MARKET_KEYS, A.leg_odds(F.col("legs")).alias("odds"), F.transform(
        "legs", lambda x: x["bookmaker"]).alias("books"))


def _three(col, name):
    return [F.round(F.get(col, F.lit(i)), 6).alias(f"{name}{i + 1}") for i in range(3)]


def _sql(body: str, inner: str = "SELECT * FROM combos") -> str:
    return with_ctes(QUOTES_SQL, COMBOS_SQL, f"SELECT {K}, {body} FROM ({inner})")


RAW = "SELECT *, " + ", ".join(f"1000 / (odds{i} * margin) AS s{i}" for i in (1, 2, 3)) + " FROM combos"
EVEN0 = "SELECT *, " + ", ".join(f"round_even(1000 / (odds{i} * margin), 0) AS s{i}" for i in (1, 2, 3)) + " FROM combos"


def _cols(fmt: str, name: str) -> str:
    return ", ".join(f"{fmt.format(i=i)} AS {name}{i}" for i in (1, 2, 3))


@query("k01_split_stakes", _sql(_cols("round_even(s{i}, 1)", "stake"), RAW))
def split(spark, sf_dir):
    p = _prices(spark, sf_dir)
    return p.select(*MARKET_KEYS, *_three(O.split_stakes(F.col("odds"), 1000.0, 1), "stake"))


RESIDUAL = """
  CASE WHEN odds1 >= odds2 AND odds1 >= coalesce(odds3, 0) THEN 1000 - s2 - coalesce(s3, 0) ELSE s1 END AS stake1,
  CASE WHEN odds2 > odds1 AND odds2 >= coalesce(odds3, 0) THEN 1000 - s1 - coalesce(s3, 0) ELSE s2 END AS stake2,
  CASE WHEN odds3 > odds1 AND odds3 > odds2 THEN 1000 - s1 - s2 ELSE s3 END AS stake3"""


@query("k02_residual_adjust", _sql(RESIDUAL, EVEN0))
def residual(spark, sf_dir):
    p = _prices(spark, sf_dir)
    return p.select(*MARKET_KEYS, *_three(O.split_stakes(F.col("odds"), 1000.0, 0), "stake"))


@query("k03_guaranteed_profit", _sql("round(1000 * (1 / margin - 1), 6) AS profit"))
def profit(spark, sf_dir):
    p = _prices(spark, sf_dir)
    return p.select(*MARKET_KEYS, F.round(O.guaranteed_profit(1000.0, F.col("odds")), 6).alias("profit"))


ROUND1 = "SELECT *, " + ", ".join(f"round_even(1000 / (odds{i} * margin), 1) AS s{i}" for i in (1, 2, 3)) + " FROM combos"


@query("k04_gains_min_gain", _sql(
    _cols("round(s{i} * odds{i}, 6)", "gain") + ", round(least(s1 * odds1, s2 * odds2, s3 * odds3), 6) AS min_gain",
    ROUND1))
def gains(spark, sf_dir):
    p = _prices(spark, sf_dir).withColumn("stakes", O.split_stakes(F.col("odds"), 1000.0, 1))
    return p.select(
        *MARKET_KEYS, *_three(O.gains_per_leg(F.col("stakes"), F.col("odds")), "gain"),
        F.round(O.min_gain(F.col("stakes"), F.col("odds")), 6).alias("min_gain"))


LIMITS = "SELECT *, " + ", ".join(
    f"greatest(100.0 + 10 * CAST(right(bk{i}, 1) AS INTEGER), least(500.0, 1000 / (odds{i} * margin))) AS c{i}"
    for i in (1, 2, 3)) + " FROM combos"


@query("k05_clamp_limits", _sql(_cols("round(CASE WHEN odds{i} IS NOT NULL THEN c{i} END, 6)", "stake"), LIMITS))
def clamp(spark, sf_dir):
    p = _prices(spark, sf_dir).withColumn("stakes", O.split_stakes(F.col("odds"), 1000.0, None))
    lows = F.transform("books", lambda b: 100.0 + 10 * F.right(b, F.lit(1)).cast("int"))
    highs = F.transform("books", lambda _: F.lit(500.0))
    return p.select(*MARKET_KEYS, *_three(O.clamp_limits(F.col("stakes"), lows, highs), "stake"))


@query("k06_stakes_from_fixed", _sql(_cols(
    "round(250 * (CASE WHEN odds3 IS NULL THEN odds2 ELSE odds3 END) / odds{i}, 6)", "stake")))
def fixed(spark, sf_dir):
    p = _prices(spark, sf_dir)
    return p.select(*MARKET_KEYS, *_three(O.stakes_from_fixed(250.0, 7, F.col("odds")), "stake"))


@query("k07_round_to_step", _sql(_cols("floor(s{i} / 25 + 0.5) * 25", "stake"), RAW))
def step(spark, sf_dir):
    p = _prices(spark, sf_dir).withColumn("stakes", O.split_stakes(F.col("odds"), 1000.0, None))
    return p.select(*MARKET_KEYS, *_three(O.round_to_step(F.col("stakes"), 25), "stake"))


@query("k08_realized_outcome", _sql("""round(t, 6) AS total, round(w, 6) AS min_return, round(w - t, 6) AS profit,
  round((w - t) / t * 100, 6) AS roi""", f"""SELECT *, s1 + s2 + coalesce(s3, 0) AS t,
  least(s1 * odds1, s2 * odds2, s3 * odds3) AS w FROM ({ROUND1})"""))
def realized(spark, sf_dir):
    p = _prices(spark, sf_dir).withColumn("stakes", O.split_stakes(F.col("odds"), 1000.0, 1))
    r = p.withColumn("r", O.realized_outcome(F.col("stakes"), F.col("odds")))
    return r.select(*MARKET_KEYS, *[F.round(f"r.{c}", 6).alias(c) for c in ("total", "min_return", "profit", "roi")])
