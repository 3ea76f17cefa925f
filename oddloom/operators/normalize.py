"""Labels and raw rows -> validated quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..functions import text
from ..functions.labels import normalize_market_label, team_scope_score
from ..schemas import MAPPING_TYPE, as_quotes
from ..session import cut_lineage
from .budget import grant

LABEL_COLS = ["sport", "market_label", "selection_label", "home_team", "away_team"]


def contract_reason() -> Column:
    """Why a row is not a quote, NULL when it is one."""
    return (
        F.when(~F.coalesce(F.col("n_outcomes").isin(2, 3), F.lit(False)), "n_outcomes")
        .when(~F.coalesce(F.col("selection").isin(C.SELECTIONS), F.lit(False)), "selection")
        .when(F.col("team_scope").isNotNull() & ~F.col("team_scope").isin(C.TEAM_SCOPES), "team_scope")
        .when(~F.coalesce(F.col("odds") > 1.0, F.lit(False)), "odds")
    )


def quote_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their reason."""
    marked = df.withColumn("reason", contract_reason())
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def team_scope_in_label(df: DataFrame, label: str, home: str, away: str, threshold: int = C.MATCH_THRESHOLD) -> DataFrame:
    """Add the team a label names."""
    return df.withColumn("team_scope", team_scope_score(F.col(label), F.col(home), F.col(away), threshold))


def raw_to_quotes(raw: DataFrame) -> DataFrame:
    """Raw market rows (one selection each, with match columns) -> quotes.

    Unreadable prices, labels under the confidence bound and rows outside the
    contract are left out.
    """
    rows = raw.withColumn("odds", text.parse_odds_value(F.col("odds_text"))).filter(F.col("odds").isNotNull())
    mapped = normalize_market_label(rows).filter(F.col("mapping.confidence") >= C.CONFIDENCE_THRESHOLD)
    fields = [f.name for f in MAPPING_TYPE.fields if f.name != "confidence"]
    flat = mapped.select(
        *[c for c in mapped.columns if c not in ("mapping", *fields)], *[F.col(f"mapping.{f}").alias(f) for f in fields]
    ).withColumn("match_id", text.make_match_id(F.col("home_team"), F.col("away_team"), F.col("start_time")))
    return as_quotes(quote_contract(flat)[0])


def with_cache_key(labels: DataFrame) -> DataFrame:
    return labels.withColumn("cache_key", text.cache_key(*[F.col(c) for c in LABEL_COLS]))


def normalization_cache_join(labels: DataFrame, cache: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Rule mappings at or over the threshold stand; others take the cached one.

    ``labels`` carries the rule result as ``mapping``. Confident rows bypass
    the join, so the shuffled side holds only the unsettled labels. The labels
    are written once: both ways start from their rule result.
    """
    labels = cut_lineage(labels, "labels")
    sure = F.coalesce(F.col("mapping.confidence") >= threshold, F.lit(False))
    settled = labels.filter(sure).withColumn("cache_key", F.lit(None).cast("string")).withColumn("source", F.lit("rule"))
    n = F.when(F.col("c_selection").isin("home", "draw", "away"), 3).otherwise(2)
    cached = F.struct(
        F.col("c_market").alias("market_type"), F.col("c_selection").alias("selection"), n.alias("n_outcomes"),
        F.col("c_line").alias("line"), F.col("c_scope").alias("team_scope"), F.col("c_confidence").alias("confidence"))
    side = cache.select(
        "cache_key", F.col("market_type").alias("c_market"), F.col("selection").alias("c_selection"),
        F.col("line").alias("c_line"), F.col("team_scope").alias("c_scope"), F.col("confidence").alias("c_confidence"))
    open_rows = with_cache_key(labels.filter(~sure)).join(side, "cache_key", "left")
    hit = F.col("c_market").isNotNull()
    looked_up = open_rows.withColumn("mapping", F.when(hit, cached).otherwise(F.col("mapping"))).withColumn(
        "source", F.when(hit, "cache").otherwise("rule"))
    return settled.unionByName(looked_up.select(*settled.columns))


def reply_validate(reply: Column) -> Column:
    """Mapping in a model's reply text, NULL unless it is complete and in range."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    doc = F.try_parse_json(body)

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(doc, f"$.{name}", kind)

    def is_text(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(field(name, "variant")) == "STRING", F.lit(False))

    def absent(name: str) -> Column:
        v = field(name, "variant")
        return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))

    market, selection, confidence = field("market_type", "string"), field("selection", "string"), field("confidence", "double")
    ok = (
        is_text("market_type") & F.length(market).between(1, 64) & is_text("selection")
        & selection.isin(C.SELECTIONS) & confidence.between(0.0, 1.0)
        & (absent("line") | field("line", "double").isNotNull())
        & (absent("team_scope") | is_text("team_scope"))
    )
    mapping = F.struct(
        market.alias("market_type"), selection.alias("selection"),
        F.when(selection.isin("home", "draw", "away"), 3).otherwise(2).alias("n_outcomes"),
        field("line", "double").alias("line"),
        F.when(absent("team_scope"), F.lit(None)).otherwise(field("team_scope", "string")).alias("team_scope"),
        confidence.alias("confidence"),
    ).cast(MAPPING_TYPE)
    return F.when(F.coalesce(ok, F.lit(False)), mapping)


def pick_best_mapping(rule: Column, other: Column) -> Column:
    """The reply wins only with strictly more confidence, or without a rule."""
    return F.when(
        rule.isNull() | F.coalesce(other["confidence"] > rule["confidence"], F.lit(False)), other
    ).otherwise(rule)


def hourly_budget_flag(
    requests: DataFrame, max_per_window: int, by: list[str] | None = None, window_s: int = 3600, keep_edge: bool = True,
    order: str = "id",
) -> DataFrame:
    """Add ``granted``: at most so many granted requests in any trailing window; a denied one does not consume."""
    return grant(requests, max_per_window, by, window_s, keep_edge, order)


def ambiguous_queue(labels: DataFrame, threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """Labels no rule settles, once per cache key with how often they occur."""
    open_rows = labels.filter(~F.coalesce(F.col("mapping.confidence") >= threshold, F.lit(False)))
    return with_cache_key(open_rows).groupBy("cache_key").agg(
        F.min("market_label").alias("market_label"), F.min("selection_label").alias("selection_label"), F.count("*").alias("n")
    )
