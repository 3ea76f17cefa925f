"""Small builders of canonical rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from oddloom.schemas import QUOTE_SCHEMA

AS_OF = datetime(2026, 7, 24, 10, 0)
START = AS_OF + timedelta(days=2)


def quote_rows(rows, **common):
    """rows: (bookmaker, market, selection, line, odds[, extra dict])."""
    out = []
    for i, row in enumerate(rows):
        bookmaker, market, selection, line, odds = row[:5]
        extra = {**common, **(row[5] if len(row) > 5 else {})}
        base = dict(
            bookmaker=bookmaker, sport="football", competition="Ligue", match_id="m1", home_team="Ghana", away_team="Colombie",
            start_time=START, market_type=market, n_outcomes=3 if market.startswith("1x2") else 2, selection=selection, line=line,
            team_scope=None, odds=odds, url=f"https://{bookmaker}.test/e", scraped_at=AS_OF, ingest_seq=i)
        base.update(extra)
        out.append(tuple(base[f.name] for f in QUOTE_SCHEMA.fields))
    return out


def quotes(spark, rows, **common):
    return spark.createDataFrame(quote_rows(rows, **common), QUOTE_SCHEMA)
