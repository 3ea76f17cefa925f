"""Markets, kick-off, teams, links and boosts out of saved pages.

Pages are text columns; a page is cut at its block markers with regular
expressions, whole pages at a time and row by row, so the work follows the
page table. Pages without the markers give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let, once, strip_tags
from .feeds import split_pair


def _open(tag: str, name: str) -> str:
    """Opening tag that carries class ``name``."""
    return rf'<{tag}\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>'


def _inner(col: Column, name: str) -> Column:
    """Text of the first element of a class, NULL when absent."""
    pattern = rf'(?s)<([a-z][a-z0-9-]*)\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</\1>'
    # an empty text needs a second look: the element may be absent
    return let(
        F.regexp_extract(col, pattern, 2),
        lambda t: F.when(t != "", strip_tags(t)).when(F.regexp_extract(col, pattern, 0) != "", F.lit("")))


def _blocks(col: Column, opening: str) -> Column:
    """Pieces of ``col`` that start at each ``opening``."""
    return let(F.split(col, opening), lambda parts: F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))


def _cut(rows: DataFrame, keep: list[str], name: str, opening: str, position: str, piece: str) -> DataFrame:
    """A row per piece of a column that starts at ``opening``; what comes before the first one is dropped as a row."""
    pieces = rows.select(*keep, F.posexplode(F.split(F.col(name), opening)).alias(position, piece)).filter(F.col(position) > 0)
    return pieces.withColumn(position, F.col(position) - 1)


def html_market_extract(pages: DataFrame) -> DataFrame:
    """(page_id, position, title, selection label, odds text) of event pages."""
    markets = _cut(pages, ["page_id"], "html", _open("div", "bet-type"), "m", "block")
    items = once(markets, "title", _inner(F.col("block"), "bet-type-infos")).filter(F.col("title").isNotNull())
    cells = _cut(items, ["page_id", "m", "title"], "block", r"<hg-event-bet-type-item\b[^>]*>", "i", "item")
    both = F.struct(_inner(F.col("item"), "name").alias("selection_label"), _inner(F.col("item"), "odds").alias("odds_text"))
    return once(cells, "cell", both).select("page_id", "m", "i", "title", "cell.selection_label", "cell.odds_text").filter(
        F.col("selection_label").isNotNull() & F.col("odds_text").isNotNull())


def page_start_time(text: Column, as_of: Column) -> Column:
    """Kick-off from a page's text.

    An explicit day wins when it is a real date; otherwise today, or tomorrow
    when the text says so.
    """
    clock = r"(?=\d)\b([01]?\d|2[0-3])[:h]([0-5]\d)\b"
    date = r"(?=\d)\b(\d{1,2})[/.](\d{1,2})(?:[/.](\d{2,4}))?\b"

    now = as_of.cast("timestamp")
    base = F.date_trunc("day", now)
    base = F.when(text.rlike(r"(?i)\bdemain\b|\btomorrow\b|\bdemen\b"), base + F.expr("INTERVAL 1 DAY")).otherwise(base)

    def part(found: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(found, pattern, i).try_cast("int")

    def day(found: Column) -> Column:
        year = let(F.coalesce(part(found, date, 3), F.year(now)), lambda y: F.when(y < 100, y + 2000).otherwise(y))
        zero = F.lit(0)
        return F.try_make_timestamp(year, part(found, date, 2), part(found, date, 1), zero, zero, zero)

    def time(found: Column) -> Column:
        return F.make_dt_interval(
            hours=F.coalesce(part(found, clock, 1), F.lit(0)), mins=F.coalesce(part(found, clock, 2), F.lit(0)))

    # The text is searched once a pattern; the parts are read off what was found.
    return F.coalesce(let(F.regexp_extract(text, date, 0), day), base) + let(F.regexp_extract(text, clock, 0), time)


EVENT_LINK = r"(?i)(/sports/event/[a-z0-9\-]+m\d+)"


def event_links(pages: DataFrame, base_url: str) -> DataFrame:
    """Distinct absolute event addresses of all pages."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(EVENT_LINK), F.lit(1))).alias("path"))
    return found.select(F.concat(F.lit(base_url), F.col("path")).alias("url")).distinct()


def event_link_harvest(pages: DataFrame, base_url: str, limit: int | None = None) -> DataFrame:
    """All event addresses, or the first ``limit`` in order for a bounded crawl."""
    links = event_links(pages, base_url)
    return links if limit is None else links.orderBy("url").limit(limit)


def boost_html_extract(pages: DataFrame) -> DataFrame:
    """Boosted offers: match title, link, description and first valid price."""
    groups = pages.select(
        "page_id", F.posexplode(_blocks(F.col("html"), _open("[a-z0-9-]+", "manual-odds-boost"))).alias("g", "grp")
    )
    link = r"(?s)<a\b[^>]*\bhref=[\"']([^\"']*/sports/event/[^\"']*)[\"'][^>]*>(.*?)</a>"
    title = strip_tags(F.regexp_extract("grp", link, 2))
    fallback = F.trim(F.regexp_extract(strip_tags(F.col("grp")), r"(?U)([\w .'&/-]+ - [\w .'&/-]+)", 1))
    groups = groups.withColumn("href", F.nullif(F.regexp_extract("grp", link, 1), F.lit(""))).withColumn(
        "match", F.when(title.contains(" - "), title).otherwise(fallback))
    items = _blocks(F.col("grp"), _open("[a-z0-9-]+", "manual-odds-with-event-item"))
    items = F.when(F.size(items) > 0, items).otherwise(F.array("grp"))
    rows = groups.select("page_id", "g", "match", "href", F.posexplode(items).alias("i", "item"))
    cells = F.regexp_extract_all(
        "item", F.lit(rf'(?s){_open("[a-z0-9-]+", "(?:value|odds)")}(.*?)</(?:span|div|a|p)>'), F.lit(1))
    prices = F.filter(
        F.transform(cells, lambda c: F.replace(strip_tags(c), F.lit(","), F.lit("."))),
        lambda t: t.rlike(r"^\s*\d+(?:\.\d+)?\s*$"))
    return rows.select(
        "page_id", "g", "i", "match", F.col("href").alias("event_url"), _inner(F.col("item"), "odds-name").alias("description"),
        F.get(prices, F.lit(0)).try_cast("double").alias("boosted_odds"),
    ).filter((F.coalesce("description", F.lit("")) != "") & F.col("boosted_odds").isNotNull())


def page_meta(pages: DataFrame, as_of: Column) -> DataFrame:
    """Teams, competition and kick-off of event pages; unresolved pages are dropped."""
    title = rf'(?s)(?:{_open("[a-z0-9-]+", "informations")}|<hg-event\b[^>]*>).*?{_open("[a-z0-9-]+", "name")}(.*?)</(?:span|div|a|p)>'
    rival = r"(?s)(?:<hg-event-categories\b[^>]*>|" + _open("[a-z0-9-]+", "categories") + r")(.*?)</(?:hg-event-categories|span|div|p)>"
    # Each text is made once: the filter on the teams would else carry its own copies of the page down to the scan.
    named = once(pages.select("page_id", "url", "html"), "name", strip_tags(F.regexp_extract("html", title, 1)))
    home, away = split_pair(F.col("name"))
    teams = once(named, "teams", F.struct(home.alias("home_team"), away.alias("away_team"))).filter(
        F.col("teams.home_team").isNotNull() & F.col("teams.away_team").isNotNull())
    texts = F.struct(strip_tags(F.regexp_extract("html", rival, 1)).alias("competition"), strip_tags(F.col("html")).alias("head"))
    return once(teams, "texts", texts).select(
        "page_id", "url", "teams.home_team", "teams.away_team", "texts.competition",
        page_start_time(F.col("texts.head"), as_of).alias("start_time"))
