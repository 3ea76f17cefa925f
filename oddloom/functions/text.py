"""Column expressions over names, labels and addresses."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from .. import constants as C


@lru_cache(1)
def _accent_rule() -> tuple[str, str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks, derived from all of Unicode.

    Only characters that turn into ASCII letters, digits or blanks matter to the rules on names and labels.
    """
    source, target, marks, expanded = [], [], [], {}
    for code in range(0xA0, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        if not unicodedata.decomposition(char):
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == char or not any(c.isascii() for c in plain):
            if not plain:
                marks.append(char)
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            expanded[char] = plain
    return "".join(source), "".join(target), "".join(marks), expanded


def strip_accents(col: Column) -> Column:
    """Fold accented letters; characters that expand are only looked up when present."""
    source, target, marks, expanded = _accent_rule()
    table = F.create_map(*[F.lit(x) for pair in expanded.items() for x in pair])
    spread = F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    ranges = "".join(f"\\x{{{ord(c):X}}}" for c in expanded)
    # translate drops the source characters that have no counterpart
    folded = F.translate(F.when(col.rlike(f"[{ranges}]"), spread).otherwise(col), source + marks, target)
    # plain ASCII, by far the most frequent case, is left as it is
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(folded)


def normalize_team_name(col: Column) -> Column:
    """Accent-free lower-case name, runs of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(col)), "[^a-z0-9]+", " "))


def make_match_id(home: Column, away: Column, start: Column) -> Column:
    """Stable id of a match from both names and its UTC day."""
    key = F.concat_ws(
        "|", normalize_team_name(home), normalize_team_name(away), F.date_format(start, "yyyy-MM-dd")
    )
    return F.substring(F.sha1(key), 1, 16)


def parse_odds_value(col: Column) -> Column:
    """Decimal price from text with a comma or dot; NULL unless above 1."""
    value = F.translate(F.regexp_replace(col, r"^\s+|\s+$| ", ""), ",", ".")
    number = value.try_cast("double")
    return F.when(number > 1.0, number)


def plain_number(col: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Constant map lookup, NULL when the key is absent."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def outcome_label(selection: Column, line: Column, scope: Column) -> Column:
    """Display label of one outcome."""
    name = F.coalesce(lookup({k: v[0] for k, v in C.OUTCOME_LABELS.items()}, selection), selection)
    symbol = F.coalesce(lookup({k: v[1] for k, v in C.OUTCOME_LABELS.items()}, selection), selection)
    suffix = F.coalesce(lookup(C.SCOPE_SUFFIXES, scope), F.lit(""))
    return F.when(
        selection.isin("over", "under") & line.isNotNull(),
        F.concat(name, F.lit(" "), plain_number(line), suffix),
    ).otherwise(F.concat(name, F.lit(" ("), symbol, F.lit(")")))


def market_label(market_type: Column, line: Column) -> Column:
    """Display label of a market, with the line on totals."""
    base = F.coalesce(lookup(C.MARKET_LABELS, market_type), market_type)
    return F.when(
        line.isNotNull() & base.contains("Total"), F.concat(base, F.lit(" "), plain_number(line))
    ).otherwise(base)


def canonical_name(col: Column) -> Column:
    """Lower-case name with single spaces."""
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def resolve_alias(col: Column) -> Column:
    """Known short name -> canonical name, otherwise unchanged."""
    return F.coalesce(lookup(C.TEAM_ALIASES, canonical_name(col)), col)


def squad_marker(col: Column) -> Column:
    """Youth, reserve or women; NULL for a first team."""
    expr = F.lit(None).cast("string")
    for marker, pattern in reversed(C.SQUAD_PATTERNS):
        expr = F.when(col.rlike("(?iuU)" + pattern), F.lit(marker)).otherwise(expr)
    return expr


def same_squad_level(a: Column, b: Column) -> Column:
    """Both names carry the same marker, or none."""
    return squad_marker(a).eqNullSafe(squad_marker(b))


def operator_of(bookmaker: Column, groups: dict[str, str] | None = None) -> Column:
    """Owner group of a brand; an unknown brand owns itself."""
    key = F.replace(F.lower(F.trim(F.coalesce(bookmaker, F.lit("")))), F.lit(" "), F.lit(""))
    return F.coalesce(lookup(groups or C.OWNER_GROUPS, key), key)


def cache_key(sport: Column, market: Column, selection: Column, home: Column, away: Column) -> Column:
    """Key of a label in the normalisation cache."""
    return F.concat_ws("|", *[F.lower(F.trim(c)) for c in (sport, market, selection, home, away)])


def canonical_email(col: Column) -> Column:
    """One address per mailbox of the two equivalent mail domains."""
    low = F.lower(col)
    local = F.split_part(low, F.lit("@"), F.lit(1))
    domain = F.split_part(low, F.lit("@"), F.lit(2))
    base = F.replace(F.split_part(local, F.lit("+"), F.lit(1)), F.lit("."), F.lit(""))
    return F.when(
        domain.isin("gmail.com", "googlemail.com"), F.concat(base, F.lit("@gmail.com"))
    ).otherwise(low)


def escape_markup(col: Column) -> Column:
    """The three characters a markup message must escape."""
    text = col.cast("string")
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape_markup(col: Column) -> Column:
    """Entities that occur in scraped text, back to characters."""
    text = col
    for safe, raw in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
                      ("&amp;", "&")]:
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_tags(col: Column) -> Column:
    """Visible text of a markup fragment, whitespace collapsed."""
    def bare(c: Column) -> Column:
        # most fragments have nothing of the kind, which a search for plain text tells much sooner
        unseen = c.contains("<script") | c.contains("<style") | c.contains("<!--")
        text = F.when(unseen, F.regexp_replace(c, r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")).otherwise(c)
        # neighbouring tags leave at once, in runs short enough for the matcher's stack
        return F.when(c.contains("<"), F.regexp_replace(text, r"(?:</?[a-zA-Z!][^>]*+>\s*+){1,40}", " ")).otherwise(c)

    def plain(c: Column) -> Column:
        coded = F.when(c.rlike("&(?:lt|gt|quot|#39|nbsp);"), unescape_markup(c)).otherwise(F.replace(c, F.lit("&amp;"), F.lit("&")))
        text = F.when(c.contains("&"), coded).otherwise(c)
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    marked = r"[<&\t-\r]|  |^ | $"
    return let(col, lambda c: F.when(c.rlike(marked), let(bare(c), plain)).otherwise(c))


def once(df, name: str, value: Column):
    """Add a column that is computed once per row wherever it is used later.

    Filters and projections above are not rewritten into copies of the
    expression, because a generated column is opaque to them.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
