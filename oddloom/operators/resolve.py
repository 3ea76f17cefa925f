"""Teams and matches across bookmakers by fuzzy names.

Names are scored, never rows: a similarity join over the distinct names of
one squad level (and day of a sport), with candidate keys that provably miss no pair
over the threshold, and no cap on partners. Before any text is compared, the
letters that two names share must be enough, counted by class of letter.
Matches are then compared only through the name pairs found: those of both
sides bring them together within their sport and day.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import MATCH_THRESHOLD
from ..functions.similarity import similar_ratio, token_sort_ratio
from ..functions.text import canonical_name, resolve_alias, same_squad_level, squad_marker
from ..session import cut_lineage


def canonical_key(col: Column) -> Column:
    return canonical_name(resolve_alias(col))


def teams_match(pairs: DataFrame, a: str = "name_a", b: str = "name_b", threshold: int = MATCH_THRESHOLD) -> DataFrame:
    """Same squad level and sorted-word score at the threshold."""
    score = token_sort_ratio(canonical_key(F.col(a)), canonical_key(F.col(b)))
    return pairs.withColumn("score", score).withColumn(
        "matched", same_squad_level(F.col(a), F.col(b)) & (F.col("score") >= threshold))


def teams_similar(pairs: DataFrame, a: str = "name_a", b: str = "name_b", threshold: int = MATCH_THRESHOLD) -> DataFrame:
    """As R03 with the better of the word-set and sorted-word scores."""
    score = similar_ratio(canonical_key(F.col(a)), canonical_key(F.col(b)))
    return pairs.withColumn("score", score).withColumn(
        "similar", same_squad_level(F.col(a), F.col(b)) & (F.col("score") >= threshold))


# --- similarity join over names -------------------------------------------------------

def _words(col: Column) -> Column:
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def _forms(names: DataFrame, word_sets: bool) -> DataFrame:
    """Each name's words as scored: with repeats for the sorted score, once for the set score."""
    words = _words(F.col("name"))
    forms = F.array_distinct(F.array(words, F.array_distinct(words))) if word_sets else F.array(words)
    formed = names.select(*_NAME, F.explode(forms).alias("words")).withColumn("text", F.array_join("words", " "))
    return formed.withColumn("size", F.length("text")).withColumn("bag", _bag(F.col("text"))).drop("text")


#: A name as compared: on which side, in which block, and whether it asks for partners or only answers.
_NAME = ["side", "level", "name", "asks"]
_CLASSES = 32


def _bag(text: Column) -> Column:
    """How many letters of each class a text holds."""
    classes = F.transform(F.split(text, ""), lambda c: F.ascii(c) % _CLASSES)
    return F.transform(F.sequence(F.lit(0), F.lit(_CLASSES - 1)), lambda k: F.size(F.filter(classes, lambda c: c == k)))


def _shared(a: str, b: str) -> Column:
    """At least as many letters as two texts can have in common, in any order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)


def _grams(words: Column, g: Column) -> Column:
    """All substrings of length ``g`` inside single words."""
    def of_word(w: Column) -> Column:
        starts = F.when(F.length(w) >= g, F.sequence(F.lit(1), F.length(w) - g + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(w, i, g))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def _pieces(words: Column, g: Column) -> Column:
    """Words cut into consecutive pieces of length ``g``, remainders left out."""
    def of_word(w: Column) -> Column:
        count = F.floor(F.length(w) / g).cast("int")
        starts = F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(w, i * g + 1, g))

    return F.flatten(F.transform(words, of_word))


def _met(x: DataFrame, y: DataFrame, keys: list[str], more: Column) -> DataFrame:
    """Pairs of different sides with equal ``keys``, of which one asks, the left side first."""
    x, y = x.alias("x"), y.alias("y")
    on = (F.col("x.side") != F.col("y.side")) & (F.col("x.asks") | F.col("y.asks"))
    for k in ["level", *keys]:
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    swap = F.col("x.side") > F.col("y.side")
    return x.join(y, on & more).select(
        F.col("x.level").alias("level"), F.when(swap, F.col("y.name")).otherwise(F.col("x.name")).alias("a"),
        F.when(swap, F.col("x.name")).otherwise(F.col("y.name")).alias("b"))


def _piece_candidates(forms: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose texts may be within the edit budget.

    A score of t needs at most (1-t)(|x|+|y|) <= 2(1-t)|x| inserted or deleted
    letters for the longer text x. Each spoils one piece, so of any more pieces
    than that, one is found whole inside a word of y. The rarest are used.
    """
    slack = 1 - threshold / 100
    budget = F.floor(2 * slack * F.col("size") + 1e-9).cast("int")
    widest = max(1, ceil(1 / (2 * slack)))
    lengths = F.sequence(F.lit(1), F.lit(widest))
    ample = F.filter(lengths, lambda g: F.size(_pieces(F.col("words"), g)) > F.col("budget"))
    long_side = (
        forms.withColumn("budget", budget)
        .withColumn("g", F.array_max(ample)).filter(F.col("g").isNotNull())
        .select(*_NAME, "words", "size", "bag", "budget", "g", F.posexplode(_pieces(F.col("words"), F.col("g"))).alias("p", "gram"))
    )
    short_side = forms.select(*_NAME, "size", "bag", F.explode(lengths).alias("g"), "words").select(
        *_NAME, "size", "bag", "g", F.explode(_grams(F.col("words"), F.col("g"))).alias("gram"))
    spread = short_side.groupBy("level", "g", "gram").agg(F.count("*").alias("freq"))
    rare = Window.partitionBy("side", "level", "name", "words").orderBy(F.coalesce("freq", F.lit(0)), "gram", "p")
    keys = (
        long_side.join(spread, ["level", "g", "gram"], "left")
        .withColumn("rank", F.row_number().over(rare)).filter(F.col("rank") <= F.col("budget") + 1)
        .select(*_NAME, "g", "gram", "size", "bag").distinct()
    )
    ratio = threshold / (200 - threshold)
    near = (F.col("y.size") <= F.col("x.size")) & (F.col("y.size") >= F.col("x.size") * ratio - 1e-9)
    enough = _shared("x.bag", "y.bag") >= (F.col("x.size") + F.col("y.size")) * (threshold / 200) - 1e-9
    return _met(keys, short_side, ["g", "gram"], near & enough)


def _word_candidates(forms: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may share enough whole words: all of one side's, or most of its letters.

    The words a side may leave unshared hold a bounded share of its letters;
    its rarest words beyond that share therefore include a shared one.
    """
    loose = 1 - threshold / (200 - threshold)
    words = forms.select(*_NAME, F.explode(F.array_distinct("words")).alias("word")).distinct()
    freq = words.groupBy("level", "word").agg(F.count("*").alias("freq"))
    order = Window.partitionBy("side", "level", "name").orderBy("freq", "word")
    before = F.coalesce(F.sum(F.length("word")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    letters = F.length(F.array_join(F.array_distinct(_words(F.col("name"))), " "))
    prefix = words.join(freq, ["level", "word"]).withColumn("before", before).filter(F.col("before") <= letters * loose + 1e-9)
    return _met(prefix, words, ["word"], F.lit(True))


def similar_names(
    left: DataFrame, right: DataFrame, threshold: float = MATCH_THRESHOLD, word_sets: bool = True
) -> DataFrame:
    """All pairs (level, left_name, right_name, score) at or over the threshold.

    Inputs hold ``level`` (squad level or a finer block, never NULL), ``name`` and, if only some names look for partners,
    ``asks``; of two names that both do not ask nothing is said. With ``word_sets=False`` only the sorted-word score counts.
    """
    sides = [d if "asks" in d.columns else d.withColumn("asks", F.lit(True)) for d in (left, right)]
    named = [d.distinct().withColumn("side", F.lit(s)).select(*_NAME) for d, s in zip(sides, "lr")]
    forms = cut_lineage(_forms(named[0].unionByName(named[1]), word_sets), "forms")
    found = _piece_candidates(forms, threshold)
    if word_sets:
        found = found.unionByName(_word_candidates(forms, threshold))
    found = found.distinct()
    close = scored_pairs(found, threshold, similar_ratio if word_sets else token_sort_ratio)
    return found.join(close, ["a", "b"]).select("level", F.col("a").alias("left_name"), F.col("b").alias("right_name"), "score")


def scored_pairs(pairs: DataFrame, threshold: float, score=similar_ratio) -> DataFrame:
    """a, b, score of the distinct pairs of names at or over the threshold, wherever they occur."""
    return pairs.select("a", "b").distinct().withColumn("score", score(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)


def _level(col: Column) -> Column:
    return F.coalesce(squad_marker(col), F.lit("first"))


def best_team_match(names: DataFrame, registry: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Best registry entry of the same squad level; the earliest wins ties.

    ``names``: ``name``; ``registry``: ``candidate`` and ``pos``. Letters keep
    their case, as published: only the looked-up name passes the alias table.
    """
    asked = names.select("name").distinct().select(
        "name", _level(F.col("name")).alias("level"), resolve_alias(F.col("name")).alias("text"))
    known = registry.select("candidate", "pos", _level(F.col("candidate")).alias("level"))
    pairs = similar_names(
        asked.select("level", F.col("text").alias("name")), known.select("level", F.col("candidate").alias("name")),
        threshold, word_sets=False,
    )
    hits = asked.join(pairs, (asked["level"] == pairs["level"]) & (asked["text"] == pairs["left_name"])).select(
        "name", F.col("right_name").alias("candidate"), "score")
    first = known.groupBy("candidate").agg(F.min("pos").alias("pos"))
    best = hits.join(first, "candidate").groupBy("name").agg(
        F.max_by(F.struct("candidate", "score"), F.struct("score", -F.col("pos"))).alias("m"))
    return names.join(best, "name", "left").select(*names.columns, "m.candidate", "m.score")


# --- matches --------------------------------------------------------------------------

SIDE = ["home_level", "home_key", "away_level", "away_key"]


def with_side_keys(df: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """What similarity sees of a match: squad level and canonical name of both sides."""
    return (
        df.withColumn("home_level", _level(F.col(home))).withColumn("home_key", canonical_key(F.col(home)))
        .withColumn("away_level", _level(F.col(away))).withColumn("away_key", canonical_key(F.col(away)))
    )


_REGULAR = 8


def _home_names(left: DataFrame, right: DataFrame, on: list[str], side: str = "home") -> list[DataFrame]:
    """The home (or away) names of both sides, in the blocks in which they are to be compared.

    A regular (on at least ``_REGULAR`` values of the ``on`` columns) is compared with the other regulars once; any other
    name with all that share its few blocks. A pair of names in one block is thus always compared, and neither the blocks
    of a name nor the names in all blow up.
    """
    block, whole, key = F.to_json(F.struct(*on, "home_level", "away_level")), F.col(f"{side}_level"), F.col(f"{side}_key")
    if not on:
        return [d.select(whole.alias("level"), key.alias("name")) for d in (left, right)]
    seen = [d.select(block.alias("block"), whole.alias("whole"), key.alias("name")).distinct() for d in (left, right)]
    often = seen[0].union(seen[1]).groupBy("whole", "name").agg((F.count_distinct("block") >= _REGULAR).alias("regular"))
    known = [d.join(often, ["whole", "name"]) for d in seen]
    asked = known[0].union(known[1]).filter("NOT regular").select("block").distinct()
    out = []
    for d in known:
        once = d.filter("regular").select(F.col("whole").alias("level"), "name", F.lit(True).alias("asks")).distinct()
        daily = d.join(asked, "block", "left_semi").select(F.col("block").alias("level"), "name", (~F.col("regular")).alias("asks"))
        out.append(once.unionByName(daily))
    return out


def _alike(left: DataFrame, right: DataFrame, on: list[str], side: str, threshold: float) -> DataFrame:
    """name, like: every pair of similar home (or away) names of the two sides."""
    found = similar_names(*_home_names(left, right, on, side), threshold).select(F.col("left_name").alias("name"), F.col("right_name").alias("like"))
    if side == "away":  # two blank away names are alike, and have no letters to be found by
        found = found.union(left.sparkSession.sql("SELECT '' AS name, '' AS like"))
    return cut_lineage(found.distinct(), "names")


def similar_matches(left: DataFrame, right: DataFrame, on: list[str], threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Pairs (left id, right id) with both sides similar and equal ``on`` columns.

    Left rows are rewritten to the similar home and away names and meet right rows by equality of those, of the ``on``
    columns and of both squad levels: only similar matches ever come together, however many a team plays.
    """
    reach = left
    for side in ("home", "away"):
        pairs = _alike(left, right, on, side, threshold).select(F.col("name").alias("__own"), F.col("like").alias("__to"))
        key = f"{side}_key"
        reach = reach.join(pairs, F.col(key) == F.col("__own")).withColumn(key, F.col("__to")).drop("__own", "__to")
    l, r = reach.alias("l"), right.alias("r")
    cond = F.lit(True)
    for k in [*on, *SIDE]:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, cond).select(F.struct("l.*").alias("l"), F.struct("r.*").alias("r"))


def _leaders(edges: DataFrame, group: list[str]) -> DataFrame:
    """node, leader: the nodes that follow an earlier leader, the earliest that they are similar to; all others lead.

    ``edges``: node and earlier similar node, each with its place ``seq`` or ``earlier_seq`` (equal places go by name).
    Edges stay within a ``group`` (a day of a sport, by squad levels), whose nodes stream through in feed order; what is
    kept is who follows. One pass, however long the chains are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, follows, node, settled = None, set(), None, False
        for batch in batches:
            nodes, leaders = [], []
            for key, at, earlier in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != current:
                    current, follows, node = key, set(), None
                if at != node:
                    node, settled = at, False
                if not settled and earlier not in follows:
                    settled = True
                    follows.add(at)
                    nodes.append(at)
                    leaders.append(earlier)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(leaders, pa.string())], names=["node", "leader"])

    laid = edges.select(F.to_json(F.struct(*group)).alias("key"), "node", "earlier", "seq", "earlier_seq").repartition("key")
    ordered = laid.sortWithinPartitions("key", "seq", "node", "earlier_seq", "earlier")
    return ordered.select("key", "node", "earlier").mapInArrow(run, "node string, leader string")


def _first_leaders(nodes: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """node, leader: what ``_leaders`` says of the pairs that ``similar_matches`` lists, and no pair of matches is ever a row.

    ``nodes``: node, its place ``seq``, the ``on`` columns and both sides, which differ. A block (``on`` columns and squad
    levels) streams through one task: first its names with those they are similar to, then its matches in feed order, each
    looked up among the leaders before it. What is kept is the names and the leaders of one block.
    """
    placed = nodes.na.drop(subset=[*on, *SIDE]).select(
        F.to_json(F.struct(*on, "home_level", "away_level")).alias("block"), "seq", "node", "home_key", "away_key")
    rows = placed.select("block", F.lit(2).alias("kind"), "seq", F.col("node").alias("name"), "home_key", "away_key", F.lit(None).cast("array<string>").alias("like"))
    for kind, side in enumerate(("home", "away")):
        lists = _alike(nodes, nodes, on, side, threshold).groupBy("name").agg(F.collect_list("like").alias("like"))
        names = placed.select("block", F.col(f"{side}_key").alias("name")).distinct().join(lists, "name").withColumn("kind", F.lit(kind))
        rows = rows.unionByName(names, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, alike, leaders, place = None, {}, ({}, {}), {}, 0
        for batch in batches:
            nodes, found = [], []
            for block, kind, name, home, away, like in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if block != current:
                    current, known, alike, leaders = block, {}, ({}, {}), {}
                if kind < 2:
                    alike[kind][name] = {known.setdefault(x, x) for x in like}
                    continue
                aways = alike[1].get(away, frozenset())
                met = [leaders[h] for h in alike[0].get(home, ()) if h in leaders]
                best = min((led[a] for led in met for a in led.keys() & aways), default=None)
                if best is None:
                    place += 1
                    leaders.setdefault(home, {})[away] = (place, name)
                else:
                    nodes.append(name)
                    found.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(found, pa.string())], names=["node", "leader"])

    ordered = rows.repartition("block").sortWithinPartitions("block", "kind", "seq", "name")
    return ordered.select("block", "kind", "name", "home_key", "away_key", "like").mapInArrow(run, "node string, leader string")


def canonical_matches(quotes: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(match_id, canonical_id) for matches that are spellings of an earlier one."""
    first = F.min_by(F.struct("sport", "home_team", "away_team", "start_time"), "ingest_seq")
    reps = quotes.groupBy("match_id").agg(first.alias("r"), F.min("ingest_seq").alias("seq")).select(
        "match_id", "seq", "r.*").withColumn("day", F.to_date("start_time"))
    keyed = cut_lineage(with_side_keys(reps).select("match_id", "seq", "sport", "day", *SIDE), "matches")
    # Equal keys behave alike: the first of them stands for all, however many there are.
    group = ["sport", "day", *SIDE]
    nodes = cut_lineage(keyed.groupBy(*group).agg(F.min(F.struct("seq", "match_id")).alias("first")).select(
        *group, F.col("first.seq").alias("seq"), F.col("first.match_id").alias("node")), "nodes")
    leaders = _first_leaders(nodes, ["sport", "day"], threshold)
    named = nodes.join(leaders, "node", "left").select(*group, F.coalesce("leader", "node").alias("canonical_id"))
    return keyed.join(named, group).filter(F.col("canonical_id") != F.col("match_id")).select("match_id", "canonical_id")


def reconcile_pool(quotes: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Quotes of one real match share one match id.

    Only renamed matches are joined, a side AQE broadcasts while it is small.
    """
    renamed = cut_lineage(canonical_matches(quotes, threshold), "canonical")
    out = quotes.join(renamed, "match_id", "left")
    return out.withColumn("match_id", F.coalesce("canonical_id", "match_id")).select(*quotes.columns)


def reconciliation_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Match ids before and after, merged ids, matches at two or more bookmakers."""
    n_before = before.agg(F.count_distinct("match_id")).scalar()
    per_match = after.select("match_id", "bookmaker").distinct().groupBy("match_id").agg(F.count("*").alias("books"))
    rows = per_match.agg(F.count("*").alias("match_ids_after"), F.count_if(F.col("books") >= 2).alias("cross_book_matches"))
    return rows.select(
        n_before.alias("match_ids_before"), "match_ids_after", "cross_book_matches"
    ).withColumn("merged", F.col("match_ids_before") - F.col("match_ids_after"))


def match_lookup(requests: DataFrame, events: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """First event in feed order with both names similar, per request.

    ``requests``: ``request_id``, ``home_team``, ``away_team``; ``events``:
    ``event_id``, ``pos``, both teams, ``start_time``, ``competition``.
    """
    asked = with_side_keys(requests).select("request_id", *SIDE)
    # Events with equal keys are alike to every request: the first one answers.
    known = with_side_keys(events).groupBy(*SIDE).agg(
        F.min("pos").alias("pos"),
        F.min_by(F.struct("event_id", "start_time", "competition"), "pos").alias("event"))
    wanted = asked.select(*SIDE).distinct()
    hits = similar_matches(
        wanted.withColumn("o_home", F.col("home_key")).withColumn("o_away", F.col("away_key")), known, [], threshold)
    best = hits.groupBy(
        F.col("l.home_level").alias("home_level"), F.col("l.o_home").alias("home_key"),
        F.col("l.away_level").alias("away_level"), F.col("l.o_away").alias("away_key"),
    ).agg(F.min_by(F.col("r.event"), F.col("r.pos")).alias("event"))
    found = asked.join(best, SIDE).select("request_id", "event.*")
    return requests.join(found, "request_id", "left")
