"""Personal data by fixed rules and by bootstrapped contextual extraction.

The rules give seed entities. Every identifier-like word (one with a digit or an at sign) is a mention with the words
around it; patterns are the word before, the two words before, and the words on both sides. Patterns and instances
form a graph that is scored in turns: a pattern's confidence in a kind is the mean score of its distinct instances,
an instance's score is what its confident patterns together leave no doubt of (noisy-or), and seeds score 1. A pattern
needs ``SUPPORT`` instances of a high score, whether rules or other patterns found them, so what one turn finds can make
a pattern of the next. Mentions in a pattern of high confidence that no rule covers are the unseen identifiers.

Only DataFrame functions are used. The texts are read once; positions come from the lengths of what lies between and
in the matches, summed in blocks. The rules are written with possessive repeats and guarded starts, which match the
same spans in time linear in the text and without deep recursion.

Cases: a null or empty text has no spans; repeated rows and null ids are scanned like any other row; other columns are
left out; without seeds no patterns arise; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# The rules' spans, as possessive patterns.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPACE = r"[\x20\x09-\x0D]"
MENTION = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
EDGE = r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]+$"
TURNS, CONFIDENT, SUPPORT, BLOCK = 3, 0.8, 3, 256


def placed(text: Column, pattern: str) -> Column:
    """The matches of ``pattern`` as (start, end, word), and under ``before`` and ``after`` what lies around them.

    Lengths are summed within blocks of matches and over blocks, so the work stays near linear in the matches.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"))
    empty = "array<struct<start:int,end:int,word:string,gap:string>>"

    def cut(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 2) / BLOCK).cast("int")),
                           lambda b: F.slice(z, b * BLOCK + 1, F.least(F.lit(BLOCK), F.size(z) - 1 - b * BLOCK)))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["word"])
        span = F.struct(start.alias("start"), end.alias("end"), x["word"].alias("word"), x["gap"].alias("gap"))
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(span)).alias("done"))

    def block(b: Column, at: Column) -> Column:
        return F.aggregate(b, F.struct(at.alias("at"), F.array().cast(empty).alias("done")), step, lambda s: s["done"])

    def size(b: Column) -> Column:
        return F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["word"]))

    def starts(blocks: Column) -> Column:
        return F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("done")),
            lambda s, b: F.struct((s["at"] + size(b)).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done")),
            lambda s: s["done"])

    def spans(z: Column) -> Column:
        return let(cut(z), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), block)))

    return let(zipped, lambda z: F.when(F.size(z) > 1, spans(z)).otherwise(F.array().cast(empty)))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(word: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(word)), ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda n, d: n + d) % 10 == 0


def _holds(kind: str, word: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return word.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    count = F.length(_digits(word))
    if kind == "card":
        return F.when(count.between(12, 19), _luhn(word)).otherwise(False)
    return count.between(9, 15) if kind == "phone" else F.lit(True)


def rule_spans(text: Column) -> Column:
    """All rule matches as (start, order of the kind, end, kind), sorted."""
    numbered = text.rlike("[0-9]")
    return F.array_sort(F.concat(*[_rule(text, n, kind, numbered) for n, kind in enumerate(KINDS)]))


def _rule(text: Column, n: int, kind: str, numbered: Column) -> Column:
    likely = F.contains(text, F.lit(HINTS[kind])) & (numbered if kind != "email" else F.lit(True))
    good = F.filter(placed(text, RULES[kind]), lambda s: _holds(kind, s["word"]))
    spans = F.transform(good, lambda s: F.struct(
        s["start"].alias("start"), F.lit(n).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(likely, spans).otherwise(F.array().cast("array<struct<start:int,nth:int,end:int,kind:string>>"))


def mentions(text: Column) -> Column:
    """Identifier-like words as (start, end, word) with the words around them: one, two before, and one after."""

    def last(words: Column, n: int) -> Column:
        return F.lower(F.regexp_replace(F.try_element_at(words, F.lit(-n)), EDGE, ""))

    def around(spans: Column, tail: Column, s: Column, i: Column) -> Column:
        # a mention may itself be the word before; a text begins with a mark
        prior = F.when(i == 0, F.lit("^")).otherwise(F.lower(F.regexp_replace(F.get(spans, i - 1)["word"], EDGE, "")))
        after = F.coalesce(F.get(spans, i + 1)["gap"], tail)
        later = F.lower(F.regexp_replace(F.get(spans, i + 1)["word"], EDGE, ""))
        follows = F.lower(F.regexp_replace(F.regexp_extract(after, rf"^{SPACE}*([^\x20\x09-\x0D]+)", 1), EDGE, ""))
        head = F.regexp_extract(s["word"], r"^[^\p{L}\p{N}+@]+", 0)
        bare = F.regexp_replace(s["word"], EDGE, "")
        start = s["start"] + F.when(F.length(bare) > 0, F.length(head)).otherwise(0)
        return let(F.filter(F.split(s["gap"], SPACE + "+"), lambda w: w != ""), lambda words: F.struct(
            start.alias("start"), (start + F.length(bare)).alias("end"), F.lower(bare).alias("word"),
            F.when(F.size(words) > 0, last(words, 1)).otherwise(prior).alias("one"),
            F.when(F.size(words) > 1, last(words, 2)).when(F.size(words) == 1, prior).alias("two"),
            F.when(~after.rlike(r"[^\x20\x09-\x0D]"), F.coalesce(later, F.lit(""))).otherwise(follows).alias("next")))

    def made(spans: Column) -> Column:
        return let(F.element_at(F.split(text, MENTION, -1), -1), lambda tail: F.filter(
            F.transform(spans, lambda s, i: around(spans, tail, s, i)), lambda m: F.length(m["word"]) > 0))

    return F.when(text.rlike("[0-9@]"), let(placed(text, MENTION), made))


def extract(docs: DataFrame, turns: int = TURNS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """doc_id and its spans (start, nth, end, kind), sorted; kind ``context`` marks what patterns found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    held = cut_lineage(read.select("row", "doc_id", rule_spans(F.col("text")).alias("base"), mentions(F.col("text")).alias("mentions")), "pii")
    seen = held.select("row", "base", F.explode("mentions").alias("m")).select("row", "base", "m.*")
    cover = F.filter("base", lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]))
    seen = cut_lineage(seen.withColumn("kind", F.get(cover, F.lit(0))["kind"]).drop("base"), "mentions")
    patterns = F.array(
        F.concat_ws(" ", F.lit("<"), "one"), F.when(F.col("two").isNotNull(), F.concat_ws(" ", F.lit("<<"), "two", "one")),
        F.when(F.col("next") != "", F.concat_ws(" ", F.lit("<>"), "one", F.lit("_"), "next")))
    at = seen.select("row", "start", "end", "word", "kind", F.explode(F.array_compact(patterns)).alias("pattern"))
    # each distinct edge once; a hot pattern or word is folded before the shuffle
    edges = cut_lineage(at.groupBy("pattern", "word").agg(F.max("kind").alias("kind")), "edges")
    # patterns of too few words can never become confident, whatever the turns find
    live = edges.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("pattern")
    edges = cut_lineage(edges.join(live, "pattern", "left_semi"), "live")
    scores = _scores_of_seeds(edges)
    strong = None
    for _ in range(turns):
        strong = cut_lineage(_confident(edges, scores, confident, support), "patterns")
        linked = edges.filter("kind IS NULL").join(strong, "pattern")
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        scores = _scores_of_seeds(edges).unionByName(
            linked.groupBy("word", "about").agg((1 - doubt).alias("score")))
        scores = cut_lineage(scores.groupBy("word", "about").agg(F.max("score").alias("score")), "scores")
    found = at.filter("kind IS NULL").join(strong, "pattern").select("row", "start", "end").distinct()
    more = found.groupBy("row").agg(F.collect_list(F.struct(
        "start", F.lit(len(KINDS)).alias("nth"), "end", F.lit("context").alias("kind"))).alias("more"))
    none = F.array().cast("array<struct<start:int,nth:int,end:int,kind:string>>")
    joined = held.select("row", "doc_id", "base").join(more, "row", "left")
    return joined.select("doc_id", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def _scores_of_seeds(edges: DataFrame) -> DataFrame:
    return edges.filter("kind IS NOT NULL").select("word", F.col("kind").alias("about"), F.lit(1.0).alias("score")).distinct()


def _confident(edges: DataFrame, scores: DataFrame, confident: float, support: int) -> DataFrame:
    """pattern, about, confidence of the patterns whose distinct instances mostly belong to one kind."""
    total = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    sums = edges.join(scores, "word").groupBy("pattern", "about").agg(
        F.sum("score").alias("mass"), F.count_if(F.col("score") >= confident).alias("known"))
    rated = sums.join(total, "pattern").withColumn("confidence", F.col("mass") / F.col("instances"))
    return rated.filter((F.col("known") >= support) & (F.col("confidence") >= confident)).select("pattern", "about", "confidence")
