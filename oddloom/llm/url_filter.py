"""URL filter: rules first, and a logistic regression on hashed character n-grams where none fits.

The regression sees the host and the path of a URL, each with its ends marked, as the set of their character n-grams,
hashed to a fixed number of weights and scaled to unit length. It is fitted by Newton's steps in the space of the
labelled URLs (``FIT_ROWS`` rows at most, lowest hash first), which stays small whatever the number of weights.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and scores as a URL without n-grams;
letters other than A-Z keep their case; repeated rows and null ids are judged like any other row; all other columns are
left out or kept (``keep``), those named like a result give way to it; without labels of both classes every URL is
allowed unless a rule blocks it; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrow import fresh

FIT_ROWS, BUCKETS, LENGTHS, RIDGE = 5000, 1 << 17, (3, 4, 5), 0.05
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALLOW, BLOCK = "allow", "block"

# The rules of the given filter, (verdict, host and path).
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]

#: Words of hosts and paths that a filter of training text wants out, and those of ordinary sites, to label a small table by.
UNWANTED = ("casino poker bets betting gambling jackpot slots lottery adult porn xxx sex escort webcam nude dating pills viagra "
            "pharma cialis steroids spam farm clickbait malware warez crack keygen torrent phishing ads adserver track tracker "
            "banner popup affiliate cheap replica payday loans free win bonus").split()
ORDINARY = ("news wiki docs school university library museum weather recipes garden travel history science journal city "
            "council health sports music books maps forum support help about shop studio press archive research hospital "
            "family church theatre market kitchen school village river mountain hotel radio community project labs").split()
#: Beginnings and ends of invented names, which stand for the many hosts whose words say nothing.
BEGINS, ENDS = "ba cor del fen gri hal jo kel lun mar nor osk pel qui ros sil ther urb ven wil yar zan".split(), "ton ler ia sen via do".split()
TOPS = ("com", "org", "net", "info", "co.uk", "de", "fr")
PATHS = ("/", "/en/index.html", "/de/2041", "/fr/article/77?page=2", "/es/12/", "")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, blocked: the small labelled table; hosts of one or two words from one list under several tops and paths."""
    rows, names = [], [b + e for b in BEGINS for e in ENDS]
    for words, blocked in ((UNWANTED, 1), (ORDINARY, 0), (names, 0)):
        for i, word in enumerate(words):
            mate = words[(7 * i + 3) % len(words)]
            for k, host in enumerate((word, f"{word}-{mate}", f"{mate}{word}", f"www.{word}-{mate[:1]}.site", f"m.my{word}", f"blog.{word}.pages")):
                rows.append((f"https://{host}.{TOPS[(i + k) % len(TOPS)]}{PATHS[(i + 2 * k) % len(PATHS)]}", blocked))
    return spark.createDataFrame(rows, "url string, blocked int")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, empty where there is none."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a URL, and its verdict; null where none fits. Made for a short list of rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        own, begin = text[:text.index("/")], text[text.index("/"):]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(begin)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> list[int]:
    """Buckets of the distinct n-grams of host and path."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) > 2:
            for n in LENGTHS:
                found.update(mark + text[i:i + n] for i in range(len(text) - n + 1))
    return sorted({zlib.crc32(g.encode()) % BUCKETS for g in found})


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """Probability that a URL is to be blocked."""
        at = grams(host, path)
        z = self.bias + (float(self.weights[at].sum()) / len(at) ** 0.5 if at else 0.0)
        return float(1 / (1 + np.exp(-z)))


def fit(urls: list[tuple[str, str]], labels: list[int], ridge: float = RIDGE, rounds: int = 30) -> Model:
    """Ridge-penalised maximum likelihood; Newton's steps on one unknown a labelled row."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), -5.0)
    rows = [grams(h, p) for h, p in urls]
    used, at = np.unique(np.concatenate([np.array(r, np.int64) for r in rows]), return_inverse=True)
    x, begin = np.zeros((len(rows), len(used) + 1)), 0
    for i, r in enumerate(rows):
        x[i, at[begin:begin + len(r)]] = 1 / max(len(r), 1) ** 0.5
        begin += len(r)
    x[:, -1] = 1  # the bias
    kernel = x @ x.T
    dual = np.zeros(len(rows))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-kernel @ dual))
        bend = np.maximum(p * (1 - p), 1e-9)
        goal = kernel @ dual + (y - p) / bend
        step = np.linalg.solve(kernel + ridge * np.diag(1 / bend), goal)
        if np.abs(step - dual).max() < 1e-9:
            break
        dual = step
    theta = x.T @ dual
    weights = np.zeros(BUCKETS)
    weights[used] = theta[:-1]
    return Model(weights, float(theta[-1]))


def train(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on ``labelled`` (url, blocked): up to ``rows`` distinct URLs, lowest hash first; one blocked anywhere counts so."""
    host, path = parts(F.col("url"))
    given = labelled.filter("url IS NOT NULL AND blocked IS NOT NULL").groupBy("url").agg(F.max(F.col("blocked").cast("int")).alias("y"))
    sample = given.orderBy(F.xxhash64("url"), "url").limit(rows).select(host.alias("host"), path.alias("path"), "y").collect()
    return fit([(r["host"], r["path"]) for r in sample], [int(r["y"] > 0) for r in sample])


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]] = RULES, keep: tuple[str, ...] = ("page_id",),
          threshold: float = 0.5) -> DataFrame:
    """``keep`` columns, host, path, rule, score (chance that the model gives for blocking) and verdict of every URL."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = shared.value.score
        for hosts, paths in batches:
            yield pd.Series([of(h, p) for h, p in zip(hosts, paths)], dtype="float64")

    made = ("host", "path", "rule", "score", "verdict")
    host, path = parts(F.col("url"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    kept = [c for c in keep if c not in made]
    cut = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    said = fresh(kept, "__says")
    judged = cut.select("*", rule.alias("rule"), says.alias(said), score("host", "path").alias("score"))
    own = F.when(F.col("score") >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", "score", F.coalesce(said, own).alias("verdict"))
