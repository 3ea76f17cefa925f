"""Substring dedup by seed and extend.

A window is ``window`` consecutive words. Every document is winnowed: of the hashes of ``seed`` consecutive words, the
smallest in each window is its anchor (rightmost among equals), so that equal windows have equal anchors at equal
places. Documents meet on anchors.

Extension. All windows that chose one anchor lie next to each other; the words they cover are the anchor's stretch,
the seed extended both ways as far as its windows reach. Equal stretches repeat as a whole: all their windows are
repeats. Where one anchor has several different stretches, one copy of each is extended window by window, and a window
that occurs in two of them, or in a stretch that occurs twice, is a repeat. Overlapping repeats join to the maximal
repeats, whose words are removed.

Nothing is compared pair by pair: stretches and windows meet as 128-bit hashes in counts that are combined before the
shuffle, and copies of one text are read once. A text of at least ``window`` words that occurs twice is a repeat as a
whole.

Cases: a null or empty text has no words; texts shorter than a window stay whole; repeated rows are repeats of each
other; null and repeated ids are rows of their own; other columns are left out (``mark``) or kept (``dedup``); an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, scratch_path
from .arrow import fresh, slices
from .bitmap import flagged, narrowed

WINDOW, SEED = 35, 12
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KNOWN = 800_000


class _Index(dict):
    """Numbers words as they come and keeps the digests of the new ones."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(xxh3_128_digest(word))
        return at


class WordHashes:
    """Two independent 64-bit hashes per word."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.index, self.hashes, self.filled = _Index(), np.zeros((1 << 16, 2), np.uint64), 0
        self.index.new = []

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > KNOWN:
            self._forget()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = self.index.new
        if new:
            end = self.filled + len(new)
            while end > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[self.filled:end] = np.frombuffer(b"".join(new), "<u8").reshape(-1, 2)
            self.filled = end
            new.clear()
        return self.hashes[at]


class Sums:
    """Hashes of any run of words from running sums: sum of hash(word) * base ** place, moved to place 0."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums, self.back = [], []
        for k in range(len(BASES)):
            power, inverse = _powers(k, n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes[:, k] * power[:n], out=sums[1:])
            self.sums.append(sums)
            self.back.append(inverse)

    def runs(self, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        return _mix((self.sums[k][end] - self.sums[k][start]) * self.back[k][start])


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n + 1`` powers of a base and of its inverse."""
    known = _POWERS.get(k)
    if known is None or len(known[0]) <= n:
        size = max(4096, 1 << int(n + 1).bit_length())
        made = []
        for base in (BASES[k], pow(BASES[k], -1, 1 << 64)):
            power = np.ones(size, np.uint64)
            np.multiply.accumulate(np.full(size - 1, base, np.uint64), out=power[1:])
            made.append(power)
        known = _POWERS[k] = tuple(made)
    return known


def lowest(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest of every ``span`` neighbours, rightmost among equals."""
    place, size = np.arange(len(values)), 1
    while size < span:
        step = min(size, span - size)
        right = values[step:] <= values[:-step]
        place = np.where(right, place[step:], place[:-step])
        values = np.where(right, values[step:], values[:-step])
        size += step
    return place


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the low bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(sums: Sums, n: int, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, its place, and the first and last window start that chose it."""
    seeds = sums.runs(np.arange(n - seed + 1), np.arange(seed, n + 1), 0)
    chosen = lowest(seeds, window - seed + 1)
    first = np.concatenate([[0], np.nonzero(np.diff(chosen))[0] + 1])
    last = np.concatenate([first[1:] - 1, [len(chosen) - 1]])
    place = chosen[first]
    return seeds[place], place, first, last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    """key, text, copies: the distinct texts."""
    keyed = docs.select(content_key("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def content_key(column: str) -> Column:
    return F.unhex(F.md5(F.coalesce(column, F.lit(""))))


def seeds_of(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """anchor, copies: the anchors of every text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            rows, found = [], [np.zeros(0, np.uint64)]
            for i, text in enumerate(part.column(0).to_pylist()):
                words = text.encode().split()
                if len(words) >= window:
                    found.append(anchors(Sums(hashes(words)), len(words), window, seed)[0])
                    rows += [i] * len(found[-1])
            yield pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(found)), part.column(1).take(pa.array(rows, pa.int64()))], names=["anchor", "copies"])

    return texts.select("text", "copies").mapInArrow(run, "anchor long, copies long")


def stretches(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """key, place, anchor, s1, s2, copies: the anchors of every text with the hash of their stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            rows, cols = [], [[] for _ in range(4)]
            for i, text in enumerate(part.column(1).to_pylist()):
                words = text.encode().split()
                if len(words) < window:
                    continue
                sums = Sums(hashes(words))
                anchor, place, first, last = anchors(sums, len(words), window, seed)
                shape = (place - first).astype(np.uint64) * np.uint64(BASES[1])  # where the seed lies in its stretch
                made = (place.astype(np.int32), anchor, *(_mix(sums.runs(first, last + window, k) + shape) for k in (0, 1)))
                rows += [i] * len(place)
                for col, values in zip(cols, made):
                    col.append(values)
            place, anchor, s1, s2 = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in cols)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), pa.array(place.astype(np.int32)), _signed(anchor), _signed(s1), _signed(s2),
                 part.column(2).take(at)], names=["key", "place", "anchor", "s1", "s2", "copies"])

    return texts.mapInArrow(run, "key binary, place int, anchor long, s1 long, s2 long, copies long")


def windows(chosen: DataFrame, window: int, seed: int) -> DataFrame:
    """key, start, w1, w2, weight: the windows of the chosen anchors (``picks``: place and weight) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            rows, cols = [], [[] for _ in range(4)]
            for i, (text, picks) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                words = text.encode().split()
                sums = Sums(hashes(words))
                _, place, first, last = anchors(sums, len(words), window, seed)
                weight = np.zeros(len(words), np.int64)
                weight[[p["place"] for p in picks]] = [p["weight"] for p in picks]
                weight = np.repeat(weight[place], last - first + 1)  # of every window
                start = np.nonzero(weight)[0]
                rows += [i] * len(start)
                for col, values in zip(cols, (start.astype(np.int32), *(sums.runs(start, start + window, k) for k in (0, 1)),
                                              weight[start])):
                    col.append(values)
            start, w1, w2, weight = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in cols)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(start.astype(np.int32)), _signed(w1), _signed(w2),
                 pa.array(weight.astype(np.int64))], names=["key", "start", "w1", "w2", "weight"])

    return chosen.mapInArrow(run, "key binary, start int, w1 long, w2 long, weight long")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (key, text, copies), and key, whole, single: the anchors of repeated stretches and the starts of
    further repeated windows."""
    if not 0 < seed < window:
        raise ValueError("seed must be shorter than window")
    path = scratch_path(docs.sparkSession, "texts")
    _texts(docs).write.option("compression", "zstd").parquet(path)
    texts = docs.sparkSession.read.parquet(path)
    # a text that occurs twice is a repeat as a whole; it still counts as a partner of others
    seeds = stretches(texts, window, seed)
    met = seeds_of(texts, window, seed).groupBy("anchor").agg(F.sum("copies").alias("times")).filter("times > 1").select("anchor")
    seeds = cut_lineage(narrowed(seeds, "anchor", cut_lineage(met, "anchors")), "stretches")
    kinds = seeds.groupBy("anchor", "s1", "s2").agg(F.sum("copies").alias("times"), F.min(F.struct("key", "place")).alias("one"))
    kinds = cut_lineage(kinds, "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    twice = kinds.filter("times > 1").select("anchor", "s1", "s2")
    whole = seeds.filter("copies = 1").join(twice, ["anchor", "s1", "s2"], "left_semi").select("key", "place")
    # one copy of each of several stretches; a stretch that occurs twice weighs two, so that its windows are repeats
    picks = kinds.join(several, "anchor", "left_semi").select(
        "one.key", F.struct(F.col("one.place").alias("place"), F.least("times", F.lit(2)).alias("weight")).alias("pick"))
    picks = cut_lineage(picks.groupBy("key").agg(F.collect_list("pick").alias("picks")), "picks")
    chosen = narrowed(texts.select("key", "text"), "key", picks.select("key")).join(picks, "key")
    found = cut_lineage(windows(chosen, window, seed), "windows")
    again = found.groupBy("w1", "w2").agg(F.sum("weight").alias("times")).filter("times > 1").drop("times")
    single = found.filter("weight = 1").join(again, ["w1", "w2"], "left_semi").select("key", "start")
    marks = whole.select("key", F.lit(True).alias("whole"), F.col("place").alias("at")).unionByName(
        single.select("key", F.lit(False).alias("whole"), F.col("start").alias("at")))
    marks = marks.groupBy("key").agg(
        F.collect_list(F.when(F.col("whole"), F.col("at"))).alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.col("at"))).alias("single"))
    return texts, marks


def results(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """key, n_words, n_removed, kept (null where nothing is removed), kept_sha256, repeats (start, end in words) of every
    distinct text."""
    texts, marks = repeats(docs, window, seed)
    marks = cut_lineage(marks, "marks")
    likely = flagged(texts, "key", marks.select("key"))  # texts that certainly have no marks need no shuffle
    none = F.lit(None).cast("array<int>")
    joined = likely.filter("__likely").join(marks, "key", "left").drop("__likely").unionByName(
        likely.filter("NOT __likely").drop("__likely").withColumn("whole", none).withColumn("single", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            out = []
            for text, copies, whole, single in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                words = text.encode().split()
                n = len(words)
                gone = np.zeros(n + 1, np.int32)
                if n >= window and copies > 1:
                    gone[:n] = 1
                elif n >= window and (whole or single):
                    if whole:
                        _, place, first, last = anchors(Sums(hashes(words)), n, window, seed)
                        hit = np.isin(place, whole)
                        np.add.at(gone, first[hit], 1)
                        np.add.at(gone, last[hit] + window, -1)
                    for at in single or ():
                        gone[at] += 1
                        gone[at + window] -= 1
                    gone = np.minimum(np.cumsum(gone), 1)
                edges = np.nonzero(np.diff(np.concatenate([[0], gone[:n], [0]])))[0].tolist()
                keep = b" ".join([words[i] for i in np.nonzero(gone[:n] == 0)[0]]) if edges else b" ".join(words)
                out.append((n, int(gone[:n].sum()), keep.decode() if edges else None, hashlib.sha256(keep).hexdigest(),
                            [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]))
            cols = list(zip(*out)) if out else [()] * 5
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), span)))],
                names=["key", "n_words", "n_removed", "kept", "kept_sha256", "repeats"])

    return joined.select("key", "text", "copies", "whole", "single").mapInArrow(
        run, "key binary, n_words long, n_removed long, kept string, kept_sha256 string, "
             "repeats array<struct<start: int, end: int>>")


def mark(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats of every row."""
    found = results(docs, window, seed).drop("kept")
    return docs.select("doc_id", content_key("text").alias("key")).join(found, "key").drop("key")


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """All rows and columns; texts with repeats hold their kept words, joined by one space."""
    key, kept = fresh(docs.columns, "__key"), fresh(docs.columns, "__kept")
    changed = results(docs, window, seed).filter("kept IS NOT NULL").select(F.col("key").alias(key), F.col("kept").alias(kept))
    joined = docs.withColumn(key, content_key("text")).join(changed, key, "left")
    return joined.select(*[F.coalesce(kept, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
