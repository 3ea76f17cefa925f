"""Grouping spelling variants with a bit-sliced position index.

The index of a block of words is one bitset per (position, letter): bit i says that word i has that letter there. A word
is looked up by walking its letters once and keeping, for all words of the block at the same time, who agrees so far
without an error and who agrees but for one replaced, one additional or one missing letter; the last two read the
bitsets one position to the right or left. One walk costs a few word-parallel operations a letter, whatever the block.

Blocks come from the pigeonhole principle and miss nothing: of two words that differ in one place, the shorter with c
letters, either the first c // 2 letters agree or the last c - c // 2 do. So every word stands in four blocks: by its first
and by its last letters, as one of c letters and as one with a letter more. A pair that agrees on both sides counts in the
first only. Blocks of more than ``TILE`` words are cut by a hash into tiles; every word of the block is looked up in every
tile, and only the words near to a word leave the task, already counted.

Cases: a null or empty text holds no words; a null id is written as nothing before the colon; repeated rows count each;
texts and runs of any length are read whole; equal counts go to the smallest word in code-point order; other columns are
left out; an empty table, or one without frequent words, gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, FACTOR, SLIP = 6, 5, 5, 199
#: Words kept by a task before it hands on their counts, words of one tile, and rows of one batch.
HELD, TILE, ROWS = 200_000, 8192, 4096


def slipped(run: str, seed: int, every: int = SLIP) -> str:
    """``run`` without one letter if its hash asks for that; ``seed`` is the crc32 of what stands before the run."""
    h = zlib.crc32(run.encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = SLIP) -> DataFrame:
    """word, n: the words of at least ``least_chars`` letters that occur ``least_count`` times or more."""
    runs = re.compile(f"[{LETTERS}]{{{least_chars},}}")  # shorter runs cannot give a long enough word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seed = zlib.crc32(f"{ident}:".encode())
                lower = text.encode().lower().decode()  # of bytes, hence A-Z alone
                for found, n in Counter(runs.findall(lower)).items():
                    word = slipped(found, seed, every)
                    if len(word) >= least_chars:
                        total[word] += n
                if len(total) > HELD:
                    yield _counted(total)
                    total.clear()
        if total:
            yield _counted(total)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").filter("text <> ''")
    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


class Index:
    """One bitset per (position, letter) and per length over a block of words."""

    def __init__(self, words: list[tuple[str, int]]):
        self.words = words
        self.at: list[dict[str, int]] = []
        self.sized: dict[int, int] = {}
        for i, (word, _) in enumerate(words):
            bit = 1 << i
            while len(self.at) < len(word):
                self.at.append({})
            for slot, letter in zip(self.at, word):
                slot[letter] = slot.get(letter, 0) | bit
            self.sized[len(word)] = self.sized.get(len(word), 0) | bit
        self.at.append({})
        self.all = (1 << len(words)) - 1

    def walk(self, word: str, half: int, longer: bool) -> tuple[int, int, int, int]:
        """Bitsets of the words that start with the first ``half`` letters, and of those with one letter replaced, one
        more (unless ``longer``) or one less (only if ``longer``) than ``word``."""
        exact, swapped, more, less, begun = self.all, 0, 0, 0, 0
        before: dict[str, int] = {}
        n = len(word)
        for i, letter in enumerate(word):
            if i == half:
                begun = exact
            here = self.at[i] if i < len(self.at) else {}
            same = here.get(letter, 0)
            if longer:
                less = less & before.get(letter, 0) | exact
            else:
                after = self.at[i + 1].get(letter, 0) if i + 1 < len(self.at) else 0
                swapped = swapped & same | exact & ~same
                more = (more | exact) & after
            exact &= same
            before = here
            if not (exact or swapped or more or less):
                return begun, 0, 0, 0
        sized = self.sized.get
        return begun, swapped & sized(n, 0), (more | exact) & sized(n + 1, 0), less & sized(n - 1, 0)

    def near(self, word: str, size: int, first: bool) -> list[tuple[str, int]]:
        """The words one error away from ``word`` that this block of words of ``size`` and ``size + 1`` letters answers for.

        A block of equal last letters leaves what agrees on the first letters too to the other block.
        """
        begun, swapped, more, less = self.walk(word, size // 2, len(word) > size)
        found = swapped | more | less
        if not first:
            found &= ~begun
        out = []
        while found:
            low = found & -found
            out.append(self.words[low.bit_length() - 1])
            found ^= low
        return out


def _blocks(words: DataFrame, least_chars: int) -> DataFrame:
    """word, n, size, first, part: the blocks of every word."""
    chars = F.char_length("word")

    def block(size: Column, first: bool) -> Column:
        half = F.floor(size / 2).cast("int")
        part = F.substring("word", F.lit(1), half) if first else F.right("word", size - half)
        return F.struct(size.alias("size"), F.lit(first).alias("first"), part.alias("part"))

    every = F.array(*(block(chars - less, first) for less in (0, 1) for first in (True, False)))
    return words.select("word", "n", F.explode(every).alias("b")).select("word", "n", "b.*").filter(F.col("size") >= least_chars)


def neighbours(words: DataFrame, least_chars: int = LEAST_CHARS, tile: int = TILE) -> DataFrame:
    """word, n_near, best_n, best: how many words are one error away, and the most frequent of them."""
    key = ["size", "first", "part"]
    rows = _blocks(words, least_chars)
    sizes = rows.groupBy(*key).agg(F.count("*").alias("members"), F.min(F.char_length("word")).alias("shortest"))
    sizes = sizes.filter("members > 1 AND shortest = size").select(*key, F.ceil(F.col("members") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    met = rows.join(sizes, key).select(*key, "word", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    met = met.select(*key, "tile", "word", "n", (F.col("own") == F.col("tile")).alias("held"))
    placed = met.repartition(*key, "tile").sortWithinPartitions(*key, "tile", F.desc("held"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index, out = None, [], None, []

        def look() -> None:
            for word, n in held:
                answer(word)

        def answer(word: str) -> None:
            found = index.near(word, current[0], current[1])
            if found:
                best = min(found, key=lambda f: (-f[1], f[0]))
                out.append((word, len(found), best[1], best[0]))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for size, first, part, at, word, n, is_held in zip(*columns):
                block = (size, first, part, at)
                if block != current:
                    if current is not None and index is None and len(held) > 1:
                        index = Index(held)
                        look()
                    current, held, index = block, [], None
                if is_held:
                    held.append((word, n))
                    continue
                if index is None:  # words of other tiles follow the tile's own
                    index = Index(held)
                    look()
                answer(word)
            while len(out) >= ROWS:
                yield _found(out[:ROWS])
                del out[:ROWS]
        if current is not None and index is None and len(held) > 1:
            index = Index(held)
            look()
        if out:
            yield _found(out)

    near = placed.mapInArrow(run, "word string, n_near long, best_n long, best string")
    one = near.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("o"), "best", "best_n")).alias("b"))
    return one.select("word", "n_near", F.col("b.best_n").alias("best_n"), F.col("b.best").alias("best"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    word, n_near, best_n, best = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(word, pa.string()), pa.array(n_near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
        names=["word", "n_near", "best_n", "best"])


def group(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR,
          every: int = SLIP, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n.

    A word's form is its most frequent neighbour, if that occurs ``factor`` times as often. Forms of forms are followed
    by doubling: counts grow by the factor with every step, so chains are short and have no circles.
    """
    words = cut_lineage(word_counts(docs, least_chars, least_count, every), "words")
    known = words.join(neighbours(words, least_chars, tile), "word", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    known = cut_lineage(known.select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n")), "forms")
    roots = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut_lineage(roots.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                        F.col("next").isNotNull().alias("moved")), "roots")
        roots = stepped.select("word", "root")
        if not stepped.filter("moved").limit(1).count():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
