"""Name similarity scores as Arrow-batched functions.

All scores are 100 * 2 * LCS / (len a + len b) (the insert/delete ratio) over
different arrangements of the words. Each batch scores a repeated pair once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_MEMO = 1 << 16


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per step."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 100.0 if size == 0 else 200.0 * _lcs(a, b) / size


@lru_cache(_MEMO)
def _sort_score(a: str, b: str) -> float:
    return _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(_MEMO)
def _set_score(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and not (only_a and only_b):
        return 100.0
    full_a, full_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    best = _ratio(full_a, full_b)
    if both:
        best = max(best, _ratio(both, full_a), _ratio(both, full_b))
    return best


def _partial_score(a: str, b: str) -> float:
    return _partial_scores([(a, b)])[0]


_WORD, _PAIRS = 64, 4096  # letters of a machine word, pairs handled at once


def _partial_scores(pairs: list[tuple[str, str]]) -> list[float]:
    """Best ratio of the shorter text of each pair against any window of its length in the longer one."""
    best, asked = [0.0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not long:
            best[k] = 100.0
        elif short:
            # of texts of equal length neither is the shorter one: both directions count
            asked += [(k, short, long), (k, long, short)] if len(a) == len(b) else [(k, short, long)]
    fits = [q for q in asked if len(q[1]) <= _WORD]
    for at in range(0, len(fits), _PAIRS):
        part = fits[at:at + _PAIRS]
        for (k, _, _), score in zip(part, _best_windows([q[1:] for q in part]).tolist()):
            best[k] = max(best[k], score)
    for k, short, long in asked:
        if len(short) > _WORD:
            best[k] = max(best[k], _best_window(short, long))
    return best


def _best_windows(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The same for short texts of up to one machine word, all windows of all pairs in step.

    One bit per letter of the short text says whether it is still unmatched; a letter of the window clears the next one
    that equals it, by one addition for all bits.
    """
    n, m = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    masks: list[int] = []
    for short, long in pairs:
        where: dict[str, int] = {}
        for i, letter in enumerate(short):
            where[letter] = where.get(letter, 0) | (1 << i)
        masks += [where.get(letter, 0) for letter in long]
    letters, count = np.array(masks, np.uint64), n + m - 1
    owner = np.repeat(np.arange(len(pairs)), count)
    first = np.cumsum(count) - count
    start = np.arange(len(owner)) - first[owner] + 1 - n[owner]
    begin, end = np.maximum(start, 0), np.minimum(start + n[owner], m[owner])
    place = (np.cumsum(m) - m)[owner] + begin
    full = np.array([(1 << int(k)) - 1 for k in n], np.uint64)[owner]
    row = full.copy()
    for step in range(int(n.max())):
        live = begin + step < end
        hit = row & np.where(live, letters[np.minimum(place + step, len(letters) - 1)], np.uint64(0))
        row = ((row + hit) | (row - hit)) & full
    shared = n[owner] - np.bitwise_count(row)
    return np.maximum.reduceat(200.0 * shared / (n[owner] + end - begin), first)


def _best_window(short: str, long: str) -> float:
    """For longer texts, one window after another."""
    n = len(short)
    return max(_ratio(short, long[max(0, start):start + n]) for start in range(1 - n, len(long)))


def _over_pairs(score, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64"
    )


def _token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    return _over_pairs(_sort_score, a, b)


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return _over_pairs(lambda x, y: max(_set_score(x, y), _sort_score(x, y)), a, b)


def _holds(a: str, b: str) -> bool:
    """Whether one text stands whole in the other, which is the full score; an empty one stands in an empty one only."""
    return (a in b or b in a) if a and b else a == b


def _may_reach(a: str, b: str, threshold: float) -> bool:
    """Whether the letters two texts share could make a window of that score: 2 s / (n + s) with s of n letters shared."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(min(short.count(c), long.count(c)) for c in set(short))
    return 200.0 * shared >= threshold * (len(short) + shared) - 1e-9


def _named_sides(texts: Iterable[str | None], homes: Iterable[str], aways: Iterable[str], threshold: float) -> list[str | None]:
    """Of each text's two names the one it holds or comes near to, the first winning ties.

    Names that share too few letters with the text cannot reach the threshold; only what is left is scored, in step.
    """
    rows = list(zip(texts, homes, aways))
    sides: dict[tuple, str | None] = {}
    open_: dict[tuple[str, str], float] = {}
    asked = []
    for row in dict.fromkeys(rows):
        text, home, away = row
        if text is None:
            sides[row] = None
        elif _holds(text, home):
            sides[row] = "home"
        elif _holds(text, away):
            sides[row] = "away"
        else:
            near = [(text, name) for name in (home, away) if _may_reach(text, name, threshold)]
            open_.update((pair, 0.0) for pair in near)
            sides[row] = None
            if near:
                asked.append(row)
    open_.update(zip(list(open_), _partial_scores(list(open_))))
    for row in asked:
        home, away = open_.get(row[:2], 0.0), open_.get((row[0], row[2]), 0.0)
        if max(home, away) >= threshold:
            sides[row] = "home" if home >= away else "away"
    return [sides[row] for row in rows]


def _scored(function, a: Column, b: Column) -> Column:
    return F.pandas_udf(function, T.DoubleType())(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Score of the two names with their words sorted."""
    return _scored(_token_sort, a, b)


def similar_ratio(a: Column, b: Column) -> Column:
    """The better of the word-set score and the sorted-word score."""
    return _scored(_similar, a, b)


def named_side(text: Column, home: Column, away: Column, threshold: float) -> Column:
    """home or away: the name that a text holds whole or that scores best against its windows, NULL under the threshold."""
    def sides(texts: pd.Series, homes: pd.Series, aways: pd.Series) -> pd.Series:
        return pd.Series(_named_sides(texts, homes, aways, threshold), dtype="object")

    return F.pandas_udf(sides, T.StringType())(text, home, away)
