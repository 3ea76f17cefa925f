"""Secrets by fixed rules and by a linear-chain conditional random field.

A line is a chain of its white-space words, tagged B (a secret begins), I (it goes on) or O. A word's emission adds
what its own shape says, what the two words before and the one after say, and the share of coded-looking words in the
file; the transition weights do the rest. The field is fitted by maximum likelihood on the rule matches of a bounded
sample (``FIT_DOCS`` texts with a match and a third as many without, of up to ``FIT_CHARS`` characters) and decoded by
Viterbi over every line. A neighbouring word counts by its first 24 letters; the word itself is always looked at whole.

Where every word's best secret emission is too far below its O emission to be made up by transitions, the all-O path
is the Viterbi path, so only lines with a word beyond that bound are decoded step by step.

Cases: a null or empty text has no spans; repeated rows and null ids are scanned like any other row; other columns are
left out (``find``) or kept (``redact``); without rule matches to learn from, the field adds nothing; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .arrow import map_texts, replace_text

# The rules whose matches every result holds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "crf")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")  # the whole runs of that length
_NAMES = ("passw", "secret", "token", "api")
CORE = re.compile(r"[A-Za-z0-9+/_.=-]+")

FIT_DOCS, FIT_CHARS, WINDOW = 1200, 100_000, 12
BUCKETS, WORDS = 1 << 14, 800_000
OFF = -1e4
O, B, I = 0, 1, 2


def rules(text: str) -> list[tuple[int, int, int, int, int]]:
    """Rule matches as (kind, start, end, start and end of the secret itself), leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(0, *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, *m.span(), *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if any(len(w) >= HEX_LEAST for w in text.split()):
        out += [(2, *m.span(), *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _bucket(*names: str) -> list[int]:
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


MARKS = "\"'.,;:!?()[]{}<>|*#%&$"


def look(word: str) -> tuple:
    """What a word looks like: size, kinds of characters, variety, coded or not."""
    core = word.strip(MARKS)
    if core.isalpha():
        digit = symbol = False
        lower, upper = not core.isupper(), not core.islower()
        hexes = len(core) >= 6 and not core.strip("abcdefABCDEF")
    else:
        core = max(CORE.findall(word) or [""], key=len)
        digit, symbol = core.strip("0123456789") != core or any(c.isdigit() for c in core), not core.isalnum()
        lower, upper = core.upper() != core, core.lower() != core
        hexes = len(core) >= 6 and not core.strip("0123456789abcdefABCDEF")
    size = min(len(core) // 4, 12)
    varied = 8 * len(set(core)) // min(len(core), 16) if core else 0
    return size, digit, lower, upper, symbol, hexes, varied, word[0] in MARKS[:2], digit and (lower or upper) and len(core) >= 12


def own_buckets(seen: tuple) -> list[int]:
    size, digit, lower, upper, symbol, hexes, varied, quoted, coded = seen
    kinds = f"{digit:d}{lower:d}{upper:d}{symbol:d}"
    return _bucket("bias", f"size {size}", f"kinds {kinds}", f"kinds {kinds} {size}", f"hex {hexes} {digit} {size}",
                   f"varied {varied} {size}", f"quoted {quoted}", f"coded {coded}", f"quoted {quoted} coded {coded}")


def near(word: str) -> str:
    """A word as its neighbours see it: its letters, or a short mark."""
    return (word.lower().strip(MARKS) or word)[:24]


def near_buckets(name: str) -> tuple[list[int], list[int]]:
    return _bucket(f"one before {name}"), _bucket(f"two before {name}")


def after_buckets(seen: tuple) -> list[int]:
    return _bucket(f"after {seen[:5]}")


def file_bucket(words: int, machine: int) -> int:
    """The file's share of coded words, coarsely."""
    return 0 if not machine else 1 + min(3, int(20 * machine / max(words, 1)))


@dataclass
class Field:
    weights: np.ndarray  # buckets x tags
    file: np.ndarray  # file buckets x tags
    steps: np.ndarray  # tag x next tag
    names: frozenset[str]  # neighbours that the fit has seen; others say nothing


class Tagger:
    def __init__(self, field: Field | None):
        self.field = field
        self.index: dict[str, int] = {"": 0}
        self.kinds: dict[tuple, int] = {}
        self.rows = [np.array([0, OFF, OFF] + [0.0] * 10)]  # row 0 stands between lines
        self.table = np.array(self.rows)

    def _row(self, word: str) -> int:
        """The row of a word's weights; words that look alike and are no known neighbour share one."""
        seen, name = look(word), near(word)
        key = (seen, name if name in self.field.names else None)
        at = self.kinds.get(key)
        if at is None:
            at = self.kinds[key] = len(self.rows)
            parts = [own_buckets(seen), *(near_buckets(name) if key[1] is not None else ([], [])), after_buckets(seen)]
            self.rows.append(np.concatenate([*(self.field.weights[p].sum(0) for p in parts), [float(seen[-1])]]))
        return at

    def tags(self, lines: list[list[str]]) -> dict[int, list[int]]:
        """Viterbi tags of the lines that hold a secret; every other line is all O."""
        if self.field is None:
            return {}
        if len(self.index) > WORDS:
            self.index = {w: i for w, i in self.index.items() if len(w) <= 9} if len(self.index) < 2 * WORDS else {"": 0}
        known, padded = self.index, ["", ""]
        starts = []
        for line in lines:
            starts.append(len(padded))
            padded += line
            padded += ("", "")
        for w in set(padded).difference(known):
            known[w] = self._row(w)
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table):])])
        at = np.fromiter(map(known.__getitem__, padded), np.int64, len(padded))
        rows = self.table[at]
        emit = rows[:, 0:3].copy()
        emit[1:] += rows[:-1, 3:6]
        emit[2:] += rows[:-2, 6:9]
        emit[:-1] += rows[1:, 9:12]
        words = sum(map(len, lines))
        emit += self.field.file[file_bucket(words, int(rows[:, 12].sum()))]
        rise = max(0.0, float((self.field.steps - self.field.steps[O, O]).max()))
        hits = np.nonzero(np.maximum(emit[:, B], emit[:, I]) - emit[:, O] + 2 * rise >= 0)[0]
        lines_hit = sorted(set((np.searchsorted(starts, hits, "right") - 1).tolist())) if len(hits) else []
        out = {}
        for k in lines_hit:
            if k >= 0 and lines[k]:
                got = self.viterbi(emit[starts[k]:starts[k] + len(lines[k])].tolist())
                if any(got):
                    out[k] = got
        return out

    def viterbi(self, emit: list[list[float]]) -> list[int]:
        steps = self.field.steps.tolist()
        best, back = [emit[0][O], emit[0][B], emit[0][I] + OFF], []
        for e in emit[1:]:
            new, ways = [], []
            for tag in (O, B, I):
                options = [best[p] + steps[p][tag] for p in (O, B, I)]
                way = options.index(max(options))
                ways.append(way)
                new.append(options[way] + e[tag])
            best = new
            back.append(ways)
        tag = best.index(max(best))
        path = [tag]
        for ways in reversed(back):
            tag = ways[tag]
            path.append(tag)
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of the tagged secrets, without the marks around them."""
        lines = text.split("\n")
        found, out = self.tags([line.split() for line in lines]), []
        if not found:
            return out
        at = 0
        for k, line in enumerate(lines):
            if k in found:
                start = end = None
                for tag, m in zip([*found[k], O], [*re.finditer(r"\S+", line), None]):
                    if tag != I and start is not None:
                        out.append((at + start, at + end))
                        start = None
                    if tag != O and m is not None:
                        core = max(CORE.finditer(m[0]), key=lambda c: len(c[0]), default=None)
                        if core is not None:
                            start = m.start() + core.start() if start is None else start
                            end = m.start() + core.end()
            at += len(line) + 1
        return out


def find_spans(text: str, tagger: Tagger) -> list[tuple[int, int, int]]:
    """Rule matches, and tagged secrets that overlap none, as (kind, start, end)."""
    base = [s[:3] for s in rules(text)]
    more = [(3, a, b) for a, b in tagger.spans(text) if not any(a < e and s < b for _, s, e in base)]
    return sorted(base + more, key=lambda s: (s[1], s[0]))


def _examples(texts: list[str]) -> list[tuple[list[str], list[int], int]]:
    """Windows of words with their tags: around rule matches, and one line of every text without."""
    out = []
    for n, text in enumerate(texts):
        secret, at = [s[3:5] for s in rules(text)], 0
        lines = [[(m[0], at_line + m.start(), at_line + m.end()) for m in re.finditer(r"\S+", line)]
                 for line, at_line in _lines(text)]
        words = [w for line in lines for w, _, _ in line]
        file = file_bucket(len(words), sum(look(w)[-1] for w in words))
        taken = False
        for line in lines:
            tags, last = [], None
            for _, a, b in line:
                hit = next((s for s in secret if a < s[1] and s[0] < b), None)
                tags.append(O if hit is None else I if hit == last else B)
                last = hit
            if any(tags):
                covered = 0
                for i, tag in enumerate(tags):
                    if tag and i >= covered:  # every secret of the line is in one window at least
                        covered = i + WINDOW
                        cut = slice(max(0, i - WINDOW), covered)
                        out.append(([w for w, _, _ in line[cut]], tags[cut], file))
            elif line and not taken and (at := at + 1) > n % 3:
                odd = next((i for i, (w, _, _) in enumerate(line) if any(map(str.isdigit, w))), (7 * n) % len(line))
                cut = slice(max(0, odd - WINDOW), odd + WINDOW)
                out.append(([w for w, _, _ in line[cut]], tags[cut], file))
                taken = True
    return out


def _lines(text: str):
    at = 0
    for line in text.split("\n"):
        yield line, at
        at += len(line) + 1


def fit(texts: list[str], rounds: int = 80, rate: float = 0.1, decay: float = 1e-3) -> Field | None:
    """Maximum likelihood by forward-backward over all example windows at once.

    Every window with a secret counts a second time without its neighbours, so that shape alone can tell.
    """
    cases = [(*c, True) for c in _examples(texts) if c[0]]
    cases += [(*c[:3], False) for c in cases if any(c[1])]
    if not any(any(c[1]) for c in cases):
        return None
    names: set[str] = set()
    n, size = len(cases), max(len(c[0]) for c in cases)
    y, live = np.zeros((n, size), int), np.zeros((n, size), bool)
    cell, bucket = [], []
    for i, (words, tags, _, context) in enumerate(cases):
        y[i, :len(tags)], live[i, :len(tags)] = tags, True
        seen = [look(w) for w in words]
        for t in range(len(words)):
            own = own_buckets(seen[t])
            if context:
                called = [near(w) for w in words[max(0, t - 2):t]]
                names.update(called)
                own += (near_buckets(called[-1])[0] if t else []) + (near_buckets(called[0])[1] if t > 1 else [])
            own += after_buckets(seen[t + 1]) if t + 1 < len(words) else []
            cell += [i * size + t] * len(own)
            bucket += own
    cell, bucket = np.array(cell), np.array(bucket)
    file = np.array([c[2] for c in cases])
    weights, files, steps = np.zeros((BUCKETS, 3)), np.zeros((5, 3)), np.zeros((3, 3))
    lawful = np.where(np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]]) > 0, 0.0, OFF)
    start = np.array([0.0, 0.0, OFF])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, files, steps)]
    gold = np.eye(3)[y] * live[..., None]
    for step in range(1, rounds + 1):
        emit = np.stack([np.bincount(cell, weights[bucket, k], n * size).reshape(n, size) for k in range(3)], 2)
        emit += files[file][:, None, :]
        move = steps + lawful
        fore, aft = np.zeros((n, size, 3)), np.zeros((n, size, 3))
        fore[:, 0] = start + emit[:, 0]
        for t in range(1, size):
            new = np.logaddexp.reduce(fore[:, t - 1, :, None] + move[None], axis=1) + emit[:, t]
            fore[:, t] = np.where(live[:, t, None], new, fore[:, t - 1])
        total = np.logaddexp.reduce(fore[:, -1], axis=1)
        for t in range(size - 2, -1, -1):
            new = np.logaddexp.reduce(move[None] + (emit[:, t + 1] + aft[:, t + 1])[:, None, :], axis=2)
            aft[:, t] = np.where(live[:, t + 1, None], new, 0.0)
        belief = np.exp(np.minimum(fore + aft - total[:, None, None], 0)) * live[..., None]
        gap = gold - belief
        flat = gap.reshape(-1, 3)
        g_w = np.stack([np.bincount(bucket, flat[cell, k], BUCKETS) for k in range(3)], 1) / n - decay * weights
        g_f = np.stack([np.bincount(file, gap[:, :, k].sum(1), 5) for k in range(3)], 1) / n - decay * files
        both = live[:, 1:, None, None]
        pair = np.exp(np.minimum(fore[:, :-1, :, None] + move[None, None] + (emit + aft)[:, 1:, None, :]
                                 - total[:, None, None, None], 0)) * both
        seen = (np.eye(3)[y[:, :-1]][..., :, None] * np.eye(3)[y[:, 1:]][..., None, :]) * both
        g_s = (seen - pair).sum((0, 1)) / n - decay * steps
        for p, g, (m, v) in zip((weights, files, steps), (g_w, g_f, g_s), moments):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g**2
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(weights, files, steps + lawful, frozenset(names))


def train(docs: DataFrame, rows: int = FIT_DOCS, chars: int = FIT_CHARS) -> Field | None:
    """Fit on up to ``rows`` distinct texts with a rule match and a third as many others, lowest text hash first.

    Texts of more than ``chars`` characters are not learned from. Whether a rule matches is asked once a text; only the
    sample's texts come to the driver.
    """
    text = docs.select("text", F.xxhash64("text").alias("h")).filter((F.length("text") > 0) & (F.length("text") <= chars))
    marked = F.contains("text", F.lit(":")) | F.contains("text", F.lit("="))
    hit = ((marked & F.col("text").rlike(f"(?i:{ASSIGN})"))
           | (F.contains("text", F.lit("AKIA")) & F.col("text").rlike(f"{ACCESS[:-1]}{{{ACCESS_LEAST - 4}}}"))
           | F.col("text").rlike(f"{HEX[:-1]}{{{HEX_LEAST}}}"))
    known = cut_lineage(text.select("h", hit.alias("hit")).distinct(), "hits")
    lowest = [known.filter(F.col("hit") == h).orderBy("h").limit(n) for h, n in ((True, rows), (False, rows // 3))]
    sample = F.broadcast(lowest[0].unionByName(lowest[1]))  # at most rows + rows // 3 rows
    picked = text.join(sample, "h").groupBy("h", "hit").agg(F.min("text").alias("text")).orderBy(F.desc("hit"), "h").collect()
    return fit([r["text"] for r in picked])


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id and its spans (kind, start, end; code points, end exclusive), by start and then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        tagger = Tagger(shared.value)

        def each(texts: list[str]) -> list[pa.Array]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in find_spans(t, tagger)]
                              for t in texts], kind)]

        return each

    return map_texts(docs, make, "spans array<struct<kind: string, start: int, end: int>>")


def redact(docs: DataFrame, field: Field | None, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, every secret in ``text`` replaced by ``mark``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        tagger = Tagger(shared.value)

        def clean(text: str) -> str:
            out, at = [], 0
            for _, start, end in find_spans(text, tagger):
                if end > at:
                    out += [text[at:start], mark] if start >= at else []
                    at = end
            return "".join([*out, text[at:]])

        return lambda texts: [clean(t) for t in texts]

    return replace_text(docs, make)
