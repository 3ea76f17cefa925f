"""Cross-tokenizer alignment with external spill counting.

Every text is encoded by a byte-level tokenizer (A, the text after one space) and by a sentence-piece model (B, which adds
that space itself). Tokens are byte ranges; byte offsets at which both a token of A and one of B end cut a text into
groups, and two tokens are linked where their ranges overlap. How often a pair of ids is linked in the whole corpus, and
which A id is linked most with a B id, is counted outside memory:

1. A task keeps pair-document records of at most ``RUN_DOCS`` texts or about ``RUN_RECORDS`` records, then sorts them by pair,
   B id first, cuts them by a radix of the B id and hands every piece on as one compressed run, its distinct pairs with
   their totals apart from the documents. The runs are written once to the shared folder.
2. The pairs of the runs meet by radix, first those of one salt, then all salts. Runs are merged ``FAN_IN`` at a time with a
   heap of their next chunks, so that memory follows the distinct pairs of a radix, which the vocabularies bound. As pairs
   come out side by side for each B id, its maximum is known as soon as its last pair is.
3. Every run meets the counts of its radix, spread by salt, and streams back what each of its documents gains: the sum of
   the counts of its links and how many of them are their B id's best. A document's gains add up where its run ends.

The salt is a hash of the run, so a B id that holds a third of all links is dealt over all salts, and a document over as
many places as it has radixes. Texts are encoded in units that no token reaches over, and a unit seen before is looked up.

Cases: a null or empty text, and one whose tokens do not spell the text (it holds the space mark itself), has no tokens:
zeros and an empty digest; special tokens' strings are plain text; repeated rows count and are returned each; null ids
are returned; texts of any length are read whole; ties for the highest count are all best; other columns are left out
(``keep``) and clashing names give way to the results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .arrow import slices
from .pieces import SPACE, PieceEncoder

RADIX, SALTS, RUN_DOCS, RUN_RECORDS, FAN_IN, CHUNK = 128, 16, 4096, 1 << 19, 64, 8192
#: Units remembered by a task, the length up to which they outlive the others, and the one from which they are forgotten.
UNITS, SHORT, LONG = 160_000, 10, 64

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_CUT_SPACE = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Aligner:
    """Encodes texts with both tokenizers; a unit's value is (n_a, n_b, n_groups, groups as text, raw pair codes)."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = PieceEncoder(b_path)
        self.b = pieces.decoder
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(t) for t in each], np.int64) for each in (self.a_bytes, self.b_bytes))
        numbers = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.text = {mark: np.array([n + mark for n in numbers], object) for mark in ",|;"}
        plain = pieces.normalizer
        before = spec.get("pre_tokenizer") or {}
        own_a = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                 and not spec.get("normalizer"))
        own_b = plain.plain and plain.dummy_prefix and pieces.cuts_words and bool(pieces.byte)
        self.cut = (_CUT if pieces.cuts_lines else _CUT_SPACE) if own_a and own_b else None
        self.known: dict[str, tuple | None] = {}

    def _alone(self, unit: str) -> tuple | None:
        """None where the tokens do not spell the unit."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        b = self.b.encode(unit[1:]) if unit[0] == " " else self.b.encode(unit)[1:]  # no mark before a unit that starts a line
        x, y, whole = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b], unit.encode()
        if b"".join(x) != whole or b"".join(y) != whole:
            return None
        return self._cut(a, b, np.array([len(whole)]))[0]

    def _values(self, units: list[str]) -> list[tuple | None]:
        """The units' values; those that may follow each other in a text are encoded as one text."""
        together = [u for u in units if not u[-1].isspace() and SPACE not in u] if self.cut else []
        done: dict[str, tuple | None] = {}
        if together:
            text = "".join(together)
            first = text[0] == " "
            a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without offsets
            b = self.b.encode(text[1:]) if first else self.b.encode(text)[1:]
            if b"".join(map(self.b_bytes.__getitem__, b)) == text.encode():
                done = dict(zip(together, self._cut(a, b, np.cumsum([len(u.encode()) for u in together]))))
        return [done[u] if u in done else self._alone(u) for u in units]

    def _cut(self, a: list[int], b: list[int], unit_ends: np.ndarray) -> list[tuple]:
        """The values of neighbouring units whose tokens are ``a`` and ``b``.

        Between two neighbouring ends of any token lies the overlap of exactly one pair: these stretches are the links.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(a_ends, b_ends)
        i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        codes = (b[j] << 32 | a[i]).astype(np.uint64).tobytes()
        common = ends[(a_ends[i] == ends) & (b_ends[j] == ends)]
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        texts = np.empty(len(a) + len(b), object)
        texts[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = np.where(
            common[a_group] == a_ends, self.text["|"][a], self.text[","][a])
        texts[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = np.where(
            common[b_group] == b_ends, self.text[";"][b], self.text[","][b])
        texts = texts.tolist()
        at = [[0, *(np.searchsorted(e, unit_ends) + 1).tolist()] for e in (a_ends, b_ends, common, ends)]
        out = []
        for (x, x2), (y, y2), (g, g2), (l, l2) in zip(*(zip(e, e[1:]) for e in at)):
            out.append((x2 - x, y2 - y, g2 - g, "".join(texts[x + y:x2 + y2])[:-1], codes[8 * l:8 * l2]))
        return out

    def units(self, text: str) -> list[str]:
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def __call__(self, texts: list[str]) -> list[tuple | None]:
        """One value per text; None for a text without tokens."""
        cut = [self.units(t) if t else [] for t in texts]
        if len(self.known) > UNITS:
            self.known = {u: v for u, v in self.known.items() if len(u) <= SHORT}
            if len(self.known) > UNITS // 2:
                self.known = {}
        new = list(set().union(*cut).difference(self.known))
        self.known.update(zip(new, self._values(new)))
        out = []
        for text, units in zip(texts, cut):
            values = [self.known[u] for u in units]
            if None in values:  # its tokens may yet spell the text as a whole
                values = [self._alone(" " + text)]
            if not values or None in values:
                out.append(None)
                continue
            n_a, n_b, n_groups, groups, codes = zip(*values)
            out.append((sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(codes)))
        for unit in new:
            if len(unit) > LONG:
                del self.known[unit]
        return out


@lru_cache(1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One for all tasks that a Python worker runs, units seen so far included."""
    return Aligner(a_path, b_path)


# Runs ------------------------------------------------------------------------------------

def _pack(*arrays: np.ndarray) -> bytes:
    """Integer columns as one compressed string; sorted columns shrink to their steps."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()]
    for a in arrays:
        values = a.astype("<i8")
        parts.append(np.diff(values, prepend=0).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i8")
    sizes = raw[1:1 + int(raw[0])]
    out, at = [], 1 + int(raw[0])
    for n in sizes.tolist():
        out.append(np.cumsum(raw[at:at + n]))
        at += n
    return out


def _radix(codes: np.ndarray, radix: int) -> np.ndarray:
    return (((codes >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(7)) % np.uint64(radix)


class RunWriter:
    """Keeps the pair-document records of some texts and gives them out as sorted runs, one per radix."""

    def __init__(self, radix: int):
        self.radix = radix
        self.clear()

    def clear(self) -> None:
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.records = self.held = 0

    def add(self, codes: bytes | None) -> int:
        """The document's number in this run."""
        at = self.held
        self.held += 1
        if codes:
            own, times = np.unique(np.frombuffer(codes, np.uint64), return_counts=True)
            self.codes.append(own)
            self.times.append(times)
            self.docs.append(np.full(len(own), at))
            self.records += len(own)
        return at

    @property
    def full(self) -> bool:
        return self.held >= RUN_DOCS or self.records >= RUN_RECORDS

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """radix, its sorted distinct pairs with totals, and per pair its documents and how often they hold it."""
        if not self.codes:
            return
        codes, times, docs = map(np.concatenate, (self.codes, self.times, self.docs))
        order = np.argsort(codes, kind="stable")  # documents stay in order
        codes, times, docs = codes[order], times[order], docs[order]
        slot = _radix(codes, self.radix)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        codes, times, docs, slot = codes[order], times[order], docs[order], slot[order]
        cuts = np.flatnonzero(np.diff(slot)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]):
            own = codes[begin:end]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            totals = np.add.reduceat(times[begin:end], first)
            sizes = np.diff(np.append(first, end - begin))
            yield int(slot[begin]), _pack(own[first], totals), _pack(sizes, docs[begin:end], times[begin:end])


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs of (pairs, totals) as one, in chunks: a heap says whose next chunk starts lowest, and what lies below
    every chunk still to come is complete."""
    heap = [(int(pairs[0]), k, 0) for k, (pairs, _) in enumerate(runs) if len(pairs)]
    heapq.heapify(heap)
    pairs, totals = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while heap:
        parts = [(pairs, totals)]
        taken = 0
        while heap and taken < CHUNK:
            _, k, at = heapq.heappop(heap)
            own = runs[k]
            parts.append((own[0][at:at + CHUNK], own[1][at:at + CHUNK]))
            taken += len(parts[-1][0])
            if at + CHUNK < len(own[0]):
                heapq.heappush(heap, (int(own[0][at + CHUNK]), k, at + CHUNK))
        every, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, place, np.concatenate([t for _, t in parts]))
        done = np.searchsorted(every, heap[0][0]) if heap else len(every)
        if done:
            yield every[:done], sums[:done]
        pairs, totals = every[done:], sums[done:]


def folded(runs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All runs as one, merged ``FAN_IN`` at a time."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        chunks = list(merged(waiting))
        waiting[:] = [tuple(map(np.concatenate, zip(*chunks)))] if chunks else []

    for run in runs:
        waiting.append(tuple(_unpack(run)[:2]))
        if len(waiting) >= FAN_IN:
            fold()
    fold()
    return waiting[0] if waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def best(pairs: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Per pair, 1 where no other pair of its B id has a higher total. Pairs of one B id are neighbours."""
    side = pairs >> 32
    first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
    top = np.repeat(np.maximum.reduceat(totals, first), np.diff(np.append(first, len(side))))
    return (totals == top).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of neighbouring equal keys (the first ``keys`` columns), streamed."""
    rows = (row for part in slices(batches) for row in zip(*(c.to_pylist() for c in part.columns)))
    yield from groupby(rows, key=lambda r: r[:keys])


# Jobs ------------------------------------------------------------------------------------

_FACTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_runs(docs: DataFrame, make: Callable[[], Aligner], radix: int, kind: str) -> DataFrame:
    """Document rows (radix null) with their facts and place, and the runs of their pair-document records."""
    fields = ["run", "at", "doc_id", *_FACTS, "groups_sha256", "radix", "pairs", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, writer, number = make(), RunWriter(radix), TaskContext.get().partitionId() << 32

        def spilled() -> Iterator[pa.RecordBatch]:
            for slot, pairs, held in writer.runs():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in _FACTS),
                     pa.nulls(1, pa.string()), pa.array([slot], pa.int32()), pa.array([pairs], pa.binary()),
                     pa.array([held], pa.binary())], names=fields)

        id_type = None
        for part in slices(batches):
            id_type = part.column(0).type
            values = aligner(part.column(1).to_pylist())
            begin = 0
            while begin < len(values):  # a run may end within the batch
                at, facts, digests = [], [], []
                for value in values[begin:]:
                    at.append(writer.add(value and value[4]))
                    n_a, n_b, n_groups, groups, _ = value or (0, 0, 0, None, None)
                    facts.append((n_a, n_b, n_groups, n_a + n_b - n_groups))
                    digests.append(hashlib.sha256(groups.encode()).hexdigest() if value else "")
                    if writer.full:
                        break
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int64()), pa.array(at, pa.int32()), part.column(0).slice(begin, n),
                     *(pa.array(f, pa.int64()) for f in zip(*facts)), pa.array(digests, pa.string()), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=fields)
                begin += n
                if writer.full:
                    yield from spilled()
                    writer.clear()
                    number += 1
        yield from spilled()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"run long, at int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                 "groups_sha256 string, radix int, pairs binary, docs binary")


def pair_counts(runs: DataFrame, salts: int) -> DataFrame:
    """radix, counts: all pairs of a radix with their totals and whether they are their B id's best, as one run."""

    def fold(keys: int, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, rows in _groups(batches, keys):
                pairs, totals = folded(r[keys] for r in rows)
                packed = _pack(pairs, totals, best(pairs, totals)) if last else _pack(pairs, totals)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([packed], pa.binary())], names=["radix", "counts"])

        return run

    salted = runs.select("radix", _salt(salts).alias("salt"), "pairs").repartition("radix", "salt")
    once = salted.sortWithinPartitions("radix", "salt").mapInArrow(fold(2, False), "radix int, counts binary")
    return once.repartition("radix").sortWithinPartitions("radix").mapInArrow(fold(1, True), "radix int, counts binary")


def _salt(salts: int):
    return F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int")


def gains(runs: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """run, gains: for the documents of a run that hold pairs of one radix, their best links and summed counts."""
    spread = counts.select("radix", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("run"),
                           F.col("counts").alias("pairs"), F.lit(None).cast("binary").alias("docs"))
    own = runs.select("radix", _salt(salts).alias("salt"), "run", "pairs", "docs")
    met = spread.unionByName(own).repartition("radix", "salt").sortWithinPartitions("radix", "salt", F.asc_nulls_first("run"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 2):
            every = totals = tops = None
            for _, _, number, pairs, docs in rows:
                if number is None:
                    every, totals, tops = _unpack(pairs)
                    continue
                at = np.searchsorted(every, _unpack(pairs)[0])
                sizes, doc, times = _unpack(docs)
                at = np.repeat(at, sizes)
                held, place = np.unique(doc, return_inverse=True)
                top, total = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
                np.add.at(top, place, times * tops[at])
                np.add.at(total, place, times * totals[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([_pack(held, top, total)], pa.binary())], names=["run", "gains"])

    return met.mapInArrow(run, "run long, gains binary")


def align(docs: DataFrame, a_path: str, b_path: str, radix: int = RADIX, salts: int = SALTS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``radix`` times ``salts`` is the number of places that records are dealt to.
    """
    return _returned(*_counted(docs, a_path, b_path, radix, salts), salts)


def pairs(docs: DataFrame, a_path: str, b_path: str, radix: int = RADIX, salts: int = SALTS) -> DataFrame:
    """b_id, a_id, n, is_best: every linked pair of ids with its count."""
    _, counts = _counted(docs, a_path, b_path, radix, salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            every, totals, tops = _unpack(part.column(1)[0].as_py())
            for at in range(0, len(every), CHUNK):
                cut = slice(at, at + CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every[cut] >> 32), pa.array(every[cut] & 0xFFFFFFFF), pa.array(totals[cut]), pa.array(tops[cut] > 0)],
                    names=["b_id", "a_id", "n", "is_best"])

    return counts.mapInArrow(run, "b_id long, a_id long, n long, is_best boolean")


def _counted(docs: DataFrame, a_path: str, b_path: str, radix: int, salts: int) -> tuple[DataFrame, DataFrame]:
    kind = docs.schema["doc_id"].dataType.simpleString()
    written = cut_lineage(aligned_runs(docs, lambda: _aligner(a_path, b_path), radix, kind), "runs")
    return written, cut_lineage(pair_counts(written.filter("radix IS NOT NULL"), salts), "counts")


def _returned(written: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    kind = written.schema["doc_id"].dataType.simpleString()
    facts = written.filter("radix IS NULL").select("run", F.lit(1).alias("late"), F.lit(None).cast("binary").alias("gains"), "at",
                                                   "doc_id", *_FACTS, "groups_sha256")
    gained = gains(written.filter("radix IS NOT NULL"), counts, salts).select("run", F.lit(0).alias("late"), "gains")
    met = gained.unionByName(facts, allowMissingColumns=True).repartition("run").sortWithinPartitions("run", "late")
    names = ["doc_id", *_FACTS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, top, total = None, None, None
        for part in slices(batches, 1024):
            numbers, late = np.asarray(part.column(0)), np.asarray(part.column(1))
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]) | (late[1:] != late[:-1])) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                if numbers[begin] != current:
                    current, top, total = numbers[begin], np.zeros(RUN_DOCS, np.int64), np.zeros(RUN_DOCS, np.int64)
                rows = part.slice(begin, end - begin)
                if not late[begin]:
                    for packed in rows.column(2).to_pylist():
                        held, more_top, more = _unpack(packed)
                        top[held] += more_top
                        total[held] += more
                    continue
                at = np.asarray(rows.column(3))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(4, 9)] + [pa.array(top[at]), pa.array(total[at]), rows.column(9)], names=names)

    return met.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                               "groups_sha256 string")
