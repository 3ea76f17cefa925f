"""Offset-preserving encoding with a sentencepiece BPE model, and decoding.

The text is normalised by the longest prefix found in the model's compiled character map, and the source byte of every
normalised character is recorded. Pieces are then merged by score, and each piece is projected through that record
to the bytes of the original text it came from.

Merges cannot reach over a place no piece spans (before a word's space mark, and at line ends), so texts are cut there.
Where the map changes nothing but spaces, as in models without one, the alignment is a shift by the mark put before the
text: words are then merged once each by the library, and the pieces' own lengths give their spans. Bytes of a character
that is not in the vocabulary span one byte each there, and the whole character otherwise.

Cases: a null or empty text has no pieces and decodes to the empty string; repeated rows and null ids are encoded like
any other row; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import lists, map_texts
from .words import WordIds

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

def _fields(blob: bytes) -> list[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at, out = 0, []

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            value: int | bytes = varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            value, at = blob[at:at + size], at + size
        out.append((tag >> 3, value))
    return out


class Normalizer:
    """Longest-prefix replacement through a compiled character map, keeping source positions."""

    def __init__(self, spec: bytes):
        got = dict(_fields(spec))
        blob = got.get(2, b"")
        self.dummy_prefix, self.trim, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        self.trie, self.target = np.zeros(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack("<I", blob[:4])
            self.trie, self.target = np.frombuffer(blob[4:4 + size], "<u4"), blob[4 + size:]
        self.units = self.trie.tolist()

    @property
    def plain(self) -> bool:
        """Whether only spaces change."""
        return not self.units and not self.trim and self.escape

    def _longest(self, raw: bytes, at: int) -> tuple[int, int]:
        """Bytes of the longest key that starts at ``at`` (0: none), and its value."""
        units, best = self.units, (0, 0)
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for n in range(at, len(raw)):
            node ^= raw[n]
            unit = units[node]
            if unit & 0x800000FF != raw[n]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (n + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters and its end the source byte it starts at."""
        raw, parts = text.encode(), []
        at = 0
        while at < len(raw):
            size, value = self._longest(raw, at) if self.units else (0, 0)
            if size:
                piece = self.target[value:self.target.index(b"\0", value)].decode()
            else:
                size = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                piece = raw[at:at + size].decode()
            parts.append((piece, at, at + size))
            at += size
        if self.trim:
            while parts and parts[0][0] == " ":
                parts.pop(0)
        chars: list[str] = []
        source: list[int] = []
        mark = SPACE if self.escape else " "
        if parts and self.dummy_prefix:
            chars.append(mark)
            source.append(parts[0][1])
        spaced, end = self.trim, 0
        for piece, start, stop in parts:
            if self.trim and spaced:
                piece = piece.lstrip(" ")
            if piece:
                for c in piece:
                    chars.append(mark if c == " " else c)
                    source.append(start)
                spaced = piece.endswith(" ")
            end = stop
        if self.trim:
            while chars and chars[-1] == mark:
                chars.pop()
                end = source.pop()
        return "".join(chars), [*source, end]


class PieceEncoder:
    """Pieces, ids and source spans of texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.decoder = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            top = _fields(f.read())
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte, self.unknown = {}, 0
        at = 0
        for field, value in top:
            if field == 1:
                got = dict(_fields(value))
                piece, kind = got[1].decode(), got.get(3, NORMAL)
                if kind in (USER_DEFINED, UNUSED):
                    raise ValueError("models with user-defined or unused pieces are not supported")
                if kind == NORMAL:
                    self.rank[piece] = (-struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], at)
                elif kind == BYTE:
                    self.byte[int(piece[3:5], 16)] = at
                elif kind == UNKNOWN:
                    self.unknown = at
                at += 1
            elif field == 3:
                self.normalizer = Normalizer(value)
        longer = [p for p in self.rank if len(p) > 1]
        self.cuts_words = not any(a != SPACE and b == SPACE for p in longer for a, b in zip(p, p[1:]))
        self.cuts_lines = not any("\n" in p for p in longer)
        self.width = np.array([1 if self.decoder.is_byte(i) else len(self.decoder.id_to_piece(i).replace(SPACE, " ").encode())
                               for i in range(at)], np.int32)
        self.words = WordIds(lambda new: [array("i", ids).tobytes() for ids in self.decoder.encode(new, num_threads=1)])

    def merge(self, chars: str) -> list[int]:
        """Ends of the pieces of ``chars`` after all merges, best score first and leftmost among equals."""
        n, rank = len(chars), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, queue = [True] * n, []

        def offer(left: int) -> None:
            mid = after[left]
            if mid < n:
                end = after[mid]
                best = rank.get(chars[left:end])
                if best:
                    heapq.heappush(queue, (best[0], left, mid, end))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, left, mid, end = heapq.heappop(queue)
            if not (alive[left] and after[left] == mid and mid < n and alive[mid] and after[mid] == end):
                continue
            alive[mid], after[left] = False, end
            if end < n:
                before[end] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        ends, at = [], 0
        while at < n:
            at = after[at]
            ends.append(at)
        return ends

    def unit(self, chars: str) -> tuple[list[int], list[int], list[int]]:
        """Ids of a unit, and the first and past-the-last character of each; bytes of an unknown character share its span."""
        ids, first, last, at = [], [], [], 0
        for end in self.merge(chars):
            found = self.rank.get(chars[at:end])
            own = [found[1]] if found else [self.byte[b] for b in chars[at:end].encode()] if self.byte else [self.unknown]
            ids += own
            first += [at] * len(own)
            last += [end] * len(own)
            at = end
        return ids, first, last

    def units(self, normal: str) -> list[str]:
        """``normal`` cut where no piece can reach over."""
        if not self.cuts_words:
            return [normal] if normal else []
        if self.cuts_lines and "\n" in normal:
            out: list[str] = []
            for line in normal.split("\n"):
                out += self._words(line)
                out.append("\n")
            out.pop()
            return out
        return self._words(normal)

    @staticmethod
    def _words(line: str) -> list[str]:
        first, *rest = line.split(SPACE)
        out, run = [first] if first else [], ""
        for word in rest:
            run += SPACE
            if word:
                out.append(run + word)
                run = ""
        return [*out, run] if run else out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Ids, first bytes and past-the-last bytes of the pieces in each text, as raw 32-bit integers."""
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self.normalizer.plain and self.normalizer.dummy_prefix
                 and self.cuts_words and self.byte and SPACE not in t]
        words = [i for i in plain if not (texts[i][0] == " " or texts[i][-1] == " " or "  " in texts[i])]
        for i, ids in zip(words, self.words.join([texts[i].split(" ") for i in words])):
            out[i] = self._plain_spans(ids)
        for i in set(plain).difference(words):  # runs of spaces are pieces of their own
            out[i] = self._plain_spans(array("i", self.decoder.encode(texts[i])).tobytes())
        return [self.encode_mapped(t) if got is None else got for t, got in zip(texts, out)]

    def _plain_spans(self, ids: bytes) -> tuple[bytes, bytes, bytes]:
        """Where the map changes nothing but spaces, every piece spans its own length; the first space mark none."""
        ends = np.cumsum(self.width[np.frombuffer(ids, np.int32)], dtype=np.int32) - 1
        return ids, np.maximum(np.concatenate(([0], ends[:-1])), 0).astype(np.int32).tobytes(), ends.tobytes()

    def encode_mapped(self, text: str) -> tuple[bytes, bytes, bytes]:
        """As ``encode``, by the character map, the recorded alignment and the merges written out here."""
        normal, source = self.normalizer(text)
        ids, begins, ends, at = [], [], [], 0
        for unit in self.units(normal):
            own, first, last = self.unit(unit)
            ids += own
            begins += [source[at + i] for i in first]
            ends += [source[at + i] for i in last]
            at += len(unit)
        return array("i", ids).tobytes(), array("i", begins).tobytes(), array("i", ends).tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decoder.decode(array("i", ids).tolist()) if ids else ""


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins, ends (bytes of the original UTF-8 text, end exclusive) and the text decoded from the ids.

    A map over the scan. The space mark put before a text stands for no source byte: a piece of that mark alone has
    an empty span.
    """

    def make():
        encoder = PieceEncoder(model_path)

        def each(texts: list[str]) -> list[pa.Array]:
            got = encoder.encode(texts)
            return [*(lists([g[i] for g in got], pa.int32(), 4) for i in range(3)),
                    pa.array([encoder.decode(g[0]) for g in got], pa.string())]

        return each

    return map_texts(docs, make, "ids array<int>, begins array<int>, ends array<int>, decoded string")
