"""Packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences of the longest length and then into one piece for every binary
digit of the rest, longest first. Every piece has a power-of-two length, fills one sequence of that length and so
needs no padding; a sequence never crosses documents. Pieces of equal length share a bucket, and ``batch_id`` groups
``max_len / length`` of them into batches of ``max_len`` tokens, so that a trainer reads batches of one shape.

Cases: a null or empty text is the end token alone; repeated rows and repeated or null ids are packed like any other
row; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow import lists, slices
from .words import WORD_CHARS, WordIds
#: Outside these characters the order of composing and lower-casing, or the rule for it, could matter.
BEYOND_LATIN = re.compile(r"[^\x00-\u012f\u0131-\u017f]")


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space and lower-cases.

    No token of such a tokenizer reaches over white space, so a text's ids are its words' ids in a row, and each
    distinct word is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        self.tokenizer = tokenizer
        suffix = tokenizer.model.end_of_word_suffix or "\0"
        self.closes = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        self.closes[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.words = WordIds(self._encode_words)
        self.marks = {m: array("I", tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,"}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        return self.words.join([self._split(t) for t in texts])

    def _encode_words(self, new: list[str]) -> list[bytes]:
        """A stop or comma after a letter is a token of its own, so the word before it is encoded without it."""
        known = self.words.known
        cores = [w[:-1] if w[-1:] in self.marks and w[-2:-1].isalpha() else w for w in new]
        missing = [c for c in dict.fromkeys(cores) if c not in known]
        letters = [c for c in missing if c.isalpha() and not BEYOND_LATIN.search(c)]
        fresh = dict(zip(letters, self._encode_letters(letters)))
        others = [c for c in missing if c not in fresh]
        made = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        fresh.update((c, array("I", e.ids).tobytes()) for c, e in zip(others, made))
        known.update({c: b for c, b in fresh.items() if len(c) <= WORD_CHARS})
        return [(fresh.get(c) or known.get(c, b"")) + (b"" if c is w else self.marks[w[-1]]) for c, w in zip(cores, new)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Words of letters alone are one run each, so that the token that closes a run parts them in a joined text."""
        out: list[bytes] = []
        for at in range(0, len(words), 256):
            part = words[at:at + 256]
            joined = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]  # without offsets
            ids = np.array(joined.ids, np.uint32)
            ends = np.nonzero(self.closes[ids])[0] + 1
            if len(ends) != len(part):
                out += [array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in part]
                continue
            raw, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(ends, ends[1:])]
        return out

    @staticmethod
    def _split(text: str) -> list[str]:
        if "<|" not in text and not BEYOND_LATIN.search(text):  # special tokens are matched before letters are lowered
            text = text.lower()
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


@lru_cache(1)
def _encoder(tokenizer_path: str) -> WordEncoder:
    """One for all tasks that a Python worker runs, words seen so far included."""
    return WordEncoder(tokenizer_path)


def binary_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the binary digits of the rest, descending."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, max_len: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, batch_id, sequence_id, offset.

    Every piece is a sequence of its own (offset 0). ``max_len`` must be a power of two. A map over the scan: nothing
    is shuffled, and ids come from the task's number and row, so that a lost executor's pieces are made again alike.
    """
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer_path), TaskContext.get().partitionId()
        end, filled = np.array([end_id], "<u4").tobytes(), Counter()
        for part in slices(batches):
            rows, starts, sizes, raw, totals, groups = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                ids += end
                at, n = 0, len(ids) // 4
                for size in binary_lengths(n, max_len):
                    rows.append(i)
                    starts.append(at)
                    sizes.append(size)
                    raw.append(ids[4 * at:4 * (at + size)])
                    totals.append(n)
                    groups.append((task << 40) + (size.bit_length() << 34) + filled[size] // (max_len // size))
                    filled[size] += 1
                    at += size
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                 lists(raw, pa.int32(), 4), pa.array([zlib.crc32(b) for b in raw], pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(groups, pa.int64())],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "batch_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, batch_id long")
    return made.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
