"""Ids of texts whose words can be encoded one by one."""

from __future__ import annotations

from collections.abc import Callable

#: Longest word kept in memory, and how many are kept before the long, hence rare, ones are let go.
WORD_CHARS, WORDS, SHORT = 48, 1_200_000, 9


class WordIds:
    """Remembers the ids of words, as raw 32-bit integers; what is forgotten is encoded again, with the same result."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.known: dict[str, bytes] = {}

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text's words in a row."""
        known = self.known
        if len(known) > WORDS:
            self.known = known = {w: b for w, b in known.items() if len(w) <= SHORT}
            if len(known) > WORDS // 2:
                self.known = known = {}
        new = list(set().union(*texts).difference(known))
        fresh = dict(zip(new, self.encode(new))) if new else {}
        if any(len(w) > WORD_CHARS for w in new):
            known = {**{w: known[w] for t in texts for w in t if w in known}, **fresh}
            fresh = {w: b for w, b in fresh.items() if len(w) <= WORD_CHARS}
        self.known.update(fresh)
        return [b"".join(map(known.__getitem__, ws)) for ws in texts]
