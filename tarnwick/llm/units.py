"""Cutting texts into pre-tokens, with a cache of what an encoder made of them.

The pre-tokens of the byte-level pattern are independent of one another, so the ids
of a text are the ids of its pre-tokens in order. Pre-tokens repeat far more than
texts do, and only those that a worker has not met yet reach the encoder.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from itertools import filterfalse

import numpy as np
import regex

#: Pre-tokens a worker remembers before it starts afresh; bounds its memory, never its results.
MOST_PIECES = 500_000
#: Longer pre-tokens are encoded whenever met and not remembered.
LONGEST_KEPT = 200

#: Fixed value: the pattern of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same over UTF-8 bytes, for texts whose characters beyond ASCII are all letters.
_LETTERS_ONLY = re.compile(rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+|'(?:[stmd]|ll|ve|re)| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+")
_ASCII = bytes(range(128))
#: Kinds of bytes in such texts: letters, digits, blanks, all others.
_LETTER, _DIGIT, _BLANK, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[128:] = _KINDS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = _LETTER
_KINDS[[*b"0123456789"]] = _DIGIT
_KINDS[[*b" \t\n\r\f\v"]] = _BLANK

Encode = Callable[[list[bytes]], list[bytes]]


def plain(text: bytes) -> bool:
    """True if every character beyond ASCII is a letter."""
    return text.isascii() or text.translate(None, _ASCII).decode().isalpha()


def cutter(pattern: str) -> Callable[[bytes], list[bytes]]:
    """The matches of a pattern in a text, as bytes."""
    general = regex.compile(pattern)

    def cut(text: bytes) -> list[bytes]:
        return [m.encode() for m in general.findall(text.decode())]

    if pattern != BYTE_LEVEL:
        return cut
    return lambda text: _LETTERS_ONLY.findall(text) if plain(text) else cut(text)


def plain_edges(data: bytes, begins: np.ndarray) -> np.ndarray:
    """Where the byte-level pattern cuts plain texts that stand behind one another, with 0 and the end.

    begins: where each text begins. Equal to the matches of ``_LETTERS_ONLY`` in each
    text, found for all bytes at once.
    """
    if not data:
        return np.zeros(1, np.int64)
    letter = np.frombuffer(data, np.uint8)
    kind = _KINDS[letter]
    first = np.zeros(len(letter) + 1, bool)
    first[begins] = first[0] = first[-1] = True
    edge = first.copy()
    edge[1:-1] |= kind[1:] != kind[:-1]
    # The last blank before a run is a piece, and begins that run's piece if it is a space.
    ends = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~first[1:-1])
    edge[ends] = True
    edge[ends + 1] = letter[ends] != 32
    # 's and the like, where a piece begins with the apostrophe
    quote = np.flatnonzero(edge[:-1] & (letter == 39))
    one, two = (letter[np.minimum(quote + k, len(letter) - 1)] * ~first[np.minimum(quote + k, len(letter))] for k in (1, 2))
    two *= one > 0
    short = np.isin(one, [*b"stmd"])
    long = (one == 108) & (two == 108) | ((one == 114) | (one == 118)) & (two == 101)
    edge[quote[short | long] + 1] = False
    edge[quote[short] + 2] = edge[quote[long] + 3] = True
    return np.flatnonzero(edge)


class PieceCache:
    """Encodes texts through an encoder of distinct pre-tokens; ids are packed bytes."""

    def __init__(self, cut: Callable[[bytes], list[bytes]], encode: Encode) -> None:
        self.cut, self.encode, self.kept = cut, encode, {}

    def _learn(self, met: Collection[bytes]) -> list[bytes]:
        """Have the ids of all that were met; those that were new."""
        if len(self.kept) + len(met) > MOST_PIECES:
            self.kept = {p: self.kept[p] for p in met if p in self.kept}
        new = list(filterfalse(self.kept.__contains__, met))
        self.kept.update(zip(new, self.encode(new), strict=True))
        return new

    def _forget(self, new: list[bytes]) -> None:
        for p in new:
            if len(p) > LONGEST_KEPT:
                del self.kept[p]

    def each(self, met: list[bytes]) -> list[bytes]:
        """Packed ids of each of these distinct pre-tokens."""
        new = self._learn(met)
        out = list(map(self.kept.__getitem__, met))
        self._forget(new)
        return out

    def texts(self, batch: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.cut(t) for t in batch]
        new = self._learn(set().union(*split))
        find = self.kept.__getitem__
        out = [b"".join(map(find, pieces)) for pieces in split]
        self._forget(new)
        return out
