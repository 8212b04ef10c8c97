"""Texts cut into pieces that tokenizers treat by themselves, and the remembered tokens of each distinct piece.

A text is cut before a space, tab or newline that follows a character that is no white space, and between a letter and
ASCII punctuation. A byte-level pre-tokenizer always cuts there as well, and a vocabulary of word pieces does if no entry
spans such a place (``spans_cuts`` tells). A whole batch of texts is cut at once, its distinct pieces are found by Arrow's
dictionary encoding, and only those that a worker has not met are tokenized.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

#: Distinct pieces, and ids in them, that a worker remembers; beyond either it starts anew.
CACHED_PIECES, CACHED_IDS = 400_000, 4_000_000
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x09, 0x0A]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POINT = np.zeros(256, bool)
_POINT[list(b",.;:!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SPANS = re.compile(r"[^\s▁][ \t\n▁]|[A-Za-zÀ-ÖØ-öø-ÿ][,.;:!?]")


def spans_cuts(vocabulary: Iterable[str]) -> bool:
    """Whether an entry (white space as itself or as U+2581) reaches over a place where texts are cut."""
    return any(_SPANS.search(entry) for entry in vocabulary)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of each text, in order. Texts without bytes have none."""
    heads = np.zeros(len(data), bool)
    heads[offsets[:-1][np.diff(offsets) > 0]] = True
    if len(data) < 2:
        return np.flatnonzero(heads)
    before, here = data[:-1], data[1:]
    at = np.flatnonzero((_CUT[here] & ~_WHITE[before]) | (_POINT[here] & (_LETTER[before] | (before >= 0x80)))) + 1
    wide = at[data[at - 1] >= 0x80]  # after a character of several bytes: not after Unicode white space; points after Latin letters only
    one, two = data[wide - 1], data[np.maximum(wide - 2, 0)]
    three = np.where(wide >= 3, data[np.maximum(wide - 3, 0)], 0)
    latin = (two == 0xC3) & (one != 0x97) & (one != 0xB7)
    white = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    white |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    white |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    white |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    white |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    good = np.where(_POINT[data[wide]], latin, ~white)
    heads[at[data[at - 1] < 0x80]] = True
    heads[wide[good]] = True
    return np.flatnonzero(heads)


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices first[0], first[0] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Book:
    """Tokens of the distinct pieces met so far. ``learn`` gives, for new pieces, one id array per piece and tokenizer and whether they are valid;
    ``scale`` multiplies what is remembered."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[list[list], list[bool]]], tokenizers: int = 1, scale: int = 1):
        self.learn, self.n, self.scale = learn, tokenizers, scale
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids = [np.zeros(0, np.int32)] * self.n
        self.ends = [np.zeros(1, np.int64)] * self.n
        self.valid = np.zeros(0, bool)

    def codes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The place in this book of each piece; ``starts`` are the pieces' first bytes, the first one 0."""
        if len(self.places) > CACHED_PIECES * self.scale or max(len(x) for x in self.ids) > CACHED_IDS * self.scale:
            self.clear()
        offsets = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.places]
        if new:
            learned, valid = self.learn(new)
            for k, lists in enumerate(learned):
                counts = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
                self.ids[k] = np.concatenate([self.ids[k], flat])
                self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(counts)])
            self.valid = np.concatenate([self.valid, np.array(valid, bool)])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        return np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def tokens(self, codes: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the number of ids of each piece."""
        first = self.ends[k][codes]
        counts = self.ends[k][codes + 1] - first
        return self.ids[k][ragged(first, counts)], counts
