"""Splitting texts into tokenizer pieces with array operations.

Both tokenizers cut a text into pieces (a word with its leading space, a run of digits, ...) and then
encode every piece on its own. A batch of texts is handled as one array of code points: classes come
from a table, piece starts from comparisons with neighbours, and a 64-bit hash per piece from one
segmented sum, so that each distinct piece has to be looked at only once per batch. A hash finds candidates; pieces
are the same only if their code points are, which ``Pieces.same`` compares.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

LETTER, NUMBER, SPACE, OTHER, EDGE = 0, 1, 2, 3, 4
#: Stands between texts; not a code point.
SEPARATOR = 0x110000
#: Endings that follow an apostrophe as one piece.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LONGEST = 1 << 16


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library sees it, and of the separator."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(SEPARATOR + 1, OTHER, np.uint8)
    text = "".join(chr(c) for c in range(SEPARATOR) if not 0xD800 <= c < 0xE000)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for _, (start, end) in runs.pre_tokenize_str(text):
            table[points[start:end]] = kind
    table[SEPARATOR] = EDGE
    return table


@functools.cache
def factors() -> np.ndarray:
    """A fixed random odd number for every place in a piece. Powers of one number would let texts made of two letters
    in a regular order collide."""
    drawn = np.random.default_rng(0x7157).integers(0, 1 << 63, LONGEST, np.uint64)
    return (drawn << np.uint64(1)) | np.uint64(1)


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The segments ``flat[first[i]:first[i] + size[i]]`` one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - ends + size, size)]


def equal(a: np.ndarray, first_a: np.ndarray, size_a: np.ndarray,
          b: np.ndarray, first_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether segment i of ``a`` equals segment i of ``b``; segments are not empty."""
    found = size_a == size_b
    # a segment beside itself needs no look
    at = np.flatnonzero(found & ((first_a != first_b) | (a is not b)))
    if len(at):
        size = size_a[at]
        alike = gather(a, first_a[at], size) == gather(b, first_b[at], size)
        found[at] = np.logical_and.reduceat(alike, np.cumsum(size) - size)
    return found


@dataclass
class Pieces:
    """Pieces of a batch of texts: ``points[starts[i]:starts[i] + lengths[i]]``, in text order."""

    points: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    #: number of pieces of each text
    counts: np.ndarray

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``a[i]`` has the code points of piece ``b[i]``."""
        return equal(self.points, self.starts[a], self.lengths[a], self.points, self.starts[b], self.lengths[b])

    def texts(self, which: np.ndarray) -> list[str]:
        ends = np.cumsum(self.lengths[which])
        text = gather(self.points, self.starts[which], self.lengths[which]).tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _endings(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many letters after the apostrophes ``at`` belong to an ending; 0 if none."""
    size = np.zeros(len(at), np.int64)
    first, second = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
    for ending in reversed(ENDINGS):
        hit = first == ord(ending[0])
        if len(ending) == 2:
            hit &= second == ord(ending[1])
        size[hit] = len(ending)
    return size


def split(texts: Sequence[str], spaced: bool) -> Pieces:
    """Pieces of every text.

    ``spaced``: a single blank before a run belongs to it and other white space makes pieces too;
    otherwise white space is dropped and every digit is a piece of its own.
    """
    joined = ("\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends] = SEPARATOR
    kind = classes()[points]
    change = np.empty(len(points), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[ends] = True
    change[ends[:-1] + 1] = True
    if spaced:
        # the last white-space character before other text stands alone or, a blank, joins that text
        ahead = np.flatnonzero(change[1:] & (kind[:-1] == SPACE) & (kind[1:] < EDGE) & (kind[1:] != SPACE))
        change[ahead] = True
        change[ahead[points[ahead] == 32] + 1] = False
    else:
        change |= kind == NUMBER
    quotes = np.flatnonzero((points[:-1] == 39) & change[:-1] & (kind[1:] == LETTER))
    size = _endings(points, quotes)
    quotes, size = quotes[size > 0], size[size > 0]
    change[quotes + 1] = False
    rest = quotes + 1 + size
    change[rest[kind[rest] == LETTER]] = True
    starts = np.flatnonzero(change)
    lengths = np.diff(starts, append=len(points))
    with np.errstate(over="ignore"):
        inside = np.arange(len(points)) - np.repeat(starts, lengths)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed *= factors()[inside & (LONGEST - 1)] + (inside >> 16).astype(np.uint64) * np.uint64(2)
        hashes = np.add.reduceat(mixed, starts)
    first = kind[starts]
    keep = first != EDGE
    if not spaced:
        keep &= first != SPACE
    before = np.cumsum(keep)
    counts = np.diff(before[np.searchsorted(starts, ends)], prepend=0)
    return Pieces(points, starts[keep], lengths[keep], hashes[keep], counts)
