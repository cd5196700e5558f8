"""Batched token ids: every distinct piece is encoded once per worker and looked up afterwards."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from tidewatch.llm.pieces import Pieces, equal, gather, split

#: Characters of text handled as one array.
BLOCK_CHARS = 2_000_000
#: Pieces a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 1_500_000

#: Ids of all given pieces as one array, and the number of ids of each.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class PieceIds:
    """Ids and code points of known pieces, as flat arrays sorted by piece hash."""

    def __init__(self, encode: Encode, limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)
        self.text_first = np.empty(0, np.int64)
        self.text_size = np.empty(0, np.int64)
        self.text = np.empty(0, np.uint32)

    def rows(self, hashes: np.ndarray, pieces: Pieces, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the tables of the sorted distinct ``hashes``, and whether what stands there is the piece
        ``sample`` has for it, and no other one of the same hash."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        if not known.all():
            if len(self.hashes) > self.limit:
                self.clear()
                known[:] = False
            missing = np.flatnonzero(~known)
            new = sample[missing]
            flat, size = self.encode(pieces.texts(new))
            where = np.searchsorted(self.hashes, hashes[missing])
            self.first = np.insert(self.first, where, len(self.flat) + np.cumsum(size) - size)
            self.size = np.insert(self.size, where, size)
            self.flat = np.concatenate([self.flat, flat])
            length = pieces.lengths[new]
            self.text_first = np.insert(self.text_first, where, len(self.text) + np.cumsum(length) - length)
            self.text_size = np.insert(self.text_size, where, length)
            self.text = np.concatenate([self.text, gather(pieces.points, pieces.starts[new], length)])
            self.hashes = np.insert(self.hashes, where, hashes[missing])
            at = np.searchsorted(self.hashes, hashes)
        return at, equal(self.text, self.text_first[at], self.text_size[at],
                         pieces.points, pieces.starts[sample], pieces.lengths[sample])


class TextEncoder:
    """Ids of whole texts, equal to the tokenizer's own ``encode(..., add_special_tokens=False)``.

    ``odd``: characters that ``normalise`` may treat otherwise than the tokenizer does; a text that holds one goes to
    ``whole``, the tokenizer itself.
    """

    def __init__(self, spaced: bool, encode: Encode, special: dict[str, int], normalise=None,
                 odd: re.Pattern | None = None, whole: Encode | None = None):
        self.spaced, self.normalise, self.special = spaced, normalise, special
        self.odd, self.whole = odd, whole
        self.known = PieceIds(encode)
        self.cut = re.compile("|".join(map(re.escape, special)))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.normalise:
            texts = [self.normalise(t) for t in texts]
        pieces = split(texts, self.spaced)
        if not len(pieces.hashes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        hashes, sample, inverse = np.unique(pieces.hashes, return_index=True, return_inverse=True)
        row, right = self.known.rows(hashes, pieces, sample)
        first, size, flat = self.known.first[row][inverse], self.known.size[row][inverse], self.known.flat
        other = np.flatnonzero(~(right[inverse] & pieces.same(np.arange(len(inverse)), sample[inverse])))
        if len(other):
            # pieces that share a hash with another piece are encoded each for itself
            more, count = self.known.encode(pieces.texts(other))
            first[other], size[other] = len(flat) + np.cumsum(count) - count, count
            flat = np.concatenate([flat, more])
        ids = gather(flat, first, size)
        upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(pieces.counts)])]
        return ids, np.diff(upto)

    def _mixed(self, texts: list[str], odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts of which those at ``odd`` go to the tokenizer itself."""
        chosen = np.zeros(len(texts), bool)
        chosen[odd] = True
        size = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        for which, encode in ((~chosen, self), (chosen, self.whole)):
            at = np.flatnonzero(which)
            if len(at):
                ids, size[at] = encode([texts[i] for i in at])
                for i, part in zip(at, np.split(ids, np.cumsum(size[at])[:-1])):
                    parts[i] = part
        return np.concatenate(parts), size

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and the number of ids of each text. Texts naming a special token
        are cut there, as the tokenizer does."""
        if self.odd is not None:
            odd = [i for i, t in enumerate(texts) if not t.isascii() and self.odd.search(t)]
            if odd:
                return self._mixed(texts, odd)
        parts, whose, marks = [], [], []
        for i, text in enumerate(texts):
            if "<|" in text and self.cut.search(text):
                at = 0
                for m in self.cut.finditer(text):
                    parts.append(text[at:m.start()])
                    whose.append(i)
                    marks.append((len(parts), self.special[m.group()]))
                    at = m.end()
                text = text[at:]
            parts.append(text)
            whose.append(i)
        ids, size = self._plain(parts)
        if not marks:
            return ids, size
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = np.insert(ids, [upto[k] for k, _ in marks], [v for _, v in marks])
        total = np.bincount(whose, weights=size, minlength=len(texts)).astype(np.int64)
        return ids, total + np.bincount([whose[k - 1] for k, _ in marks], minlength=len(texts))


def lowered(text: str) -> str:
    """Composed and in lower case, every character for itself."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def odd_letters(normalise: Callable[[str], str]) -> re.Pattern | None:
    """Characters that ``normalise`` and ``lowered`` treat differently between letters: those of which one of them
    knows a later edition of Unicode."""
    # cased letters lie in the first two planes
    points = [c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    points.remove(ord("\u2502"))  # it stands between the others, and has no case
    lines = "\u2502".join(f"a{chr(c)}a" for c in points)
    pairs = zip(points, normalise(lines).split("\u2502"), lowered(lines).split("\u2502"), strict=True)
    # white space of any kind is told apart by its class
    odd = [chr(c) for c, a, b in pairs if a != b and a != "a a"]
    return re.compile(f"[{re.escape(''.join(odd))}]") if odd else None


@functools.cache
def library_encoder(path: str) -> TextEncoder:
    """An encoder whose pieces are encoded by the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    spaced = isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)

    def each(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((x for ids in lists for x in ids), np.int32, int(size.sum())), size

    vocab = tokenizer.get_vocab()
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
    line = tokenizer.encode("\n", add_special_tokens=False).ids

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # one long text costs the library less than many short ones: pieces one to a line, told apart
        # by the id of the line end or by the ids that end a word
        if any(w.isspace() for w in words):
            return each(words)
        ids = np.array(tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, np.int32)
        if spaced:
            ends = np.append(np.flatnonzero(ids == line[0]), len(ids))
            size = np.diff(ends, prepend=-1) - 1
            ids = ids[ids != line[0]]
        else:
            size = np.diff(np.flatnonzero(last[ids]), prepend=-1)
        return (ids, size) if len(size) == len(words) and size.sum() == len(ids) else each(words)

    if spaced:
        return TextEncoder(spaced, encode, special)
    return TextEncoder(spaced, encode, special, lowered, odd_letters(tokenizer.normalizer.normalize_str), each)


def blocks(texts: Iterable[str | None], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; null is the empty text."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run
