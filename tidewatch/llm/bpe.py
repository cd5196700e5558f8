"""Operator 3: byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct pieces lie in one flat array. Each round finds the lowest-ranked adjacent
pair of every piece (ranks by binary search over the sorted pair keys), merges it wherever it stands in
that piece, from left to right, and looks up ranks only for the pairs that changed. Pieces without a
mergeable pair leave the array. Decoding concatenates the tokens' bytes from one flat table.

Rows stay where they are: the operator is a narrow pass over the input's partitions, so a lost executor
costs its own partitions only, and a hot source or group of copies moves nothing. A worker remembers the
ids of pieces it has met, up to a fixed number; texts are handled whole, a few million characters at a time.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.encoding import TextEncoder, blocks
from tidewatch.llm.pieces import gather

NONE = np.iinfo(np.int32).max


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary, by the published rule:
    printable bytes stand for themselves, the others take code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """Merge table of a byte-level BPE vocabulary."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.made = made
        letters = byte_letters()
        self.bytes_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.bytes_ids[byte] = vocab[letter]
        #: merging every occurrence at once needs each pair to rank after the merges that made its parts
        last = np.full(self.size, -1, np.int64)
        np.maximum.at(last, made, np.arange(len(pairs)))
        self.ordered = bool((np.maximum(last[left], last[right]) < np.arange(len(pairs))).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words as one array, and the number of ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out_size = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        symbol = self.bytes_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(symbol), NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(start, append=len(symbol))
            least = np.minimum.reduceat(rank, start)
            if (least == NONE).any():
                over = np.repeat(least == NONE, length)
                done.append((word[over], symbol[over]))
                symbol, word, rank = symbol[~over], word[~over], rank[~over]
                going = least != NONE
                length, least = length[going], least[going]
                start = np.cumsum(length) - length
                if not len(symbol):
                    break
            hit = rank == np.repeat(least, length)
            at = np.flatnonzero(hit)
            if self.ordered:
                # of occurrences that overlap (a run of one symbol) every other one, from the left
                head = np.concatenate([[True], np.diff(at) != 1])
                first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            else:
                at = at[np.concatenate([[True], np.diff(word[at]) != 0])]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            shift = np.cumsum(~keep)
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            new = at - shift[at]
            changed = np.zeros(len(symbol), bool)
            changed[new] = True
            changed[new[new > 0] - 1] = True
            touched = np.flatnonzero(changed)
            rank[touched] = NONE
            touched = touched[touched + 1 < len(symbol)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.rank(symbol[touched], symbol[touched + 1])
        if not done:
            return np.empty(0, np.int32), out_size
        words_done = np.concatenate([w for w, _ in done])
        symbols_done = np.concatenate([s for _, s in done])
        order = np.argsort(words_done, kind="stable")
        return symbols_done[order], np.bincount(words_done, minlength=len(words))


class ByteBpe:
    """Encoder and decoder of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.encoder = TextEncoder(True, self._encode, special)
        letters = byte_letters()
        names = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        names |= {i: t.encode() for t, i in special.items()}
        tokens = [names.get(i, b"") for i in range(max(names) + 1)]
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.encode([w.encode() for w in words])

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """Texts of segments of ``ids``; broken UTF-8 becomes replacement characters."""
        length = self.length[ids]
        raw = gather(self.bytes, self.start[ids], length).tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(size)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    ``path``: a byte-level tokenizer file. Rows keep their number: a null text encodes as the empty one
    (no ids, empty decoded text), a null id stays null, repeated rows are repeated in the result, an
    empty table gives an empty result, other columns are not read. Texts naming a special token get
    that token's id there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1).to_pylist()):
                ids, size = bpe.encoder(texts)
                upto = np.concatenate([[0], np.cumsum(size)]) * 4
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(size, pa.int64()),
                        pa.array([raw[a:b] for a, b in zip(upto, upto[1:])], pa.binary()),
                        pa.array(bpe.decode(ids, size), pa.string()),
                    ],
                    ["id", "n_tokens", "ids", "decoded"],
                )
                at += len(texts)

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = slim.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string")
    return out.withColumnRenamed("id", id_column)
