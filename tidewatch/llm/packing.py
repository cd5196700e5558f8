"""Operator 5: packing documents into sequences by sums of squares.

Every document becomes pieces of at most one sequence; only longer ones are cut, the first piece taking
what does not fill a sequence. Pieces are dealt by hash into groups of some ten thousand documents, a group
is sorted by falling length and packed as a stream: a piece goes into the open sequence for which the sum
over all gaps of the squared number of open sequences with that gap becomes smallest, and a new sequence
is opened only when no open one has room.

The ids move once, to their group; a task holds the gaps of its open sequences, never their contents. The
number of groups grows with the documents, so groups stay of one size and each wastes a sequence or two.
The hash covers id and contents, so copies of a text under many ids, or one hot source, spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.encoding import blocks, library_encoder

GROUP_DOCUMENTS = 16_384


class OpenSequences:
    """Open sequences by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.numbers: dict[int, list[int]] = {}
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """The sequence's number and the offset at which a piece of ``size`` goes.

        Closing a gap of count n changes the sum of squares by 1 - 2n, opening one of count m by 2m + 1;
        a full sequence counts no longer. Ties go to the smallest gap.
        """
        left = np.flatnonzero(self.count[size:self.capacity])
        if len(left):
            change = np.where(left > 0, 2 * self.count[left] + 1, 0) - 2 * self.count[size + left]
            gap = size + int(left[np.argmin(change)])
            number = self.numbers[gap].pop()
            self.count[gap] -= 1
        else:
            gap, number = self.capacity, self.opened
            self.opened += 1
        if gap > size:
            self.numbers.setdefault(gap - size, []).append(number)
            self.count[gap - size] += 1
        return number, self.capacity - gap


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str, text_column: str) -> DataFrame:
    """Pieces of every document: ``id``, ``piece``, ``start``, ``length``, ``ids`` (unsigned 16-bit where
    the vocabulary allows it, else 32-bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer)
        for batch in batches:
            done = 0
            for texts in blocks(batch.column(1).to_pylist()):
                ids, size = encode(texts)
                ids = np.insert(ids, np.cumsum(size), end_id)
                size = size + 1
                number = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                head = size - (number - 1) * capacity
                start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[doc])
                raw = ids.astype(width).tobytes()
                upto = np.concatenate([[0], np.cumsum(length)]) * np.dtype(width).itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + done)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([raw[a:b] for a, b in zip(upto, upto[1:])], pa.binary()),
                    ],
                    ["id", "piece", "start", "length", "ids"],
                )
                done += len(texts)

    width = id_width(tokenizer, end_id)
    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")


def id_width(tokenizer: str, end_id: int) -> str:
    """Bytes per id while they travel."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_column: str = "doc_id",
         text_column: str = "text", group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit),
    ``sequence_id`` and ``offset``.

    A null text is the empty one: one piece holding the end id. Null ids and repeated ids or rows are
    packed like any other. An empty table gives an empty result. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, opened = None, OpenSequences(capacity)
        for batch in batches:
            sequence, offset = [], []
            for g, size in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist()):
                if g != group:
                    group, opened = g, OpenSequences(capacity)
                number, at = opened.place(size)
                sequence.append((g << 40) + number)
                offset.append(at)
            ids = [np.frombuffer(x, width).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("id", "piece", "start", "length")]
                + [pa.array(ids, pa.binary()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    width = id_width(tokenizer, end_id)
    groups = max(1, -(-docs.count() // group_documents))
    kind = docs.schema[id_column].dataType.simpleString()
    dealt = pieces(docs, tokenizer, end_id, capacity, id_column, text_column).withColumn(
        "group", F.pmod(F.xxhash64("id", "piece", "ids"), F.lit(groups)))
    out = (
        # by number, not by its hash: every group is a task of its own
        dealt.repartitionById(groups, F.col("group").cast("int"))
        .sortWithinPartitions("group", F.desc("length"), "id", "piece")
        .mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long")
    )
    return out.withColumnRenamed("id", id_column)
