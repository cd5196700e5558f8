"""Operator 6: stupid-backoff scores of documents against the whole corpus.

The tokens are the pieces of the lower-cased text (words, single digits, runs of signs). Documents are gathered
into blocks, one row each. A block's distinct n-grams, hashed to 64 bits and counted, are cut by hash into
buckets; the buckets of all blocks are the n-gram count tables, partitioned by hash. A bucket adds up the counts
of its n-grams and joins the totals to the n-grams every block sent, so each block gets back exactly the totals
of its own n-grams. There they are laid over the exploded n-grams of the block's documents and the logarithms
are summed per document. A document's own occurrences are taken off all counts, so that scores tell how well
the rest of the corpus predicts it and an n-gram of its own alone backs off.

A frequent n-gram is one entry per block, so no bucket is hot; blocks and buckets have fixed sizes, their
numbers grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tidewatch.llm.encoding import blocks, lowered
from tidewatch.llm.pieces import split
from tidewatch.llm.storage import materialize
from tidewatch.llm.token_store import code, decode

ORDER = 2
ALPHA = 0.4
BLOCK_CHARS = 8_000_000
BUCKET_CHARS = 20_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 in one to four bytes each; beyond, in eight."""
    if values.max(initial=0) >= 1 << 32:
        return b"w" + values.astype("<i8").tobytes()
    control, data = code(values)
    return b"n" + np.array([len(values)], "<u4").tobytes() + control + data


def unpacked(stored: bytes) -> np.ndarray:
    if stored[:1] == b"w":
        return np.frombuffer(stored[1:], "<i8").astype(np.int64)
    count = int(np.frombuffer(stored[1:5], "<u4")[0])
    at = 5 + -(-count // 4)
    return decode(stored[5:at], stored[at:], count).astype(np.int64)


def gathered(docs: DataFrame, block_chars: int, id_column: str, text_column: str) -> DataFrame:
    """Blocks of documents: ``block, n_chars, ids, texts`` (compressed, with their lengths in ``sizes``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, number, shard = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            packed = zstandard.compress("".join(texts).encode())
            return pa.RecordBatch.from_pylist(
                [{"block": (shard << 32) + number, "n_chars": held, "ids": ids, "sizes": sizes, "texts": packed}], schema=arrow)

        for batch in batches:
            for shard, i, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= block_chars:
                    yield row()
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield row()

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"block long, n_chars long, ids array<{kind}>, sizes array<long>, texts binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    slim = docs.select(F.spark_partition_id().alias("shard"), F.col(id_column), F.coalesce(F.col(text_column), F.lit("")))
    return slim.mapInArrow(run, schema)


def texts_of(sizes: list[int], packed: bytes) -> list[str]:
    text, ends = zstandard.decompress(packed).decode(), np.cumsum([0, *sizes]).tolist()
    return [text[a:b] for a, b in zip(ends, ends[1:])]


class BlockGrams:
    """N-grams of a block: per order, the place of every token's n-gram among the sorted distinct ones."""

    def __init__(self, texts: list[str], order: int):
        parts = [split(run, False) for run in blocks(map(lowered, texts))]
        self.sizes = np.concatenate([p.counts for p in parts])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        self.inside = np.arange(len(self.doc)) - first[self.doc]
        self.hashes, self.place, self.counts = [], [], []
        words = gram = np.concatenate([p.hashes for p in parts])
        for k in range(order):
            if k:
                with np.errstate(over="ignore"):
                    gram = (np.concatenate([gram[:1], gram[:-1]]) ^ MIX) * MIX + words
                    gram ^= gram >> np.uint64(31)
            has = self.inside >= k
            distinct, place, counts = np.unique(gram[has], return_inverse=True, return_counts=True)
            full = np.full(len(has), -1)
            full[has] = place
            self.hashes.append(distinct)
            self.place.append(full)
            self.counts.append(counts)

    def own(self, k: int) -> np.ndarray:
        """How often each token's (k+1)-gram stands in the token's own document."""
        has = self.inside >= k
        pair = self.doc[has] * max(1, len(self.hashes[k])) + self.place[k][has]
        _, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
        own = np.zeros(len(has), np.int64)
        own[has] = counts[back]
        return own

    def scores(self, totals: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Per document: the sum of log scores but for the corpus size, and the number of tokens that it divides.

        ``totals``: corpus counts of the distinct n-grams.
        """
        log_alpha, single = np.log(alpha), np.ones(len(self.doc), bool)
        score = np.full(len(self.doc), log_alpha)
        below = np.ones(len(self.doc))
        for k, total in enumerate(totals):
            has = self.inside >= k
            count = np.where(has, total[self.place[k]] - self.own(k), 0) if len(total) else np.zeros(len(has))
            seen = has & (count > 0)
            context = np.concatenate([below[:1], below[:-1]]) if k else below
            backed = score + np.where(has & (k > 0), log_alpha, 0.0)
            score = np.where(seen, np.log(np.maximum(count, 1) / np.maximum(context, 1)), backed)
            single &= ~seen | (k == 0)
            below = count.astype(np.float64)
        n = len(self.sizes)
        return np.bincount(self.doc, weights=score, minlength=n), np.bincount(self.doc[single], minlength=n)


def log_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_column: str = "doc_id",
               text_column: str = "text", block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Per row: id, ``n_tokens``, ``log_score`` (sum of natural logs of the tokens' scores).

    A token's score is count(n-gram) / count(n-gram without its last token) for the longest n-gram, up to
    ``order``, that other documents hold, times ``alpha`` for every order given up; a token no other document
    holds counts as ``alpha`` times one occurrence. Counts cover all other rows. A null or empty text has no
    tokens and scores 0; a null id stays null; repeated rows are each other's corpus. An empty table gives
    an empty result. Other columns are not read.
    """
    stored = materialize(gathered(docs, block_chars, id_column, text_column), "blocks")
    buckets = max(8, -(-(stored.agg(F.sum("n_chars")).first()[0] or 0) // bucket_chars))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, texts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                grams = BlockGrams(texts_of(sizes, texts), order)
                for k in range(order):
                    hashes, counts = grams.hashes[k], grams.counts[k]
                    bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                    ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                    some = np.flatnonzero(np.diff(ends))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some * order + k, pa.int64()),
                            pa.array(np.full(len(some), block), pa.int64()),
                            pa.array([hashes[ends[b]:ends[b + 1]].tobytes() for b in some], pa.binary()),
                            pa.array([packed(counts[ends[b]:ends[b + 1]]) for b in some], pa.binary()),
                        ],
                        ["part", "block", "hashes", "counts"],
                    )

    def reply(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()])
        distinct, back = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)[back]
        ends = np.cumsum([len(h) for h in hashes])
        return pa.table({
            "block": table.column("block"), "part": table.column("part"),
            "totals": pa.array([packed(t) for t in np.split(total, ends[:-1])], pa.binary())})

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("id", id_type), ("n_tokens", pa.int64()), ("part", pa.float64()),
                                                             ("single", pa.int64()))})
        texts = texts_of(left.column("sizes")[0].as_py(), left.column("texts")[0].as_py())
        grams, ids = BlockGrams(texts, order), left.column("ids")[0].values
        by_part = sorted(zip(right.column("part").to_pylist(), right.column("totals").to_pylist()))
        totals = [np.concatenate([*[unpacked(t) for p, t in by_part if p % order == k], np.empty(0, np.int64)])
                  for k in range(order)]
        part, single = grams.scores(totals, alpha)
        return pa.table({"id": ids, "n_tokens": pa.array(grams.sizes, pa.int64()), "part": pa.array(part, pa.float64()),
                         "single": pa.array(single, pa.int64())})

    sent = stored.select("block", "sizes", "texts").mapInArrow(send, "part long, block long, hashes binary, counts binary")
    totals = sent.groupBy("part").applyInArrow(reply, "block long, part long, totals binary")
    kind = docs.schema[id_column].dataType
    id_type = to_arrow_type(kind)
    summed = stored.select("block", "ids", "sizes", "texts").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        sum_up, f"id {kind.simpleString()}, n_tokens long, part double, single long")
    summed = materialize(summed, "scores")
    n_tokens = summed.agg(F.sum("n_tokens")).first()[0] or 0
    rest = F.greatest(F.lit(n_tokens) - F.col("n_tokens"), F.lit(1))
    return summed.select(F.col("id").alias(id_column), "n_tokens", (F.col("part") - F.col("single") * F.log(rest)).alias("log_score"))
