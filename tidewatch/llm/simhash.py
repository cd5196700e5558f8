"""Operator 8: SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Fingerprints that
differ in at most ``max_bits`` bits are at most ``max_bits // segments`` apart in one of their segments.
Each fingerprint therefore probes, per segment, the small Hamming ball around its value in a table keyed by
segment and value; what is found is verified on all bits. Two fingerprints meet once: in the first segment
that brings them together, and from one side only.

Equal fingerprints are one entry of the table, however many documents share them. Probes and table are
dealt by segment and value, joined without any group being gathered and without a broadcast; links go into connected
components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.components import components
from tidewatch.llm.encoding import blocks
from tidewatch.llm.storage import materialize

SEED = 42
LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[str], shingle: int) -> np.ndarray:
    """Fingerprints as signed 64-bit numbers; 0 without words."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        k = min(shingle, len(words))
        starts = np.concatenate([[0], ends[:len(words) - k] + 1]).tolist()
        hashes += [digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())]
        count[i] = len(starts)
    result = np.zeros(len(texts), np.uint64)
    if not hashes:
        return result.view(np.int64)
    values = np.array(hashes, np.uint64)
    has = np.flatnonzero(count)
    size = count[has]
    first = np.cumsum(size) - size
    # eight one-byte counters to a word: sums of up to 255 hashes, then sums of those per text
    parts = -(-size // 255)
    inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    part_starts = np.repeat(first, parts) + 255 * inside
    text_starts = np.cumsum(parts) - parts
    for k in range(8):
        lanes = np.add.reduceat((values >> np.uint64(k)) & LANES, part_starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text_starts, axis=0)
        for j in range(8):
            result[has] |= (2 * sums[:, j] > size).astype(np.uint64) << np.uint64(8 * j + k)
    return result.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fingerprint`` (signed long) of every row; a null text is the empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(texts, shingle) for texts in blocks(batch.column(1).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(found))], ["id", "fingerprint"])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, fingerprint long")


def with_fingerprints(docs: DataFrame, shingle: int, text_column: str = "text") -> DataFrame:
    """``doc`` (all columns of a row) and its ``fingerprint``."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(texts, shingle) for texts in blocks(batch.column(1).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc", "fingerprint"])

    return whole.mapInArrow(run, StructType([whole.schema["doc"], StructField("fingerprint", LongType())]))


def links(prints: DataFrame, max_bits: int, segments: int = 2) -> DataFrame:
    """Each pair ``a, b`` of distinct values of ``prints.fingerprint`` within ``max_bits`` bits, once."""
    width, radius = -(-64 // segments), max_bits // segments
    bounds = [(at, min(width, 64 - at)) for at in range(0, 64, width)]

    def value(fingerprint: str, at: int, bits: int) -> Column:
        return F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))

    def balls(at: int, bits: int) -> Column:
        masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)]
        own = value("fingerprint", at, bits)
        around = F.array(*[F.lit(m).cast("long") for m in masks])
        if radius == 1:  # of two values one bit apart, the one that has the bit finds the other
            around = F.filter(around, lambda m: own.bitwiseAND(m) == m)
        return F.transform(around, lambda m: F.struct(own.bitwiseXOR(m).alias("value"), (m == 0).alias("same")))

    known = prints.select("fingerprint")
    tables, probes = [], []
    for k, (at, bits) in enumerate(bounds):
        tables.append(known.select(F.lit(k).alias("segment"), value("fingerprint", at, bits).alias("value"),
                                   F.col("fingerprint").alias("b")))
        probes.append(known.select(F.lit(k).alias("segment"), F.col("fingerprint").alias("a"),
                                   F.explode(balls(at, bits)).alias("probe"))
                      .select("segment", "a", "probe.value", "probe.same"))
    probe, entry = probes[0], tables[0]
    for p, t in zip(probes[1:], tables[1:]):
        probe, entry = probe.unionAll(p), entry.unionAll(t)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    once = (F.col("a") < F.col("b")) if radius != 1 else (~F.col("same") | (F.col("a") < F.col("b")))
    for k, (at, bits) in enumerate(bounds[:-1]):
        apart = F.bit_count(F.shiftrightunsigned(differ, at).bitwiseAND(F.lit((1 << bits) - 1)))
        once &= (F.col("p.segment") <= k) | (apart > radius)
    # Spark takes the exploded probes to be as small as the prints they are made of, and would broadcast them
    probe, entry = probe.alias("p"), entry.alias("t").hint("merge")
    met = (F.col("p.segment") == F.col("t.segment")) & (F.col("p.value") == F.col("t.value"))
    return probe.join(entry, met & (F.bit_count(differ) <= max_bits) & once).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int, segments: int = 2,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links of
    at most ``max_bits`` differing bits, itself included).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part; they
    never name a component, and one of null ids alone has a null component. Repeated rows are kept. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    prints = materialize(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "prints")
    group = components(links(prints, max_bits, segments))
    named = prints.join(group.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    named = materialize(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "component").select("fingerprint", "component_id")
    return rows.join(of, "fingerprint").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int, max_bits: int, segments: int = 2,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of every group that links of at most ``max_bits`` differing bits connect, with all its columns.

    The row with the smallest id stays, rows without an id only where no other has one; ties go by a hash of the
    text, then by where rows stand, so of rows that are equal exactly one stays. An empty table gives an empty result.
    """
    rows = with_fingerprints(docs, shingle, text_column).withColumn("row", F.monotonically_increasing_id())
    # written before it is read twice: the row number has to stay what it is
    rows = materialize(rows, "fingerprints")
    prints = rows.select("fingerprint").distinct()
    group = components(links(materialize(prints, "prints"), max_bits, segments))
    group = group.select(F.col("node").alias("fingerprint"), "component")
    value = F.col(f"doc.`{id_column}`")
    order = F.struct(value.isNull().alias("last"), value.alias("id"), F.xxhash64(F.col(f"doc.`{text_column}`")).alias("text"), "row")
    first = rows.select("fingerprint", order.alias("order")).groupBy("fingerprint").agg(F.min("order").alias("order"))
    first = first.join(group, "fingerprint", "left").groupBy(F.coalesce("component", "fingerprint").alias("component")).agg(
        F.min("order").alias("order"))
    kept = materialize(first.select("order.row"), "kept")
    return rows.join(kept, "row", "left_semi").select("doc.*")
