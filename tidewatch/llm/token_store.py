"""Operator 2: token ids in files, ranked by frequency and coded in whole bytes.

Documents are sorted by id over all partitions, encoded by the tokenizers library and cut into blocks of
about a million ids. A block ranks its ids by how often they occur in it; the ranked ids are written as
one to four bytes each, whose lengths stand apart as two-bit codes in control bytes. A row of the written
Parquet files is one block: its rank table, its documents, the control bytes and the data bytes. Blocks
are complete in themselves, so one pass over the text is enough and any block can be read alone.

The only shuffle sorts the texts by id; a partition is encoded as a stream, one block in memory. Rows of
one id are spread over partitions by a hash of their text. Reading back turns a control byte into four
lengths by table lookup, and running sums of the lengths into the places of the data bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.encoding import blocks, library_encoder

BLOCK_IDS = 1_000_000
#: lengths of the four values under a control byte
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ``values``."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF).astype(np.int64) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    parts = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), parts[np.arange(4) < size[:, None]].tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values that ``code`` wrote."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size) - size
    values = np.zeros(count, np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        values[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, most frequent first (ties: smaller id), and the rank of every id."""
    count = np.bincount(ids)
    table = np.argsort(-count, kind="stable")[:int((count > 0).sum())]
    rank = np.zeros(len(count), np.int64)
    rank[table] = np.arange(len(table))
    return table, rank[ids]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_column: str = "doc_id",
                 text_column: str = "text", block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of every text, each followed by ``end_id``, in ascending id order to a new folder
    below ``folder``; returns its path.

    A null text is the empty one (only the end id). Null ids come first; repeated ids and rows are all
    kept, ordered by text hash. An empty table writes no blocks. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer)
        names, sizes, parts = [], [], []
        held = written = number = 0
        shard = None

        def block() -> pa.RecordBatch:
            ids, size = np.concatenate(parts), np.concatenate(sizes)
            table, rank = ranked(ids)
            control, data = code(rank)
            row = {"shard": shard, "block": number, "before": written, "n_ids": len(ids),
                   "ids": names[:], "sizes": size.tolist(), "ranked": table.astype("<u4").tobytes(),
                   "control": control, "data": data}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            doc_ids, at = batch.column(1).to_pylist(), 0
            for texts in blocks(batch.column(2).to_pylist()):
                shard = batch.column(0)[0].as_py()
                ids, size = encode(texts)
                ids = np.insert(ids, np.cumsum(size), end_id)
                parts.append(ids)
                sizes.append(size + 1)
                names += doc_ids[at:at + len(texts)]
                at += len(texts)
                held += len(ids)
                if held >= block_ids:
                    yield block()
                    written, number, held = written + held, number + 1, 0
                    names, sizes, parts = [], [], []
        if names:
            yield block()

    kind = docs.schema[id_column].dataType
    schema = (f"shard int, block int, before long, n_ids long, ids array<{kind.simpleString()}>, "
              "sizes array<long>, ranked binary, control binary, data binary")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    path = f"{folder}/tokens-{uuid.uuid4().hex}"
    slim = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    (slim.repartitionByRange(F.col("id"), F.xxhash64("text"))
        .sortWithinPartitions(F.col("id"), F.xxhash64("text"))
        .select(F.spark_partition_id().alias("shard"), "id", "text")
        .mapInArrow(run, schema)
        .write.option("compression", "uncompressed").parquet(path))
    return path


def read_tokens(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Documents of written files: id, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (binary, little-endian unsigned 32-bit).

    Only the sizes of the shards, one per written partition, pass through the driver.
    """
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    first, total = {}, 0
    for r in sizes:
        first[r.shard] = total
        total += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                rank = decode(row["control"].as_py(), row["data"].as_py(), row["n_ids"].as_py())
                ids = np.frombuffer(row["ranked"].as_py(), "<u4")[rank]
                size = row["sizes"].values.to_numpy()
                upto = np.concatenate([[0], np.cumsum(size)])
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        row["ids"].values,
                        pa.array(upto[:-1] + first[row["shard"].as_py()] + row["before"].as_py()),
                        pa.array(size, pa.int64()),
                        pa.array([raw[a:b] for a, b in zip(upto * 4, upto[1:] * 4)], pa.binary()),
                    ],
                    ["id", "start", "n_tokens", "ids"],
                )

    kind = stored.schema["ids"].dataType.elementType.simpleString()
    out = stored.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_column)
