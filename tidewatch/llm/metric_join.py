"""Operator 1: near-duplicate embeddings by an exact metric range join.

On unit vectors a cosine threshold is a Euclidean radius. A bounded sample of the vectors serves as pivots; a
vector's home cell is its nearest pivot of the same label and length. If a pair lies within the radius, the
triangle inequality puts each partner no further from the other's pivot than its own pivot plus twice the
radius (and, in Euclidean space, no further than the radius behind the plane between the two pivots); a vector
is copied into the cells where that holds. Each home vector then meets all its partners in its own cell, and
cells are joined independently.

Equal vectors are one entry with a count. Cells are cut into blocks of fixed size, home rows against all rows
of the cell, so no task holds more than two blocks however full a cell is. A block pair reports, per home
vector, the number of its partners, and links only as a star per local group, never as pairs.
The pivots (at most ``max_pivots`` vectors) are all that passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.vectors import matrix, usable
from tidewatch.llm.storage import materialize

CELL = 4_096
BLOCK = 2_048
MAX_PIVOTS = 512
#: slack for rounding where copies are placed; whether a pair links is decided without it
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cells_of(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector, and a matrix of the cells it is copied into (home included)."""
    squared = np.maximum(2 - 2 * vectors @ pivots.T, 0)
    distance = np.sqrt(squared)
    home = distance.argmin(1)
    rows = np.arange(len(vectors))
    near = distance <= (distance[rows, home] + 2 * radius)[:, None] + SLACK
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    near &= squared - squared[rows, home][:, None] <= 2 * apart * radius + SLACK
    near[rows, home] = True
    return home, near


def local_groups(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest name each row and each column of the ``linked`` matrix is connected to."""
    top = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], top).min(0))
        new_left = np.minimum(left, np.where(linked, new_right[None, :], top).min(1))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def near_duplicates(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector_column: str = "embedding",
                    label_column: str = "label", max_pivots: int = MAX_PIVOTS, cell: int = CELL,
                    block: int = BLOCK) -> DataFrame:
    """Per row: id, ``n_links`` (other rows linked directly: same label, same length, cosine of at least
    ``threshold`` in double precision), ``component_id`` (smallest id reachable, itself included), ``kept``.

    Rows whose label, id or vector is null, whose vector is zero or holds a null or non-finite component, link
    with nothing and are their own component. Repeated rows link with each other. Ids should be unique; rows
    sharing one count as one node of the components. An empty table gives an empty result; other columns are
    not read. ``threshold`` must be above -1 and at most 1.
    """
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"),
                          F.col(vector_column).alias("vector"))
    good = (F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")
            & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("key", F.when(good, F.xxhash64("label", "vector")))
    same = ["key", "label", "vector"]
    entries = materialize(rows.where("key IS NOT NULL").groupBy(*same).agg(F.min("id").alias("id"),
                                                                           F.count("*").alias("copies")), "entries")
    radius = math.sqrt(2 - 2 * threshold)
    n_pivots = min(max_pivots, -(-entries.count() // cell))
    sample = entries.orderBy("key", "id").limit(n_pivots).select("label", "vector").collect()
    by_cell: dict = {}
    for r in sample:
        by_cell.setdefault((r.label, len(r.vector)), []).append(r.vector)
    pivots = {k: unit(np.array(v, float)) for k, v in by_cell.items()}

    def assign(batches):
        for batch in batches:
            labels, sizes = batch.column("label").to_pylist(), batch.column("vector").value_lengths().to_pylist()
            places: dict = {}
            for i, k in enumerate(zip(labels, sizes)):
                places.setdefault(k, []).append(i)
            at, cell_no, own = [], [], []
            for k, rows_of in places.items():
                if k not in pivots:
                    at += rows_of
                    cell_no += [-1] * len(rows_of)
                    own += [True] * len(rows_of)
                    continue
                found = unit(matrix(batch.column("vector").take(pa.array(rows_of)), k[1]))
                home, near = cells_of(found, pivots[k], radius)
                row, col = np.nonzero(near)
                at += np.array(rows_of)[row].tolist()
                cell_no += col.tolist()
                own += (home[row] == col).tolist()
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(cell_no, pa.int32()), pa.array(own, pa.bool_())],
                [*taken.schema.names, "cell", "own"])

    parts = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    schema = ", ".join(f"{n} {t}" for n, t in parts.items()) + ", cell int, own boolean"
    placed = materialize(entries.mapInArrow(assign, schema).withColumn("dim", F.size("vector")), "placed")
    place = ["label", "dim", "cell"]
    sizes = placed.groupBy(*place).agg(F.count("*").alias("n_all"), F.count_if("own").alias("n_own"))
    sizes = sizes.select(*place, F.ceil(F.col("n_all") / block).cast("int").alias("blocks"),
                         F.ceil(F.col("n_own") / block).cast("int").alias("slices")).where("slices > 0")
    dealt = placed.join(sizes, place).withColumns({
        "slice": F.pmod(F.xxhash64("key", F.lit(1)), "slices").cast("int"),
        "part": F.pmod(F.xxhash64("key", F.lit(2)), "blocks").cast("int")})
    home = dealt.where("own").select(*place, "slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"),
                                     "key", "id", "copies", "vector")
    others = dealt.select(*place, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "part",
                          "key", "id", "copies", "vector")
    others = others.select(*[F.col(c).alias(c) for c in others.columns])
    group = [*place, "slice", "part"]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        names, links, edges = [], [], []
        if left.num_rows and right.num_rows:
            a, b = (unit(matrix(t.column("vector"))) for t in (left, right))
            ids, other = (t.column("id").to_numpy() for t in (left, right))
            keys, other_keys = (t.column("key").to_numpy() for t in (left, right))
            linked = a @ b.T >= threshold
            linked &= (ids[:, None] != other[None, :]) | (keys[:, None] != other_keys[None, :])
            links = linked @ right.column("copies").to_numpy()
            has = np.flatnonzero(links)
            if len(has):
                to_left, to_right = local_groups(linked[has], ids[has], other)
                star = {(int(i), int(r)) for i, r in zip([*ids[has], *other], [*to_left, *to_right]) if i != r}
                edges = sorted(star)
            names, keys, links = ids[has], keys[has], links[has]
        else:
            keys = []
        empty = [None] * len(edges)
        return pa.table({
            "key": pa.array([*keys, *empty], pa.int64()),
            "id": pa.array([*names, *(a for a, _ in edges)], pa.int64()),
            "links": pa.array([*links, *empty], pa.int64()),
            "root": pa.array([*[None] * len(names), *(b for _, b in edges)], pa.int64())})

    met = home.groupBy(*group).cogroup(others.groupBy(*group)).applyInArrow(join, "key long, id long, links long, root long")
    met = materialize(met, "links")
    counts = met.where("links IS NOT NULL").groupBy("key", "id").agg(F.sum("links").alias("links"))
    of_entry = entries.join(counts, ["key", "id"], "left").select(
        *same, F.col("id").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = components(met.where("root IS NOT NULL").select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_entry = of_entry.join(named.withColumnRenamed("node", "least"), "least", "left").select(
        *same, "n_links", F.coalesce("component", "least").alias("component"))
    out = rows.join(of_entry, same, "left").select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))
