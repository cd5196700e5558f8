"""Operator 11: a Merkle manifest of a table, its levels kept as concatenated strings.

Every row is a leaf, the hash of its fields. The leaves of a tree (one for each value of the grouping column)
stand in ascending order and are dealt into aligned blocks of 512. A block keeps each of its levels as one string of
fixed-width hex digests: a node's parent is the hash of a fixed-width substring of eight digests, and the digests
that flank a node in that substring are its sibling segments. A block's last node is a leaf of the next tier, whose
blocks are made in the same way, until every tree has one node, its subroot; the subroots are the leaves of a last
tree, whose node is the root. Sibling segments are handed down again from tier to tier, block by block.

Ranges number the leaves, so no tree meets in one task; a block holds 512 digests whatever the table's size, and a
tier has a 512th of the rows of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.ranks import numbered
from tidewatch.llm.storage import materialize

#: nodes under one parent, levels of a block, hex digits of a digest
FAN, LEVELS, WIDTH = 8, 3, 64
BLOCK = FAN ** LEVELS
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as part of a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of a row's fields."""
    return digest(F.concat(*map(field, values)))


def parents(level: Column) -> Column:
    """The level above: the hash of every eight digests, the last ones fewer."""
    width = FAN * WIDTH
    runs = F.sequence(F.lit(0), F.call_function("div", F.length(level) - 1, F.lit(width)).cast("int"))
    return F.array_join(F.transform(runs, lambda i: digest(F.substring(level, i * width + 1, F.lit(width)))), "")


def blocked(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """``nodes(tree, pos, members, node, payload)`` in blocks: their members in order, the level strings, the last node.

    A tree of m nodes still has to climb as many levels as it takes until one is left, at most three of them here.
    """
    member = F.struct(F.col("pos"), F.col("node"), *[F.col(c) for c in payload])
    blocks = nodes.groupBy("tree", F.call_function("div", F.col("pos"), F.lit(BLOCK)).alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("inside"), F.max("members").alias("members"))
    steps = sum((F.col("members") > FAN ** k).cast("int") for k in range(LEVELS))
    blocks = blocks.withColumns({"steps": steps, "level0": F.array_join(F.col("inside.node"), "")})
    for k in range(LEVELS):
        below = F.col(f"level{k}")
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("steps") > k, parents(below)).otherwise(below))
    return blocks.withColumnRenamed(f"level{LEVELS}", "top")


def climbed(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Blocks of all tiers, the lowest first; in the last one every tree is one block, its ``top`` the tree's root."""
    tiers = [materialize(blocked(nodes, payload), "blocks")]
    while not tiers[-1].where("block > 0").isEmpty():
        above = tiers[-1].select(
            "tree", F.col("block").alias("pos"), F.col("top").alias("node"),
            F.ceil(F.col("members") / BLOCK).alias("members"))
        tiers.append(materialize(blocked(above, []), "blocks"))
    return tiers


def flanks(pos: Column) -> Column:
    """Sibling segments of a block's member, from the lowest level up."""
    found = []
    for k in range(LEVELS):
        node = F.call_function("div", pos % BLOCK, F.lit(FAN ** k))
        at = (node % FAN).cast("int")
        run = F.substring(F.col(f"level{k}"), ((node - at) * WIDTH + 1).cast("int"), F.lit(FAN * WIDTH))
        found.append(F.struct(
            F.substring(run, F.lit(1), at * WIDTH).alias("left"),
            F.substring(run, (at + 1) * WIDTH + 1, F.lit(FAN * WIDTH)).alias("right")))
    return F.slice(F.array(*found), F.lit(1), F.col("steps"))


def opened(tiers: list[DataFrame], top: DataFrame, payload: list[str], carried: list[str]) -> DataFrame:
    """Members of the lowest tier with ``siblings`` up to the root; ``top(tree, above, carried)``: for every tree
    what follows above its own root, and columns to hand down."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(tiers))):
        rows = tiers[k].join(above, ["tree", "block"])
        own = payload if k == 0 else []
        rows = rows.select("*", F.explode("inside").alias("m"))
        rows = rows.select(
            "tree", *[F.col(f"m.{c}").alias(c) for c in ["pos", "node", *own]],
            F.concat(flanks(F.col("m.pos")), F.col("above")).alias("siblings"), *carried)
        above = rows.select("tree", F.col("pos").alias("block"), F.col("siblings").alias("above"), *carried)
    return rows


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", id_column: str = "doc_id",
             keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id column, ``leaf``, ``subroot``, ``root``, ``siblings`` (segments left and
    right of the row's path, from the leaf to the root) and the columns of ``keep``, made from ``docs``.

    Leaves are the hashes of ``fields`` in that order; null values count as such. A tree's leaves stand by id, null
    ids first, rows of one id by leaf; trees stand by the UTF-8 bytes of their name, the one of null first. Repeated
    rows are leaves of their own, equal ones in any order. Eight consecutive nodes make a parent, the last run of a
    level may be shorter, even one node, and a single node is not hashed again. An empty table gives an empty
    result. Columns not named are not read, whatever their names.
    """
    keep = keep or {}
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    extra = [f"keep{k}" for k in range(len(keep))]
    leaves = docs.select(
        tree.alias("tree"), F.col(id_column).alias("id"), leaf(*map(F.col, fields)).alias("node"),
        *[value.alias(c) for c, value in zip(extra, keep.values())], F.monotonically_increasing_id().alias("row"))
    # written before they are sorted: the row number has to stay what it was
    leaves = numbered(materialize(leaves, "leaves"), "tree", ["id", "node", "row"])
    payload = ["id", *extra]
    tiers = climbed(leaves, payload)
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node"))
    upper = climbed(numbered(subroots, "tree", ["name"]), ["name"])
    roots = upper[-1].select("tree", F.array().cast(STEP).alias("above"), F.col("top").alias("root"))
    named = opened(upper, roots, ["name"], ["root"]).select(
        F.col("name").alias("tree"), F.col("siblings").alias("above"), F.col("node").alias("subroot"), "root")
    # small beside the table, and measured once it is written
    found = opened(tiers, materialize(named, "subroots"), payload, ["subroot", "root"])
    return found.select(
        F.col("id").alias(id_column), F.col("node").alias("leaf"), "subroot", "root", "siblings",
        *[F.col(c).alias(name) for c, name in zip(extra, keep)])


def folded(node: Column, siblings: Column) -> Column:
    """The root that a leaf and its sibling segments lead to."""
    return F.aggregate(siblings, node, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def joined(siblings: Column) -> Column:
    """All sibling digests as one string, from the leaf to the root, each level left to right."""
    return F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), "")
