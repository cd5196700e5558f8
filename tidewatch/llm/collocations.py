"""Operator 13: phrase collocations over a weighted de Bruijn graph.

Nodes are pairs of neighbouring words, edges are runs of three: the edge ``a b c`` leads from ``a b`` to ``b c`` and
weighs as many occurrences as the text has. Only these longest grams are counted, one row per word occurrence: a
piece's last two words make rows without a third or a second word, its corrections. The shorter counts follow:
a pair occurs as often as its node has flow, the weight of its outgoing edges plus the pieces that end with it;
a word as often as the nodes that begin with it flow, plus the pieces that end with it.

Edges below the least count leave the graph once they are credited to their node. What is left is compacted: an edge
followed by its node's only outgoing edge, where that node has no other incoming one, is a link of a unary path, found
by pointer doubling and kept as one row with the weights of its edges and the flows of its inner nodes. Candidates are
read off the paths; only the ends of paths have to look their last node up.

Counting combines in the task before the one shuffle by node. A node that many texts share would gather all its edges:
nodes frequent in a bounded sample of texts are dealt further by their third word, which changes no count.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.storage import materialize

#: Least count of a phrase, percent of its count at which a longer one hides it, phrases shown per group.
LEAST, HIDDEN, TOP = 10, 50, 2000
UNKNOWN = "und"
PIECE_END = re.compile("[.,;:!?\x0A-\x0D]")
#: words a task holds before it counts them
HELD = 2_000_000
#: sorted rows a task looks at together
TOGETHER = 200_000
#: texts looked at for frequent nodes, how many of those are dealt further, and to how many shares
SAMPLE, FREQUENT, SALTS = 10_000, 2000, 64
#: edges of a path in one row
PATH_EDGES = 256
#: numbers of counts, of their products and of a million times those
COUNT, EXACT = "decimal(15,0)", "decimal(38,0)"


def pieces(text: str | None) -> Iterator[list[str]]:
    """The words of every piece, A-Z in lower case."""
    # of bytes, so that other letters stay; a tab separates words as a blank does
    for piece in PIECE_END.split((text or "").encode().lower().decode().replace("\t", " ")):
        words = piece.split(" ")
        if "" in words:
            words = [w for w in words if w]
        if words:
            yield words


class Grams:
    """Words of texts, held as numbers of a task's dictionary until their runs of three are counted."""

    def __init__(self, hot: set[str]):
        self.hot = hot
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict(lambda: len(self.number))
        self.number[""]  # stands for what lies behind the end of a piece
        self.held: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, group: str, text: str | None) -> None:
        words = []
        for piece in pieces(text):
            words += piece
            words += ("", "")
        self.held.setdefault(group, []).append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def counts(self) -> Iterator[pa.RecordBatch]:
        """``node, thirds, n`` of what is held, which is let go."""
        words, many = pa.array(self.number, pa.string()), len(self.number)
        for group, held in self.held.items():
            flat = np.concatenate(held)
            starts = flat[:-2] > 0
            if not starts.any():
                continue
            pairs, at = np.unique((flat[:-2] * many + flat[1:-1])[starts], return_inverse=True)
            runs, n = np.unique(at * many + flat[2:][starts], return_counts=True)
            pair, third = np.divmod(runs, many)
            first, second = np.divmod(pairs, many)
            both = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")
            nodes = pc.if_else(pa.array(second > 0), both, words.take(pa.array(first)))
            keys = pc.binary_join_element_wise(nodes, group, "\t")
            node, thirds = keys.take(pa.array(pair)), words.take(pa.array(third))
            hot = pc.is_in(keys, pa.array(self.hot, pa.string())).to_numpy(zero_copy_only=False)[pair]
            if hot.any():
                some = pa.array(np.flatnonzero(hot))
                salted = [f"\t{zlib.crc32(w.encode()) % SALTS}\t{k}"
                          for k, w in zip(node.take(some).to_pylist(), thirds.take(some).to_pylist())]
                node = pc.replace_with_mask(node, pa.array(hot), pa.array(salted, pa.string()))
            yield pa.RecordBatch.from_arrays([node, thirds, pa.array(n)], ["node", "third", "n"])
        self.clear()


def counted(docs: DataFrame, hot: set[str]) -> DataFrame:
    """``node, third, n`` of ``docs(group, text)``, counted within tasks: occurrences by pair and third word; an empty
    third is the end of a piece, and a node of one word its last one. The node carries its group, ``words<tab>group``;
    of those in ``hot`` each share of the third words is a node of its own, ``<tab>share<tab>words<tab>group``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(hot)
        for batch in batches:
            for group, text in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist()):
                grams.add(group, text)
                if grams.size > HELD:
                    yield from grams.counts()
        yield from grams.counts()

    return docs.mapInArrow(run, "node string, third string, n long")


def first_words(nodes: pa.Array) -> pa.Array:
    """``word<tab>group`` of each node: what stands between its first word and its group is left out."""
    nodes = pa.concat_arrays([nodes])  # from its own start on
    data = np.frombuffer(nodes.buffers()[2], np.uint8)
    ends = np.frombuffer(nodes.buffers()[1], np.int32)[:len(nodes) + 1].astype(np.int64)
    data = data[:ends[-1]]
    tabs = np.flatnonzero(data == 9)
    either = np.flatnonzero((data == 9) | (data == 32))
    tab = tabs[np.searchsorted(tabs, ends[:-1])]
    word = either[np.searchsorted(either, ends[:-1])]
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, word, -1)
    np.add.at(change, tab, 1)
    kept = data[np.cumsum(change[:-1]) == 0]
    offsets = ends - np.concatenate([[0], np.cumsum(tab - word)])
    return pa.StringArray.from_buffers(len(nodes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept))


def changes(*columns: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before it in any column; the first one does."""
    differs = np.ones(len(columns[0]), bool)
    differs[1:] = np.logical_or.reduce([
        pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns])
    return differs


class Runs:
    """Edges, nodes and word sums out of rows that come sorted by node and third word.

    Of the last node only its flow so far and its last third word are carried to the rows that follow.
    """

    def __init__(self, least: int):
        self.least = least
        self.last, self.flow = None, 0

    def out(self, rows: pa.Table | None) -> pa.RecordBatch:
        """What is complete with ``rows``, or at the end of all rows."""
        if self.last is not None:
            rows = self.last if rows is None else pa.concat_tables([self.last, rows])
        final = rows is self.last
        node, third, n = (rows.column(c).combine_chunks() for c in ("node", "third", "n"))
        n = n.to_numpy()
        starts = np.flatnonzero(changes(node, third))
        weight = np.add.reduceat(n, starts)
        node, third = node.take(pa.array(starts)), third.take(pa.array(starts))
        heads = np.flatnonzero(changes(node))
        flow = np.add.reduceat(weight, heads)
        flow[0] += self.flow
        ready = len(weight) if final else len(weight) - 1
        whole = len(heads) if final else len(heads) - 1
        edge = np.flatnonzero((weight[:ready] >= self.least) & pc.not_equal(third, "").to_numpy(zero_copy_only=False)[:ready])
        own = node.take(pa.array(heads[:whole]))
        shared = pc.starts_with(own, "\t").to_numpy(zero_copy_only=False)
        kept = np.flatnonzero((flow[:whole] >= self.least) | shared)
        # shares go without their number from here on
        plain = pc.replace_substring_regex(own.filter(pa.array(shared)), r"^\t\d+\t", "")
        own = pc.replace_with_mask(own, pa.array(shared), plain)
        firsts = first_words(own) if whole else pa.array([], pa.string())
        runs = np.flatnonzero(changes(firsts)) if whole else np.empty(0, np.int64)
        sums = np.add.reduceat(flow[:whole], runs) if whole else flow[:0]
        parts = [
            ("edge", pc.replace_substring_regex(node.take(pa.array(edge)), r"^\t\d+\t", ""), third.take(pa.array(edge)), weight[edge]),
            ("node", own.take(pa.array(kept)), None, flow[kept]),
            ("word", firsts.take(pa.array(runs)), None, sums),
        ]
        if not final:
            # complete third words of the last node are counted into its flow, its last one may go on
            self.flow = int(flow[-1] - weight[-1])
            self.last = pa.table({"node": node.slice(len(node) - 1), "third": third.slice(len(third) - 1), "n": weight[-1:]})
        return pa.RecordBatch.from_arrays([
            pa.array([k for k, key, _, _ in parts for _ in range(len(key))], pa.string()),
            pa.concat_arrays([key for _, key, _, _ in parts]),
            pa.concat_arrays([pa.nulls(len(key), pa.string()) if t is None else t for _, key, t, _ in parts]),
            pa.array(np.concatenate([x for *_, x in parts])),
        ], ["kind", "key", "third", "n"])


def frequent_nodes(docs: DataFrame) -> set[str]:
    """The most frequent nodes of a sample of bounded size. They only tell where rows are dealt further."""
    some = docs.sample(min(1.0, SAMPLE / max(docs.count(), 1)), seed=1)
    seen = counted(some, set()).where(F.col("third") != "").groupBy("node").agg(F.sum("n").alias("n"))
    return {r.node for r in seen.orderBy(F.desc("n"), "node").limit(FREQUENT).collect()}


def graph(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of at least ``least`` (``grp, source, target, weight``), all nodes with that flow (``grp, node, flow``)
    and words with that count (``grp, word, count``, with ``n`` of the group)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = Runs(least), []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                yield runs.out(pa.Table.from_batches(held))
                held = []
        if held:
            yield runs.out(pa.Table.from_batches(held))
        if runs.last is not None:
            yield runs.out(None)

    # in order, so that a task holds one node at a time
    grams = counted(docs, frequent_nodes(docs)).repartition("node").sortWithinPartitions("node", "third")
    found = materialize(grams.mapInArrow(run, "kind string, key string, third string, n long"), "graph")
    split = F.split("key", "\t", 2)
    found = found.select("kind", split[1].alias("grp"), split[0].alias("words"), "third", "n")
    # the flow of a node in shares comes in several rows; a node of one word is the end of pieces
    nodes = found.where("kind = 'node' AND words LIKE '% %'").groupBy("grp", F.col("words").alias("node")).agg(F.sum("n").alias("flow"))
    words = found.where("kind = 'word'").groupBy("grp", F.col("words").alias("word")).agg(F.sum("n").alias("count"))
    words = materialize(words, "counts")
    sizes = words.groupBy("grp").agg(F.sum("count").alias("n"))
    words = words.where(F.col("count") >= least).join(materialize(sizes, "sizes"), "grp")
    target = F.concat(F.substring_index("words", " ", -1), F.lit(" "), F.col("third"))
    edges = found.where("kind = 'edge'").select(
        "grp", F.col("words").alias("source"), target.alias("target"), F.col("n").alias("weight"))
    return edges, materialize(nodes.where(F.col("flow") >= least), "nodes"), words


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Compacted unary paths, at most ``PATH_EDGES`` edges in a row: ``grp``, ``tail`` (the last edge's target) and
    ``edges``, in order, each with source, target, weight and the source's flow.

    Edges of a closed ring of unary nodes, which has no end to point to, stay single.
    """
    flow = nodes.select("grp", F.col("node").alias("source"), "flow")
    rows = edges.join(flow, ["grp", "source"]).withColumn("id", F.monotonically_increasing_id())
    rows = materialize(rows, "edges")
    leaving = rows.groupBy("grp", F.col("source").alias("node")).agg(F.count("*").alias("outs"), F.min("id").alias("next"))
    coming = rows.groupBy("grp", F.col("target").alias("node")).agg(F.count("*").alias("ins"), F.min("id").alias("id"))
    links = leaving.where("outs = 1").join(coming.where("ins = 1"), ["grp", "node"]).where("id != next")
    # last: the end of the path as far as it is known; at: how many edges lie before it
    known = materialize(links.select("id", F.col("next").alias("last"), F.lit(1).cast("long").alias("at")), "links")
    open_before = None
    while True:
        ahead = known.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("at").alias("more"))
        known = materialize(known.join(ahead, "last", "left").select(
            "id", F.coalesce("further", "last").alias("last"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"),
            F.col("further").isNotNull().alias("open")), "links")
        still = known.where("open").count()
        # one more round settles every path's edges up to twice the distance; only rings never end
        if still == open_before or not still:
            break
        open_before = still
    settled = known.where("NOT open").select("id", "last", "at")
    own = rows.join(settled, "id", "left").withColumns(
        {"last": F.coalesce("last", "id"), "at": F.coalesce("at", F.lit(0))})
    edge = F.struct((-F.col("at")).alias("order"), "source", "target", "weight", "flow")
    packed = own.groupBy("grp", "last", F.call_function("div", F.col("at"), F.lit(PATH_EDGES)).alias("part")).agg(
        F.array_sort(F.collect_list(edge)).alias("edges"))
    return packed.select("grp", F.element_at("edges", -1)["target"].alias("tail"), "edges")


def triples(compact: DataFrame, nodes: DataFrame) -> DataFrame:
    """Phrases of three words off the paths: ``grp, phrase, a, head, tail`` with the counts of their two pairs."""
    end = nodes.select("grp", F.col("node").alias("tail"), F.col("flow").alias("tail_flow"))
    whole = compact.join(end, ["grp", "tail"])
    each = whole.select("grp", "tail_flow", F.col("edges.flow").alias("flows"), F.posexplode("edges").alias("at", "e"))
    # an inner node's flow stands beside the edge that leaves it
    following = F.coalesce(F.get("flows", F.col("at") + 1), F.col("tail_flow"))
    last = F.substring_index("e.target", " ", -1)
    return each.select(
        "grp", F.concat(F.col("e.source"), F.lit(" "), last).alias("phrase"), F.col("e.weight").alias("a"),
        F.col("e.flow").alias("head"), following.alias("tail"))


def scored(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 * a * a / (left * right)) without rounding."""
    a, left, right = (c.cast(COUNT) for c in (a, left, right))
    return F.call_function("div", (a * a * F.lit(1_000_000)).cast(EXACT), (left * right).cast(EXACT)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, hidden: int = HIDDEN, top: int = TOP,
                 text_column: str = "text", group_column: str = "lang") -> DataFrame:
    """The best phrases of two or three words of every group: ``grp, rank, phrase, a, l, r, n, score``.

    ``a``: occurrences, at least ``least``; ``l`` and ``r``: those of the two parts at the cut that scores lowest,
    the first such one; ``score``: a million times a squared over their product, rounded down; ``n``: words of the group.
    Pairs inside a longer phrase with at least ``hidden`` percent of their count are left out. Up to ``top`` phrases a
    group, ties by ``a``, then by the phrase's bytes.

    A null group is ``und``, together with rows that are called so; a null text has no words; repeated rows count each time. Texts of
    any length are read whole. An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(group_column).cast("string"), F.lit(UNKNOWN)).alias("group"), F.col(text_column).alias("text"))
    edges, nodes, words = graph(texts, least)
    words = materialize(words, "words")
    edges = materialize(edges, "edges")
    three = materialize(triples(materialize(paths(edges, nodes), "paths"), nodes), "triples")
    # the heaviest edge at either end of a node
    ends = edges.select("grp", F.col("source").alias("node"), "weight").union(edges.select("grp", "target", "weight"))
    longer = ends.groupBy("grp", "node").agg(F.max("weight").alias("longer"))
    two = nodes.join(longer, ["grp", "node"], "left").where(
        F.coalesce("longer", F.lit(0)) * 100 < F.col("flow") * hidden).select(
        "grp", F.col("node").alias("phrase"), F.col("flow").alias("a"),
        F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"))
    both = three.unionByName(two)

    def with_count(rows: DataFrame, of: Column, name: str, *more: str) -> DataFrame:
        counts = words.select(F.col("grp").alias("g"), F.col("word").alias("w"), F.col("count").alias(name), *more)
        return rows.join(counts, (F.col("grp") == F.col("g")) & (of == F.col("w"))).drop("g", "w")

    both = with_count(both, F.substring_index("phrase", " ", 1), "first", "n")
    both = with_count(both, F.substring_index("phrase", " ", -1), "last")

    def cut(k: int, left: Column, right: Column) -> Column:
        return F.struct(scored(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    lowest = F.when(F.col("head").isNull(), cut(1, F.col("first"), F.col("last"))).otherwise(F.least(
        cut(1, F.col("first"), F.coalesce("tail", "last")), cut(2, F.coalesce("head", "first"), F.col("last"))))
    found = both.select("grp", "phrase", "a", "n", lowest.alias("cut")).select(
        "grp", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of every share first, so that no group meets in one task
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
