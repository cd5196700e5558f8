"""Near-duplicates, components and searches against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import metric_join, simhash, topk
from tidewatch.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int, vector int, key int, c int"
DOCS = "doc_id long, text string, id string, fingerprint int"


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "random", "star"])
def test_components(spark, kind):
    rnd = random.Random(5)
    n = 300
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(7, i) for i in range(n)],
             "random": [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 2)]}[kind]
    names = list(range(n + 1))
    rnd.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges]
    found = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in found} == groups(nodes, edges)


def test_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def some_vectors(n=300, d=8, seed=2):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, d))
    base[100:160] = base[0] + rnd.normal(size=(60, d)) * 0.15
    base[200:220] = base[1]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3 == 0), 0, 0, 0) for i, v in enumerate(base)]
    inf = float("inf")
    rows += [(1000, None, 1, 0, 0, 0), (1001, [0.0] * d, 1, 0, 0, 0), (1002, [None] * d, 1, 0, 0, 0), (1003, [inf] * d, 1, 0, 0, 0),
             (1004, [float("nan")] * d, 1, 0, 0, 0), (1005, [1.0] * d, None, 0, 0, 0), (1006, [1.0] * (d - 1), 1, 0, 0, 0),
             (1007, [], 1, 0, 0, 0), (1008, [1.0] * d, None, 0, 0, 0)]
    return rows


def sound(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("sizes", [{}, {"cell": 20, "block": 16}, {"cell": 4, "block": 500, "max_pivots": 30}])
def test_metric_join(spark, sizes):
    rows = some_vectors()
    unit = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if sound(r[1]) and any(r[1]) and r[2] is not None}
    label = {r[0]: (r[2], len(r[1] or [])) for r in rows}
    links = [(a, b) for a in unit for b in unit if a != b and label[a] == label[b] and unit[a] @ unit[b] >= 0.93]
    component = groups([r[0] for r in rows], links)
    found = metric_join.near_duplicates(spark.createDataFrame(rows, VECTORS), 0.93, **sizes).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_links == sum(a == r.vec_id for a, _ in links)
        assert r.component_id == component[r.vec_id] and r.kept == (r.vec_id == r.component_id)


def test_metric_join_null_ids_and_repeated_rows(spark):
    rows = [(None, [1.0, 0.0], 1, 0, 0, 0), (5, [1.0, 0.0], 1, 0, 0, 0), (5, [1.0, 0.0], 1, 0, 0, 0), (6, [2.0, 0.0], 1, 0, 0, 0)]
    found = metric_join.near_duplicates(spark.createDataFrame(rows, VECTORS), 0.93).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found) == [(0, 0, None), (5, 2, 5), (5, 2, 5), (6, 2, 5)]
    assert metric_join.near_duplicates(spark.createDataFrame([], VECTORS), 0.93).count() == 0


def top(rows, k):
    whole = {r[0]: [int(np.floor(1024 * x)) for x in r[1]] for r in rows if sound(r[1])}
    for q in [i for i in whole if i % 50 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        for rank, (score, i) in enumerate(scores[:k], 1):
            yield q, rank, i, -score


@pytest.mark.parametrize("sizes", [{}, {"candidate_block": 40, "query_block": 2, "sample": 5}, {"sample": 1000}])
def test_top_products(spark, sizes):
    rows = some_vectors()
    found = topk.top_products(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0, **sizes).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(top(rows, 10))


def test_few_candidates_and_ties(spark):
    rows = [(0, [1.0], 1, 0, 0, 0), (7, [1.0], 1, 0, 0, 0), (3, [1.0], 1, 0, 0, 0)]
    found = topk.top_products(spark.createDataFrame(rows, VECTORS), F.col("id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(1, 3), (2, 7)]
    assert topk.top_products(spark.createDataFrame([], VECTORS), F.col("id") == 0).count() == 0


def test_huge_products_saturate():
    a = np.array([[1 << 61, 1 << 61]])
    assert topk.products(a, a).tolist() == [[2**63 - 1]]


def fingerprint(text, shingle=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(n=150, seed=9):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["Ärger", "TEST", "x\x1cy"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    for _ in range(60):
        t = rnd.choice(base[:20]).split(" ")
        t[rnd.randrange(len(t))] = "changed"
        base.append(" ".join(t))
    return [*base, *base[:10], None, "", " \t", "one", "one two", " ".join(words * 40)]


def test_fingerprints():
    some = [t or "" for t in texts()]
    assert [int(x) for x in simhash.fingerprints_of(some, 3).view(np.uint64)] == [fingerprint(t) for t in some]


@pytest.mark.parametrize("bits, segments", [(3, 2), (3, 4), (5, 2)])
def test_simhash_groups(spark, bits, segments):
    data = [(10 * i, t, "", 0) for i, t in enumerate(texts())]
    prints = {i: fingerprint(t) for i, t, *_ in data}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= bits]
    component = groups(prints, links)
    found = simhash.near_duplicates(spark.createDataFrame(data, DOCS).repartition(5), 3, bits, segments).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{p:016x}", component[i]) for i, p in prints.items()}


def test_each_link_is_found_once(spark):
    values = [0, 1, 2, 3, 7, 1 << 40, 3 << 40, (1 << 40) | 1, -1, -2, 1 << 31, 1 << 32, -(1 << 63)]
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 3).collect()
    got = sorted(tuple(sorted((r.a, r.b))) for r in found)
    low = (1 << 64) - 1
    assert got == sorted((a, b) for a in values for b in values if a < b and ((a & low) ^ (b & low)).bit_count() <= 3)


def test_probes_are_not_broadcast(spark, tmp_path):
    values = [0, 1, 3, 1 << 40, -1, -(1 << 63)]
    spark.createDataFrame([(v,) for v in values], "fingerprint long").write.parquet(str(tmp_path / "prints"))
    # from a file, as a stage has them: by its size the planner takes either side to be small
    found = simhash.links(spark.read.parquet(str(tmp_path / "prints")), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    low = (1 << 64) - 1
    assert sorted(tuple(sorted((r.a, r.b))) for r in found.collect()) == sorted(
        (a, b) for a in values for b in values if a < b and ((a & low) ^ (b & low)).bit_count() <= 3)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_stage_of_the_pipeline_broadcasts_no_probes(spark, monkeypatch):
    plans, former = [], simhash.components

    def components(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return former(edges)

    monkeypatch.setattr(simhash, "components", components)
    docs = spark.createDataFrame([(1, "one two three"), (2, "ONE two three"), (3, "other words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs, 3, 3).collect()) == [1, 3]
    assert len(plans) == 1 and "BroadcastExchange" not in plans[0]


def test_simhash_null_ids_and_empty_table(spark):
    found = simhash.near_duplicates(spark.createDataFrame([(None, "a b c", "", 0), (4, "a b c", "", 0), (4, "a b c", "", 0)], DOCS), 3, 3)
    assert sorted((r.doc_id or 0, r.component_id) for r in found.collect()) == [(0, 4), (4, 4), (4, 4)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS), 3, 3).count() == 0


def test_one_row_of_every_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    near = text.upper()  # the same fingerprint
    rows = [(7, text, "a"), (3, near, "b"), (None, text, "c"), (9, "own words stand here", "d"), (9, "other words of the same id", "e"),
            (None, "without an id", "f"), (None, "without an id", "g"), (None, None, "h"), (None, "", "i"), (5, " ", "j")]
    rows += [(11, "repeated row in full", "k")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumn("row", F.lit(1)).repartition(4)
    kept = simhash.representatives(docs, 3, 3)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, r.text or "", r.doc) for r in kept.collect())
    assert [x[:2] for x in found] == sorted([
        (3, near), (9, "own words stand here"), (9, "other words of the same id"), (0, "without an id"), (5, " "),
        (11, "repeated row in full")])
    assert simhash.representatives(docs.limit(0), 3, 3).isEmpty()
