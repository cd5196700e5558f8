"""Merkle manifest, source mix and collocations against plain models."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import collocations as co
from tidewatch.llm import merkle, mixing
from tidewatch.llm.ranks import numbered

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha("".join(part(row[c]) for c in LEAF))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 8])) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        first = at - at % 8
        found.append(("".join(level[first:at]), "".join(level[at + 1:first + 8])))
        at //= 8
    return found


def manifest_model(rows):
    trees = collections.defaultdict(list)
    for row in rows:
        trees[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row)))
    names = sorted(trees, key=lambda n: b"" if n is None else b"+" + n.encode())
    levels = {n: climb([x[2] for x in sorted(trees[n])]) for n in names}
    top = climb([levels[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for at, (_, _, leaf) in enumerate(sorted(trees[n])):
            out.append((leaf, levels[n][-1][0], top[-1][0], siblings(levels[n], at) + siblings(top, k)))
    return out


def odd_docs(n, seed=1):
    rng = random.Random(seed)
    rows = [dict(doc_id=i, text=f"Text {i} É", lang=rng.choice(["en"] * 5 + [None, "", "de"]), source="s", n_chars=i) for i in range(n)]
    rows += [dict(doc_id=None, text=None, lang="en", source=None, n_chars=None)] * 3
    rows += [dict(doc_id=None, text="x", lang=None, source="", n_chars=1), dict(doc_id=7, text="again", lang="en", source="s", n_chars=2)]
    rows += [dict(doc_id=7, text="again", lang="en", source="s", n_chars=2)] * 9
    return rows


@pytest.mark.parametrize("n", [1, 8, 70, 1300])
def test_manifest(spark, n):
    rows = odd_docs(n) if n > 1 else [dict(doc_id=1, text="A", lang="en", source="s", n_chars=1)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    found = merkle.manifest(docs, LEAF).select(
        "*", merkle.folded(F.col("leaf"), F.col("siblings")).alias("folded")).collect()
    assert all(r.folded == r.root for r in found)
    got = [(r.leaf, r.subroot, r.root, [tuple(s) for s in r.siblings]) for r in found]
    assert sorted(got) == sorted(manifest_model(rows))


def test_manifest_of_many_trees_finds_tampering(spark):
    rows = [dict(doc_id=i, text="Long " * (9000 if i == 5 else 1), lang=f"l{i % 700}", source="s", n_chars=i) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"tree": F.lit(1), "pos": F.lit(2), "node": F.lit("x"), "_part": F.lit(0)})
    other = merkle.leaf(*[F.lower("text") if c == "text" else F.col(c) for c in LEAF])
    found = merkle.manifest(docs, LEAF, keep={"other": F.when(F.col("doc_id") % 2 == 0, other), "node": F.col("node")})
    found = found.withColumn("again", merkle.folded(F.coalesce("other", "leaf"), F.col("siblings")))
    kept = found.select("doc_id", "node", (F.col("again") == F.col("root")).alias("ok")).collect()
    assert len(kept) == 1500 and all(r.ok == (r.doc_id % 2 == 1) and r.node == "x" for r in kept)
    got = found.select("leaf", "subroot", "root").collect()
    assert sorted(map(tuple, got)) == sorted(x[:3] for x in manifest_model(rows))


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC), LEAF).isEmpty()


def test_numbers(spark):
    rows = [(g, v) for g in "abc" for v in range({"a": 1, "b": 40, "c": 900}[g])] + [("c", 5)] * 30
    found = numbered(spark.createDataFrame(rows, "g string, v long").repartition(7), "g", ["v"]).collect()
    for g in "abc":
        own = sorted((r.pos, r.v) for r in found if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r.members for r in found if r.g == g} == {len(own)}


def mix_targets(sizes):
    """Targets of ``sizes`` in order of the sources."""
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    goal, full = 1.5 * sum(sizes), set()
    while True:
        rest = sum(w for k, w in enumerate(weights) if k not in full) or 1
        left = goal - sum(2 * sizes[k] for k in full)
        over = {k for k, w in enumerate(weights) if k not in full and left * w / rest > 2 * sizes[k] + 1e-9}
        if not over:
            return [2 * s if k in full else left * weights[k] / rest for k, s in enumerate(sizes)]
        full |= over


def mixed_docs():
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["b", "a", "é", "Z", "hot", "hot", "hot"])) for i in range(1500)]
    rows += [(None, f"no id {i}\t\x0b x", None) for i in range(400)] + [(5000, "same again and again", "copies")] * 900
    return rows + [(6000, None, "silent"), (6001, "", "silent"), (6002, "word " * 30_000, "a"), (6003, "   ", "b")]


def test_mix(spark):
    rows = mixed_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"size": F.lit("x"), "key": F.lit(1), "plan": F.lit(2), "of": F.lit(3), "pos": F.lit(4)})
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "key", "plan", "of", "pos", "size", "source_size", "target", "copies"]
    found = mixed.collect()
    word = re.compile(mixing.WORD)
    assert len(found) == len(rows)
    assert all(r.size == len(word.findall(r.text or "")) and 0 <= r.copies <= 2 for r in found)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len(word.findall(r[1] or "")) for r in rows if r[2] == n) for n in names]
    for n, size, target in zip(names, sizes, mix_targets(sizes)):
        own = [r for r in found if r.source == n]
        assert {r.source_size for r in own} == {size}
        assert all(abs(r.target - target) < 1e-6 for r in own)
        most = max(r.size for r in own)
        assert abs(sum(r.size * r.copies for r in own) - target) <= max(0.02 * target, most)
    want = collections.Counter((r.doc_id, r.text) for r in found for _ in range(r.copies))
    got = collections.Counter((r.doc_id, r.text) for r in mixing.emitted(mixed).collect())
    assert got == want


def test_mix_does_not_depend_on_how_rows_lie(spark):
    docs = spark.createDataFrame(mixed_docs(), "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (docs.repartition(3), docs.repartition(11)))
    assert first == again


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).isEmpty()
    silent = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert all((r.size, r.source_size, r.target, r.copies) == (0, 0, 0.0, 0) for r in silent)


def test_full_sources_give_their_excess_to_others(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 0), ("d", 500)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert found == dict(zip(["a", "b", "c", "d", None], mix_targets([10, 1000, 10, 500, 0])))
    assert found["a"] == 20 and found["c"] == 20 and found[None] == 0


def phrase_model(docs, least=10, hidden=50, top=2000):
    counts, out = collections.defaultdict(collections.Counter), []
    for text, lang in docs:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        rows = []
        for g, a in f.items():
            if len(g) == 1 or a < least:
                continue
            if len(g) == 2 and any(100 * v >= hidden * a for h, v in f.items() if len(h) == 3 and v >= least and g in (h[:2], h[1:])):
                continue
            score, cut = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(14)] + ["É", "ABC", "x y", "l'an"]
    chain = " ".join(f"c{i}" for i in range(700))
    docs = [(" ".join(rng.choices(vocab, [1 / (k + 1) for k in range(18)], k=rng.randrange(40))), rng.choice(["en", "en", "en", None, "und", "a\tb"]))
            for _ in range(400)]
    docs = [(re.sub(" w3 ", lambda m: rng.choice([", ", ". w3\t", "\n"]), t), g) for t, g in docs]
    # long unary paths, one that branches, rings, a pair with very many followers
    docs += [(chain, "en")] * 12 + [(" ".join(f"c{i}" for i in range(90, 130)) + " other end", "en")] * 15
    docs += [("la la la la la; ring a round ring a round ring a round", "de")] * 14
    docs += [(f"hot pair f{i % 60} hot pair f{i % 60}", "fr") for i in range(2000)]
    return docs + [(None, "en"), ("", None), (" \t.,;", "en"), ("one", "one"), ("long " * 20_000, "es")]


def test_collocations(spark):
    docs = phrase_docs()
    frame = spark.createDataFrame(docs, "text string, lang string").withColumns({"group": F.lit(1), "node": F.lit(2), "n": F.lit(3)})
    found = co.collocations(frame.repartition(6))
    assert sorted(map(tuple, found.collect())) == phrase_model(docs)
    few = co.collocations(frame, least=3, hidden=80, top=7)
    assert sorted(map(tuple, few.collect())) == phrase_model(docs, 3, 80, 7)


def test_collocations_dealt_further(spark, monkeypatch, request):
    docs = phrase_docs()
    monkeypatch.setattr(co, "frequent_nodes", lambda docs: {"hot pair\tfr", "w0 w0\ten", "c5 c6\ten"})
    monkeypatch.setattr(co, "HELD", 300)
    monkeypatch.setattr(co, "TOGETHER", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    monkeypatch.setattr(co, "PATH_EDGES", 16)
    found = co.collocations(spark.createDataFrame(docs, "text string, lang string"))
    assert sorted(map(tuple, found.collect())) == phrase_model(docs)


def test_paths_are_whole(spark):
    frame = spark.createDataFrame(phrase_docs(), "text string, lang string").select(F.col("lang").alias("group"), "text")
    edges, nodes, _ = co.graph(frame.where("group IN ('en', 'de')"), 10)
    compact = co.paths(edges, nodes).collect()
    assert sum(len(r.edges) for r in compact) == edges.count() == len({(r.grp, e.source, e.target) for r in compact for e in r.edges})
    assert all(a.target == b.source for r in compact for a, b in zip(r.edges, r.edges[1:]))
    assert max(len(r.edges) for r in compact) == co.PATH_EDGES and all(r.tail == r.edges[-1].target for r in compact)


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(9 * 10**11, 3 * 10**12, 7 * 10**12)], "a long, l long, r long")
    found = row.select(co.scored(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert found == 10**6 * (9 * 10**11) ** 2 // (3 * 10**12 * 7 * 10**12)


def test_collocations_of_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).isEmpty()


def test_frequent_nodes(spark):
    docs = spark.createDataFrame([(f"hot pair {i}", "en") for i in range(300)], "text string, group string")
    assert "hot pair\ten" in co.frequent_nodes(docs) and len(co.frequent_nodes(docs)) < 2000
