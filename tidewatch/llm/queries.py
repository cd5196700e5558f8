"""Registered queries of the training-data operators, each over its whole table with production settings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    bpe, collocations, line_dedup, lm, merkle, metric_join, mixing, packing, secrets, simhash, token_store, topk, toxicity,
)
from tidewatch.session import prepare, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: shingle length in words and maximum bit distance of the SimHash near-duplicates
SHINGLE, SIMHASH_BITS = 3, 3
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: long texts come to Python in small batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def query(name: str):
    """Register a function under ``name``, with the session settings in place."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)

        QUERIES[name] = run
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_store")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(table(spark, sf_dir, "documents"), WORD_BPE, 1, shared_dir(spark))
    stored = token_store.read_tokens(spark, path)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_bpe_round_trip")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, 0)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, SIMHASH_BITS)


@query("op1_metric_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


ORACLE["op1_metric_join"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x != 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
      ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id != b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(node, root) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots ON node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = e.vec_id
"""


@query("op7_top_products")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE["op7_top_products"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id != c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    # the added rules come later: they alone are scanned then
    secrets.scan_into(folder, docs, secrets.BASE, "doc_id")
    found = secrets.located(docs, secrets.scan_into(folder, docs, path_column="doc_id"), path_column="doc_id")
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE))

    def number(rule: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")

    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# the pattern has to be a constant in DuckDB, so the rules are spelt out one by one
MATCHED = "\n  UNION ALL ".join(
    f"SELECT doc_id, {i} AS rule, {quoted(r.kind)} AS kind, {r.least} AS least, regexp_split_to_array(t, {quoted(r.pattern)}) AS gaps, "
    f"regexp_extract_all(t, {quoted(r.pattern)}) AS hits, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS vals "
    f"FROM texts WHERE regexp_matches(t, {quoted(r.pattern)})" for i, r in enumerate(secrets.RULES))
ORACLE["op10_secret_scan"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS (
  {MATCHED}
), numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM matched),
spans AS (
  SELECT doc_id, rule, kind, s AS start, s + length(hits[k]) AS stop FROM (
    SELECT *, list_sum(list_transform(gaps[1:k], lambda x: length(x)))::BIGINT
            + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)::BIGINT AS s FROM numbered
  ) WHERE length(vals[k]) >= least
), byd AS (
  SELECT doc_id,
    count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) FILTER (rule < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN byd USING (doc_id)
"""


def held_out(column: str) -> Column:
    return F.crc32(F.col(column).cast("string")) % 5 == 0


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicated(table(spark, sf_dir, "documents"), short_repeats=True)
    return cleaned.select(
        "doc_id", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op6_lm_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.log_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_tokens", F.round("log_score", 5).alias("log_score"))


PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"""
ORACLE["op6_lm_scores"] = f"""
WITH tokens AS (
    SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {quoted(PIECES)}) AS w FROM documents)
), grams AS (
    SELECT doc_id, w, pos, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM tokens
), counted AS (
    SELECT doc_id, prev, w, pos,
        count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
        count(*) OVER (PARTITION BY prev, w) - count(*) OVER (PARTITION BY doc_id, prev, w) AS c2,
        greatest(count(*) OVER () - count(*) OVER (PARTITION BY doc_id), 1) AS rest
    FROM grams
), scored AS (
    SELECT doc_id, CASE
        WHEN prev IS NOT NULL AND c2 > 0 THEN ln(c2 / lag(c1) OVER (PARTITION BY doc_id ORDER BY pos))
        ELSE CASE WHEN prev IS NULL THEN 0 ELSE ln({lm.ALPHA}) END
           + CASE WHEN c1 > 0 THEN ln(c1 / rest) ELSE ln({lm.ALPHA}) - ln(rest) END END AS s
    FROM counted
)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(s, 0), 5) AS log_score
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, sum(s) AS s FROM scored GROUP BY doc_id) USING (doc_id)
"""


@query("op11_merkle_manifest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", UPPER, UPPER.lower())
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf(
        *[lowered if c == "text" else F.col(c) for c in LEAF]))
    found = merkle.manifest(docs, LEAF, keep={"tampered": tampered})
    again = merkle.folded(F.coalesce("tampered", "leaf"), F.col("siblings"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(merkle.joined(F.col("siblings"))).alias("proof_sha256"),
        again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def tree_sql(nodes: str, name: str, levels: int) -> str:
    """Views ``<name>0``, ``<name>1``, ... of all levels over ``nodes(tree, pos, h)``; a single node stays as it is."""
    above = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {nodes})"]
    above += [f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) "
              f"ELSE any_value(h) END AS h, (any_value(m) + 7) // 8 AS m FROM {name}{k} GROUP BY tree, pos // 8)"
              for k in range(levels)]
    return ",\n".join(above)


def path_sql(rows: str, name: str, levels: int, node: str) -> str:
    """Views that climb ``rows(tree, pos, proof, again, ...)`` up the levels; ``node``: the columns to carry."""
    climbed = []
    for k in range(levels):
        before = rows if k == 0 else f"{name}p{k}"
        climbed.append(f"""{name}p{k + 1} AS (SELECT {node}, r.tree, r.pos // 8 AS pos, proof || coalesce(lft, '') || coalesce(rgt, '') AS proof,
  CASE WHEN many THEN sha256(coalesce(lft, '') || again || coalesce(rgt, '')) ELSE again END AS again
  FROM {before} r JOIN (SELECT a.tree, a.pos, any_value(a.m) > 1 AS many, string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS lft,
    string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS rgt
    FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.pos // 8 = b.pos // 8 GROUP BY a.tree, a.pos) s ON r.tree = s.tree AND r.pos = s.pos)""")
    return ",\n".join(climbed)


#: columns that a leaf covers, in order
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: DuckDB has the CRC-32 of no text, so it comes bit by bit from the generator's fixed value
CRC = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda x, c: list_reduce(list_prepend(xor(x, c), [0::BIGINT,0,0,0,0,0,0,0]),
    lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT)))) """
LEVELS, TREES = 7, 3
FIELD = "coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(FIELD.format(c=text if c == "text" else c) for c in LEAF) + ")"


ORACLE["op11_merkle_manifest"] = f"""
WITH leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {leaf_sql("text")} AS h,
    CASE WHEN xor({CRC}, 4294967295::BIGINT) % 3 = 0 THEN {leaf_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS bad FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves
), {tree_sql("(SELECT tree, pos, h FROM numbered)", "a", LEVELS)},
subroots AS (SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h FROM a{LEVELS}),
{tree_sql("(SELECT tree, pos, h FROM subroots)", "b", TREES)},
started AS (SELECT doc_id, h AS leaf, tree, pos, '' AS proof, coalesce(bad, h) AS again FROM numbered),
{path_sql("started", "a", LEVELS, "doc_id, leaf")},
entered AS (
  SELECT doc_id, leaf, s.h AS subroot, s.tree, s.pos, proof, again FROM ap{LEVELS} p JOIN subroots s ON s.name = p.tree
), {path_sql("entered", "b", TREES, "doc_id, leaf, subroot")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, again AS folded_root, again = root AS verified
FROM bp{TREES}, (SELECT h AS root FROM b{TREES})
"""


@query("op12_source_mix")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def draw_sql(seed: str) -> str:
    return f"('0x' || substr(sha256({seed} || ':' || key), 1, {mixing.DIGITS}))::BIGINT::DOUBLE / {float(16 ** mixing.DIGITS)!r}::DOUBLE"


ORACLE["op12_source_mix"] = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {quoted(mixing.WORD)}))::BIGINT AS size,
    (row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) - 1) || ':' || coalesce(doc_id::VARCHAR, '-') || ':' || sha256(coalesce(text, '')) AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight
  FROM docs GROUP BY source
), filled AS (
  -- sources by how soon they are full: full[i] is what those before take, left[i] the weight of the rest
  SELECT *, coalesce(sum(source_size) OVER before, 0) AS taken_up, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest,
    sum(source_size) OVER () AS total FROM sizes
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (3 * total - 4 * taken_up) AS num, 2 * rest AS den FROM filled
  WHERE weight * (3 * total - 4 * taken_up) <= 2 * source_size * 2 * rest ORDER BY taken_up, rest DESC LIMIT 1
), aims AS (
  SELECT source, source_size, CASE WHEN weight * num > 2 * source_size * den THEN (2 * source_size)::DOUBLE
    ELSE (weight * num)::DOUBLE / den::DOUBLE END AS target FROM sizes, level
), rated AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aims)
), tried AS (
  SELECT doc_id, key, size, k, r.* FROM docs d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, range({mixing.SEEDS}) s(k)
), taken AS (SELECT *, size * (whole + ({draw_sql("k")} < part)::BIGINT) AS taken FROM tried),
chosen AS (
  SELECT source, arg_min(k, struct_pack(far := abs(taken::DOUBLE - target), k := k)) AS k
  FROM (SELECT source, k, sum(taken) AS taken, any_value(target) AS target FROM taken GROUP BY source, k) GROUP BY source
)
SELECT doc_id, size, source_size, target, taken FROM taken t JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source AND t.k = c.k
"""


@query("op13_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


ORACLE["op13_collocations"] = f"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM split),
counted AS MATERIALIZED (
  SELECT lang || chr(9) AS g, size, g || phrase AS key, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
  ) GROUP BY ALL
), often AS MATERIALIZED (SELECT key, f FROM counted WHERE f >= 10),
sized AS MATERIALIZED (SELECT g, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY g),
candidates AS MATERIALIZED (
  SELECT *, f AS a, g || w[1] AS head, g || array_to_string(w[2:], ' ') AS rest, g || array_to_string(w[:size - 1], ' ') AS most, g || w[size] AS last
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10)
), longer AS MATERIALIZED (
  SELECT key, max(a) AS f FROM (SELECT most AS key, a FROM candidates WHERE size = 3 UNION ALL SELECT rest, a FROM candidates WHERE size = 3) GROUP BY key
), cuts AS (
  SELECT g, key, phrase, a, 1 AS cut, head AS lkey, rest AS rkey FROM candidates
  UNION ALL SELECT g, key, phrase, a, 2, most, last FROM candidates WHERE size = 3
), scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN often x ON x.key = lkey JOIN often y ON y.key = rkey
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, cut) = 1)
SELECT left(c.g, length(c.g) - 1) AS lang, row_number() OVER (PARTITION BY c.g ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest c JOIN sized s ON s.g = c.g LEFT JOIN longer h ON h.key = c.key
WHERE h.f IS NULL OR 100 * h.f < 50 * a QUALIFY rank <= 2000
"""
