"""Operator 10: secret scans over a content-addressed ledger of blobs.

Every historical version of every path is addressed by the SHA-256 of its contents. Of the versions that share
a blob one is read, and only for the rules, named by kind and version, under which the blob was not scanned
before; both stand in the ledger, a table of blob, rule version and spans. Findings are kept per blob and joined back
to all paths, those of the rules now in force. Everything is a DataFrame expression: a rule's spans follow from the
lengths of the matches and of the text between them.

Texts move once, by blob and path, so that neither copies of one blob nor versions of one path meet in one
task; joins of paths with findings have one row per blob on the other side.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.storage import materialize


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


#: The base rules.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:([^\s/:@]+)@", 1, 6),
)
RULES = BASE + ADDED
SPAN = "struct<start:int,rule:int,end:int>"
FOUND = "array<struct<start:int,end:int>>"
LEDGER = f"blob binary, rule_version string, spans {FOUND}"
#: characters of a text that are cut off at once when it is put together again
CUT = 1024


def match_lengths(text: Column, rule: Rule) -> Column:
    """Per match of a rule: characters ahead of it since the last one, its own, and whether it counts."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    parts = F.zip_with(
        F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), values,
        lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (F.length(v) >= rule.least).alias("counts")))
    return F.when(text.rlike(rule.pattern), parts)


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
         path_column: str = "path", text_column: str = "text") -> DataFrame:
    """Newly scanned pairs of blob and rule version, findings or not: ``blob, rule_version, spans`` (code points, end
    exclusive, in order).

    ``ledger``: what earlier calls returned. A null text is the empty one; a null path is a path of its own;
    repeated versions are one blob. Spans are running sums of lengths over the matches of a blob and rule.
    """
    rows = addressed(versions, path_column, text_column)
    key = F.xxhash64("path")
    todo = rows.groupBy("blob").agg(F.min(key).alias("key"))
    every = F.array(*[F.lit(v) for v in dict.fromkeys(r.version for r in rules)])
    if ledger is None:
        todo = todo.withColumn("due", every)
    else:
        known = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("known"))
        due = F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))
        todo = todo.join(known, "blob", "left").select("blob", "key", due.alias("due")).where(F.size("due") > 0)
    texts = rows.withColumn("key", key).join(todo, ["blob", "key"])
    # a rule that stands twice is one version
    pairs = [
        F.when(F.array_contains("due", v), F.struct(F.lit(v).alias("rule_version"), match_lengths(F.col("text"), r).alias("parts")))
        for v, r in {r.version: r for r in rules}.items()
    ]
    scanned = texts.select("blob", F.explode(F.array(*pairs)).alias("pair")).where("pair IS NOT NULL")
    scanned = materialize(scanned.select("blob", "pair.*").dropDuplicates(["blob", "rule_version"]), "scanned")
    pair = ["blob", "rule_version"]
    upto = Window.partitionBy(*pair).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = scanned.where("parts IS NOT NULL").select(*pair, F.posexplode("parts").alias("at", "p")).withColumn(
        "end", F.sum(F.col("p.gap") + F.col("p.size")).over(upto).cast("int"))
    span = F.struct((F.col("end") - F.col("p.size")).alias("start"), "end")
    some = ends.where("p.counts").groupBy(*pair).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return scanned.select(*pair).join(some, pair, "left").select(*pair, F.coalesce("spans", F.array().cast(FOUND)).alias("spans"))


def addressed(versions: DataFrame, path_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return versions.select(F.col(path_column).alias("path"), text.alias("text")).withColumn(
        "blob", F.unhex(F.sha2("text", 256)))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in ``folder``, one row for each scanned pair; empty where none was written yet. A call that was
    repeated after it had written leaves its pairs twice, with the same findings."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder).dropDuplicates(["blob", "rule_version"])


def scan_into(folder: str, versions: DataFrame, rules: tuple[Rule, ...] = RULES,
              path_column: str = "path", text_column: str = "text") -> DataFrame:
    """Scan what the ledger in ``folder`` does not hold, add it there, and return the ledger."""
    spark = versions.sparkSession
    new = scan(versions, rules, read_ledger(spark, folder), path_column, text_column)
    new.write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def spans_by_blob(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, spans``: all spans of every blob that has any under ``rules``, by start, then rule. What other versions
    of rules found stays out, and a rule's number is its place in ``rules``."""
    numbers = [(F.lit(r.version), F.lit(i)) for i, r in reversed(list(enumerate(rules)))]
    number = F.coalesce(*[F.when(F.col("rule_version") == v, i) for v, i in numbers], F.lit(None).cast("int"))
    some = findings.withColumn("number", number).where((F.size("spans") > 0) & F.col("number").isNotNull())
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("number").alias("rule"), s["end"].alias("end")))
    return some.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))


def secrets(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None,
            path_column: str = "path", text_column: str = "text") -> DataFrame:
    """Every version's path and ``spans`` (array of start, rule number, end; empty if none).

    ``ledger``: pairs scanned earlier; what it lacks is scanned here, what it holds of rules no longer in ``rules`` does
    not count. One row per row of ``versions``; an empty table gives an empty result; other columns are not read.
    """
    found = materialize(scan(versions, rules, ledger, path_column, text_column), "findings")
    if ledger is not None:
        found = found.unionByName(ledger)
    return located(versions, found, rules, path_column, text_column)


def located(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES,
            path_column: str = "path", text_column: str = "text") -> DataFrame:
    """Findings joined back to all versions: as ``secrets``, from a ledger that holds every pair already."""
    rows = addressed(versions, path_column, text_column).select("path", "blob")
    return rows.join(spans_by_blob(findings, rules), "blob", "left").select(
        F.col("path").alias(path_column), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def without_secrets(versions: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]",
                    path_column: str = "path", text_column: str = "text") -> DataFrame:
    """``versions`` with every secret in the texts replaced by ``mask``; all rows and columns stay. Spans that overlap
    are replaced as one."""
    found = materialize(scan(versions, rules, None, path_column, text_column), "findings")
    each = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end")
    along = Window.partitionBy("blob").orderBy("start", "end")
    apart = F.coalesce(F.col("start") >= F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = each.withColumn("apart", apart).withColumn(
        "run", F.sum(F.col("apart").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    blob = F.unhex(F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256))
    whole = F.struct(*[F.col(f"`{c}`") for c in versions.columns])
    joined = versions.select(whole.alias("doc"), F.col(text_column).alias("text"), blob.alias("blob")).join(spans, "blob", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("spans"), mask))
    return joined.select(*[text.alias(c) if c == text_column else F.col(f"doc.`{c}`").alias(c) for c in versions.columns])


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every one of ``spans``, which do not overlap, replaced by ``mask``.

    The text is first cut into short strings, so that what lies between two spans costs its own length and not its
    distance from the start.
    """
    last = F.length(text)
    cuts = F.transform(F.sequence(F.lit(0), F.call_function("div", last, F.lit(CUT)).cast("int")),
                       lambda i: F.substring(text, i * CUT + 1, F.lit(CUT)))

    def between(parts: Column, start: Column, end: Column) -> Column:
        first = F.call_function("div", start, F.lit(CUT)).cast("int")
        count = F.call_function("div", end, F.lit(CUT)).cast("int") - first + 1
        return F.substring(F.array_join(F.slice(parts, first + 1, count), ""), start % CUT + 1, end - start)

    ends = F.concat(F.array(F.lit(0)), spans["end"])
    starts = F.concat(spans["start"], F.array(last))
    # the one-element array gives the cuts a name, so that they are made once and not for every span
    joined = F.transform(F.array(cuts), lambda parts: F.array_join(F.zip_with(
        ends, starts, lambda a, b: between(parts, a, b)), mask))
    return F.element_at(joined, 1)
