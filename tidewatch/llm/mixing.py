"""Operator 12: mixing sources to target weights.

The sizes (words) of every source are added up, targets follow from the sources' weights, and a source's repetition
rate is its target over its size. Every document is taken floor(rate) times, plus one more time if its draw, a number
in [0, 1) made from a hash of a seed, the document and its place among equal ones, is below the fraction of the rate.
Each of a few fixed seeds is such a draw for the whole source; the one whose words come nearest to the target counts.

A target is a share of all sizes by weight, but no more than ``most`` times the source's size; what is above is
shared again by weight among the others until none is above. That needs the sources' sums alone, and rounds of one
sum over them: a number reaches the driver each time, never the sources.

Sums are made before rows move, so a source with most of the documents is one row per task. Draws are made where
the document is. Copies of one id and text are told apart by number, over ranges, however many there are.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.ranks import numbered
from tidewatch.llm.storage import materialize

#: Weights of the sources in order, repeating; share of all sizes to take; most repeats of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: draws tried for every source; hex digits of a digest that make a draw
SEEDS, DIGITS = 16, 13


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1), the same for the same seed and key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("double") / float(16 ** DIGITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE,
            most: int = MOST) -> DataFrame:
    """``source, weight, source_size, target`` of ``sizes(source, source_size)``, one row per source.

    Sources stand by code point, null last, and take the weights in turn. The arithmetic is exact up to the last
    division.
    """
    named = sizes.select(F.lit("").alias("all"), F.col("source").isNull().alias("last"), "source", "source_size")
    ranked = numbered(named, "all", ["last", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    left = materialize(ranked.select("source", weight.cast("long").alias("weight"), "source_size"), "sources")
    exact = "decimal(38,0)"
    total = left.agg(F.sum(F.col("source_size").cast(exact))).first()[0]
    goal, full, above = share * int(total or 0), left.where("false"), True
    while above:
        # what remains is shared by weight among the sources that are not full
        weighed = left.agg(F.sum("weight")).first()[0] or 1
        level = goal / weighed
        over = F.col("weight").cast(exact) * level.numerator > F.col("source_size").cast(exact) * (most * level.denominator)
        taken, above = left.where(over).agg(F.sum(F.col("source_size").cast(exact)), F.count("*")).first()
        if above:
            goal -= most * int(taken)
            full, left = full.union(left.where(over)), left.where(~over)
    aim = (F.col("weight") * level.numerator).cast("double") / F.lit(float(level.denominator))
    return full.withColumn("target", (F.col("source_size") * most).cast("double")).union(left.withColumn("target", aim))


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows(doc, source, size, key)`` with keys that differ: rows of one key get a number of their own."""
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    several = materialize(several, "repeated")
    single = rows.join(several, "key", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    if not several.isEmpty():
        repeats = rows.join(several, "key", "left_semi").withColumn("row", F.monotonically_increasing_id())
        # written before they are sorted: the row number has to stay what it was
        told = numbered(materialize(repeats, "repeats"), "key", ["row"])
        single = single.unionByName(told.withColumn("copy", F.col("pos")).select(*single.columns))
    key = F.concat(F.col("copy").cast("string"), F.lit(":"), F.col("key"))
    return single.select("doc", "source", "size", key.alias("key"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST,
        seeds: int = SEEDS, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source") -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of the source, in words) and ``copies``, how often
    the mix takes the document; columns of these names are replaced. ``emitted`` gives the mix itself.

    A null text has no words; a null source is a source. A source without words has the target 0 and is not
    taken. Rows of one id, or without one, are drawn each by their text; rows equal in id and text each by a number
    of their own, so which of them counts for which is open, but how many are taken is not. The result depends on
    the rows alone, not on how they lie. An empty table gives an empty result.
    """
    given = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    text = F.coalesce(F.col(text_column), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("-")), F.sha2(text, 256))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("doc"), F.col(source_column).cast("string").alias("source"),
        words(F.col(text_column)).alias("size"), key.alias("key"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(materialize(sizes, "sizes"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = materialize(aims.select(
        F.col("source").alias("of"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part")), "targets")
    rows = told_apart(rows)
    of = F.col("source").eqNullSafe(F.col("of"))
    drawn = rows.select("source", "size", "key").join(aims, of).groupBy("of").agg(*[
        F.sum(F.col("size") * (F.col("whole") + (draw(k, F.col("key")) < F.col("part")).cast("long"))).alias(f"sum{k}")
        for k in range(seeds)])
    plan = aims.join(drawn.withColumnRenamed("of", "source"), of)
    near = [F.struct(F.abs(F.col(f"sum{k}").cast("double") - F.col("target")), F.lit(k).alias("seed")) for k in range(seeds)]
    plan = plan.select("of", "source_size", "target", "whole", "part", F.array_min(F.array(*near))["seed"].alias("seed"))
    own = F.coalesce(*[F.when(F.col("seed") == k, draw(k, F.col("key"))) for k in range(seeds)])
    copies = F.col("whole") + (own < F.col("part")).cast("long")
    return rows.join(materialize(plan, "plan"), of).select("doc.*", "size", "source_size", "target", copies.alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """Every document as many times as the mix takes it."""
    whole = F.struct(*[F.col(f"`{c}`") for c in mixed.columns])
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.select(whole.alias("doc"), again.alias("copy")).select("doc.*")
