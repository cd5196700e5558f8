"""Operator 4: toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded: lower case, look-alike letters of other scripts and digits standing for letters replaced,
words set apart by single blanks. The lexicon holds words and word beginnings, learned from labelled rows: an
entry's weight is its smoothed log-odds between toxic and clean documents, and it enters only where the split
is far from chance. Exception phrases are an entry together with a neighbouring word that is typical of clean
documents; a hit inside one does not count. A document's hits (the heaviest entry per word) are summed, once
as they are and once per length, and a logistic curve turns both into a score.

Learning reads at most ``sample`` labelled rows, drawn by a hash of the id; lexicon, phrases and curve have
fixed upper sizes, so the model goes out with the tasks. Scoring is a narrow pass over whole texts.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm.storage import materialize

SAMPLE = 20_000
ENTRIES = 4_000
#: evidence an entry needs: documents with it times the divergence of their toxic share from the usual one
EVIDENCE = 14.0
#: Letters of other scripts that look like Latin ones, and digits or signs read as letters.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁɡαεικνορτυχ013457@$",
    "abekmhopctyxijsdgaeiknoptuxoieastas",
)
WORD = re.compile(r"[^\W_]+")
PREFIXES = range(4, 9)


def folded(text: str) -> list[str]:
    return WORD.findall(text.lower().translate(LOOKALIKES))


def entries_of(word: str) -> list[str]:
    """Lexicon entries a word can match: itself between blanks, and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if n < len(word))]


@dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)


@functools.cache
def automaton(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for entry, weight in model.lexicon:
        found.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        found.add_word(phrase, (len(phrase), 0.0))
    if len(found):
        found.make_automaton()
    return found


def hits(model: Model, text: str) -> dict[int, float]:
    """Weights by the place of the word hit in the folded ``text`` (blank before every word, one at the end)."""
    found = automaton(model)
    weights: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    if not len(found):
        return weights
    for end, (length, weight) in found.iter(text):
        at = end - length + 1
        if weight:
            weights[at] = max(weight, weights.get(at, 0.0))
        else:
            excused.append((at, end))
    for a, b in excused:
        for at in [x for x in weights if a <= x < b]:
            del weights[at]
    return weights


def features(model: Model, text: str | None) -> tuple[float, float]:
    words = folded(text or "")
    total = sum(hits(model, f" {' '.join(words)} ").values())
    return min(total, 30.0), min(100 * total / (len(words) + 50), 30.0)


def score(model: Model, text: str | None) -> float:
    a, b, c = model.curve
    x, y = features(model, text)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def evidence(toxic, clean, share: float):
    """Binomial log-likelihood ratio of the toxic share among documents with a feature."""
    n = toxic + clean
    p = F.col("toxic") / n
    part = lambda x, q: F.when(x > 0, x * F.log(x / n / q)).otherwise(0.0)
    return F.when(p > share, part(toxic, share) + part(clean, 1 - share)).otherwise(0.0)


def counted(texts: DataFrame, of_text) -> DataFrame:
    """``feature, toxic, clean``: documents of either label with each feature that ``of_text`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            made = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()),
                 pa.array([clean[n] for n in names], pa.int64())], ["feature", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return made

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (toxic if label else clean).update(of_text(text or ""))
                if len(toxic) + len(clean) > 500_000:
                    yield rows()
        yield rows()

    found = texts.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id",
          text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from at most ``sample`` labelled rows, drawn by a hash of the id.

    Rows with a null id or label are left out; an id labelled more than once counts once, as toxic if any
    label says so. Without labels of both kinds the model has no entries and scores every text alike, low.
    """
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(
        F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("toxic"))
    drawn = known.orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(sample)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(drawn), "id")
    # copies of a text are one witness, not many
    texts = materialize(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")
    sizes = texts.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    if not sizes.toxic or not sizes.clean:
        return Model()
    share = sizes.toxic / (sizes.toxic + sizes.clean)

    def weight(of: str):
        other = "clean" if of == "toxic" else "toxic"
        return F.log((F.col(of) + 0.5) / (sizes[of] + 1)) - F.log((F.col(other) + 0.5) / (sizes[other] + 1))

    words = counted(texts, lambda t: {e for w in set(folded(t)) for e in entries_of(w)})
    strong = words.select("feature", "toxic", weight("toxic").alias("weight"),
                          evidence(F.col("toxic"), F.col("clean"), share).alias("evidence")).where(
        (F.col("evidence") >= EVIDENCE) & (F.col("weight") >= 1.5))
    chosen = strong.orderBy(F.desc("evidence"), "feature").limit(ENTRIES).collect()
    weights = {r.feature: r.weight for r in chosen}
    # an entry says nothing new if a beginning of it weighs as much
    lexicon = tuple(sorted(
        (e, w) for e, w in weights.items()
        if not any(weights.get(e[:n], -9.0) >= w - 0.3 for n in range(2, len(e.rstrip())))))
    plain = Model(lexicon)

    def phrases(text: str) -> set[str]:
        line = f" {' '.join(folded(text))} "
        found = set()
        for at in hits(plain, line):
            end = line.index(" ", at + 1)
            if at:
                found.add(line[line.rindex(" ", 0, at):end + 1])
            if end + 1 < len(line):
                found.add(line[at:line.index(" ", end + 1) + 1])
        return found

    usual = counted(texts, phrases).where("clean >= 5").select("feature", "clean", weight("clean").alias("weight"))
    excused = usual.where("weight >= 1.0").orderBy(F.desc("clean"), "feature").limit(ENTRIES).collect()
    model = Model(lexicon, tuple(sorted(r.feature for r in excused)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(model, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in made], pa.float64()), pa.array([b for _, b in made], pa.float64()),
                 batch.column("toxic")], ["x", "y", "toxic"])

    # the sample's size bounds what comes to the driver
    points = texts.select("text", "toxic").mapInArrow(measure, "x double, y double, toxic int").toArrow()
    x = np.column_stack([np.ones(len(points)), points["x"].to_numpy(), points["y"].to_numpy()])
    return Model(model.lexicon, model.exceptions, fitted(x, points["toxic"].to_numpy().astype(float)))


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float, float]:
    """Logistic coefficients by Newton's method, weights other than the first held small."""
    w = np.zeros(x.shape[1])
    hold = penalty * np.diag([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def scored(docs: DataFrame, model: Model, text_column: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of every text, 0 to 1; a null text is the empty one.

    All columns are kept; a column named like the score is replaced. Rows stay where they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(model, t) for t in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    kept = docs.drop(column) if column != text_column else docs
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(column, DoubleType())]))
