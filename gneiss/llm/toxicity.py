"""Toxicity scores from a counterfactual-regularised logistic model over the words of a text and their beginnings.

Training rows come from the label table. Each has several counterfactuals: its identity terms are swapped for others of
the same group and left out, or, where a text has none, one is added, so that they differ from the text in nothing that
should matter.
The loss adds the mean squared difference of their scores to the text's, so weights move away from identity terms and
mere mentions of a group don't raise a score. An L1 step keeps only words that carry evidence; long clean texts therefore
don't add up noise. Beginnings (the first four and five bytes) let inflected and compound forms of a word share a weight.
Last the bias is moved so that THRESHOLD lies in the middle of the gap that parts the training rows best.

The model is fitted on at most SAMPLE distinct texts of each class, drawn by a hash of the text, at any size of input.
Tasks count their features; those with evidence are the model's, and the driver, which takes the gradient steps, gets the
sample as numbers of these features, never words of texts. Neither sample nor fit depends on doc_ids but for the rows held
out. Scoring streams whole texts past the model without a shuffle.

Defined results: a null or empty text has the score of the bias alone; null labels aren't learnt from; a null doc_id
counts as not held out; a text with rows of both labels is learnt from in each class; without labels of both classes
every score is 0.5 or below; repeated rows count as often as they are labelled and score alike; other columns are not carried by toxicity_scores and untouched by
keep_clean.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import drop_written, giving_back, read_table, written
from gneiss.llm.tokenizer import text_blocks

#: Training rows of each class; texts are read whole, in the fit and in scoring.
SAMPLE = 4000
#: A feature has to occur in so many training rows, with class shares so many standard errors apart.
MIN_ROWS, MIN_Z = 3, 4.0
THRESHOLD = 0.7
#: Counterfactuals of each training row.
VARIANTS = 3
#: Terms within a group may replace each other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "bisexuelle", "transsexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "transexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitados", "sordos", "ciegos"),
)
_GROUP = {t.encode(): ([x.encode() for x in group], i) for group in IDENTITY_GROUPS for i, t in enumerate(group)}
_TERMS = sorted(_GROUP)
#: Letters, digits and all bytes of non-ASCII characters stay, upper case folded; the rest parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_FOLD).split())


def counterfactual(found: list[bytes], variant: int) -> list[bytes]:
    """found with its identity terms swapped (the last variant: left out), or with one more, chosen by the words."""
    if not _GROUP.keys().isdisjoint(found):
        if variant == VARIANTS - 1:
            return [w for w in found if w not in _GROUP]
        step = crc32(b" ".join(found)) + variant
        swap = lambda w, group, i: group[(i + 1 + step % (len(group) - 1)) % len(group)]
        return [swap(w, *_GROUP[w]) if w in _GROUP else w for w in found]
    return [*found, _TERMS[(crc32(b" ".join(found)) + variant * (len(_TERMS) // VARIANTS)) % len(_TERMS)]]


#: Feature kinds by length of the beginning; 0 is the whole word.
KINDS = (0, 4, 5)


@dataclass
class Model:
    bias: float
    #: Weights by kind.
    weights: dict[int, dict[bytes, float]]

    def score(self, text: bytes) -> float:
        found, total = words(text), self.bias
        for kind, w in self.weights.items():
            total += sum(sorted(w[x] for x in ({x[:kind] for x in found} if kind else found) & w.keys()))
        return float(1.0 / (1.0 + np.exp(-min(max(total, -30.0), 30.0))))


def features(found: Iterable[bytes]) -> set[tuple[int, bytes]]:
    return {(kind, w[:kind] if kind else w) for w in found for kind in KINDS}


#: A training row: the columns of its features, and for each variant those that its counterfactual has more and less.
Encoded = tuple[list[int], list[tuple[list[int], list[int]]]]


def encoded(found: list[bytes], column: dict[tuple[int, bytes], int]) -> Encoded:
    known = lambda f: sorted(column[x] for x in f if x in column)
    own, changes = features(found), []
    for v in range(VARIANTS):
        other = features(counterfactual(found, v))
        changes.append((known(other - own), known(own - other)))
    return known(own), changes


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of a matrix of zeros and ones."""
    sizes = [len(r) for r in rows]
    return np.fromiter((c for r in rows for c in r), np.int32, sum(sizes)), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)


def _evidence(rows: list[np.ndarray], toxic: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """How many standard errors each feature's shares in the two classes lie apart; 0 for rare ones."""
    at, of = np.concatenate([*rows, np.zeros(0, np.int32)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    counts = [np.bincount(at, (weights * (toxic == label))[of], size) for label in (0, 1)]
    n = [weights[toxic == label].sum() for label in (0, 1)]
    share = (counts[0] + counts[1]) / sum(n)
    z = (counts[1] / n[1] - counts[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n[0] + 1 / n[1]))
    return np.where(counts[0] + counts[1] >= MIN_ROWS, np.abs(z), 0)


def _columns(chosen: Iterable[tuple[int, bytes]]) -> dict[tuple[int, bytes], int]:
    """The model's features, numbered: those with evidence and all of identity terms."""
    return {f: i for i, f in enumerate(sorted(set(chosen) | features(_TERMS)))}


def fit(rows: Iterable[list[bytes]], toxic: np.ndarray, weights: np.ndarray | None = None, **options) -> Model:
    """The model of rows in this process. A row is the list of its distinct words, and its weight says how often it counts."""
    rows, toxic = list(rows), np.asarray(toxic, float)
    weights = np.ones(len(toxic)) if weights is None else np.asarray(weights, float)
    number: dict[tuple[int, bytes], int] = {}
    own = [np.array([number.setdefault(f, len(number)) for f in features(r)], np.int64) for r in rows]
    chosen: list[tuple[int, bytes]] = []
    if len(set(toxic.tolist())) == 2:
        z = _evidence(own, toxic, weights, len(number))
        chosen = [f for f, i in number.items() if z[i] >= MIN_Z]
    column = _columns(chosen)
    return solve([encoded(r, column) for r in rows], column, toxic, weights, **options)


def solve(rows: list[Encoded], column: dict[tuple[int, bytes], int], toxic: np.ndarray, weights: np.ndarray, penalty: float = 10.0, l1: float = 5e-4, steps: int = 400) -> Model:
    """Accelerated proximal gradient descent on balanced log loss + penalty * mean squared score change + l1 * |weights|; the mean is over rows and variants."""
    n, whole, positive = len(toxic), weights.sum(), (weights * toxic).sum()
    if not n or positive in (0, whole):
        return Model(0.0 if positive and positive == whole else -2.0, {})
    # A matrix as its columns, rows and values; a counterfactual as what it adds to its row's sum.
    at, of = _matrix([own for own, _ in rows])
    base = at, of, np.ones(len(at), np.float32)
    deltas = []
    for v in range(VARIANTS):
        (more, more_of), (less, less_of) = (_matrix([changes[v][i] for _, changes in rows]) for i in (0, 1))
        deltas.append((np.concatenate([more, less]), np.concatenate([more_of, less_of]), np.repeat(np.array([1, -1], np.float32), [len(more), len(less)])))
    share = weights * np.where(toxic == 1, 0.5 / positive, 0.5 / (whole - positive))
    weight = penalty * weights / whole / len(deltas)

    def times(m, w):
        return np.bincount(m[1], m[2] * w[m[0]], n)

    def back(m, g):
        return np.bincount(m[0], m[2] * g[m[1]], len(column))

    # The largest curvature, by power iteration, gives the step.
    x = np.ones(len(column) + 1)
    for _ in range(30):
        x /= np.linalg.norm(x)
        on_base, on_delta = 0.25 * share * (x[0] + times(base, x[1:])), np.zeros(len(column))
        for m in deltas:
            on_delta += back(m, weight * 0.25 * times(m, x[1:]))
        x = np.concatenate([[on_base.sum()], back(base, on_base) + on_delta])
    step = 0.9 / np.linalg.norm(x)
    w = v = np.zeros(len(column))
    b = vb = 0.0
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    for i in range(steps):
        logits = vb + times(base, v)
        s = sigmoid(logits)
        g_base, g = share * (s - toxic), np.zeros(len(column))
        for m in deltas:
            c = sigmoid(logits + times(m, v))
            change = 2 * weight * (s - c)
            # The counterfactual's sum is the row's and its own change, so its gradient reaches both.
            g_base += change * (s * (1 - s) - c * (1 - c))
            g -= back(m, change * c * (1 - c))
        g += back(base, g_base)
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = vb - step * g_base.sum()
        v, vb = new + i / (i + 3) * (new - w), new_b + i / (i + 3) * (new_b - b)
        w, b = new, new_b
    b += np.log(THRESHOLD / (1 - THRESHOLD)) - _cut(b + times(base, w), toxic, weights)
    return Model(float(b), {k: {x: float(w[i]) for (kind, x), i in column.items() if kind == k and w[i]} for k in KINDS})


def _cut(logits: np.ndarray, toxic: np.ndarray, weights: np.ndarray, clean_weight: float = 3.0) -> float:
    """The logit that parts the classes best, a wrongly rejected share of clean rows counting clean_weight times; in the middle of its gap."""
    order = np.argsort(logits, kind="stable")
    z, clean, bad = logits[order], (weights * (1 - toxic))[order], (weights * toxic)[order]
    gain = clean_weight * np.cumsum(clean) / clean.sum() - np.cumsum(bad) / bad.sum()
    apart = np.flatnonzero(np.diff(z) > 1e-9)
    if not len(apart):
        return float(z[-1]) + 1.0
    best = apart[gain[apart] >= gain[apart].max() - 1e-9]
    i = best[np.argmax(z[best + 1] - z[best])]
    return float(z[i] + z[i + 1]) / 2


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most sample distinct texts of each class, of rows whose doc_id isn't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash")).join(known, "_id").groupBy("_toxic", "_hash").agg(F.count(F.lit(1)).alias("_times"))
    chosen = [hashed.filter(F.col("_toxic") == t).orderBy("_hash").limit(sample) for t in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    columns = ["_toxic", "_hash", "_times"]

    def distinct(batches):
        for batch in batches:
            found = [b" ".join(sorted(words(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.binary())], [*columns, "words"])

    # One row for each class and text, so at most 2 * sample however often a text repeats.
    rows = docs.select(F.xxhash64(text).alias("_hash"), text.alias("text")).join(chosen, "_hash").dropDuplicates(["_toxic", "_hash"]).select(*columns, "text")
    rows = written(rows.mapInArrow(giving_back(distinct), "_toxic int, _hash long, _times long, words binary"), "toxicity-sample", batch=200)

    def few(batches):
        """Not many whole texts' features at a time."""
        for batch in batches:
            yield from (batch.slice(a, 100) for a in range(0, batch.num_rows, 100))

    def counted(batches):
        for batch in few(batches):
            for label, times, w in zip(*(batch.column(c).to_pylist() for c in ("_toxic", "_times", "words")), strict=True):
                kinds, names = zip(*features(w.split()), strict=True) if w else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.binary()), pa.array([label] * len(names), pa.int32()), pa.array([times] * len(names), pa.int64())], ["kind", "name", "label", "times"])

    n = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.sum("_times").alias("n")).collect()}
    chosen = []
    if len(n) == 2:
        counts = [F.coalesce(F.sum(F.when(F.col("label") == t, F.col("times"))), F.lit(0)).cast("double").alias(f"n{t}") for t in (0, 1)]
        found = rows.mapInArrow(giving_back(counted), "kind int, name binary, label int, times long").groupBy("kind", "name").agg(*counts).filter(F.col("n0") + F.col("n1") >= MIN_ROWS)
        part = (F.col("n0") + F.col("n1")) / sum(n.values())
        z = F.abs(F.col("n1") / n[1] - F.col("n0") / n[0]) / F.sqrt(F.greatest(part * (1 - part), F.lit(1e-9)) * (1 / n[0] + 1 / n[1]))
        chosen = [(r["kind"], bytes(r["name"])) for r in found.filter(z >= MIN_Z).select("kind", "name").toLocalIterator()]
    column = _columns(chosen)
    sent = rows.sparkSession.sparkContext.broadcast(column)
    lists = pa.list_(pa.int32())

    def numbered(batches):
        for batch in few(batches):
            found = [encoded(w.split(), sent.value) for w in batch.column("words").to_pylist()]
            changes = [pa.array([c[v][i] for _, c in found], lists) for v in range(VARIANTS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([own for own, _ in found], lists), *changes], [*columns, "own", *(f"c{i}" for i in range(2 * VARIANTS))])

    known = rows.mapInArrow(giving_back(numbered), ", ".join(["_toxic int, _hash long, _times long, own array<int>", *(f"c{i} array<int>" for i in range(2 * VARIANTS))])).orderBy("_hash", "_toxic").toArrow().to_pydict()
    drop_written(rows)
    changes = [[(known[f"c{2 * v}"][i], known[f"c{2 * v + 1}"][i]) for v in range(VARIANTS)] for i in range(len(known["own"]))]
    return solve(list(zip(known["own"], changes, strict=True)), column, np.array(known["_toxic"], float), np.array(known["_times"], float))


def _scores(batch: pa.RecordBatch, model: Model) -> list[float]:
    texts = batch.column("text").cast(pa.string()).cast(pa.binary())
    return [model.score(t or b"") for a, b in text_blocks(texts) for t in texts.slice(a, b - a).to_pylist()]


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score for each row of docs."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(_scores(batch, model), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(giving_back(run), "doc_id long, held_out boolean, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in _scores(batch, model)], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
