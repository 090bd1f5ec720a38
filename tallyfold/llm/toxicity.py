"""Toxicity from confirmed toxic texts and unlabelled ones: non-negative positive-unlabelled learning.

A linear classifier on hashed words is trained in numpy on the non-negative
risk estimator (Kiryo et al. 2017): with class prior p, positives P and
unlabelled U, the risk is p E_P[loss(+)] + max(0, E_U[loss(-)] - p E_P[loss(-)]).
No text is taken as clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .shared import map_batches

#: features: words hashed to so many bits
BITS = 20
#: bounds of the sample of labelled rows that the classifier is fitted on
MAX_POSITIVES = 6_000
MAX_UNLABELLED = 18_000
#: and of the feature values they hold together; fewer rows are drawn if they are long
MAX_VALUES = 8_000_000
ROUNDS = 200
RATE = 0.05
DECAY = 3e-5
#: a word must occur in positive texts more often than in unlabelled ones by so many standard errors
LEAST_Z = 2.0
THRESHOLD = 0.3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of every text, and the first place of each text (one more than texts)."""
    hashes, starts = tokens.words(texts)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
    both = np.unique(owner << np.uint64(BITS) | hashes >> np.uint64(64 - BITS))
    owner = (both >> np.uint64(BITS)).astype(np.int64)
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(owner, np.arange(len(starts)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _sigmoid(_sums(self.weights[words], starts) + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text, added up in the order of its words: the last digit does not depend on the rest of the batch."""
    return np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), weights=values, minlength=len(starts) - 1)


def _texts_with(rows: list[np.ndarray]) -> np.ndarray:
    """For each word in how many of the texts it occurs."""
    out = np.zeros(1 << BITS)
    for at in range(0, len(rows), 1000):
        words = np.concatenate(rows[at : at + 1000])
        out += np.bincount(words, minlength=1 << BITS)
    return out


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """The classifier of least non-negative risk; without positives every score is 0."""
    if not positive or not 0 < prior < 1:
        always = 60.0 if positive and prior >= 1 else -60.0
        return Model(np.zeros(1 << BITS, dtype=np.float32), always, prior)
    unlabelled = unlabelled or positive
    expected = _texts_with(unlabelled) * (len(positive) / len(unlabelled))
    excess = _texts_with(positive) - expected
    used = np.flatnonzero(excess >= LEAST_Z * np.sqrt(expected + 1))
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    # only the words that are used are held together
    rows = [n[n >= 0] for n in (number[r] for r in (*positive, *unlabelled))]
    local = np.concatenate(rows)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(starts))
    is_p = np.arange(len(rows)) < len(positive)
    n_p, n_u = len(positive), len(unlabelled)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        z = _sums(w[local], starts) + b
        s = _sigmoid(z)
        # logistic loss: d loss(+) / dz = s - 1, d loss(-) / dz = s
        negative = np.logaddexp(0, z)
        rest = negative[~is_p].mean() - prior * negative[is_p].mean()
        rest_slope = np.where(is_p, -prior * s / n_p, s / n_u)
        if rest >= 0:
            slope = np.where(is_p, prior * (s - 1) / n_p, 0.0) + rest_slope
        else:
            slope = -rest_slope  # the estimate went below zero, which no risk can: step back
        g = np.bincount(local, weights=slope[owner], minlength=len(w)) + DECAY * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / up) / (np.sqrt(v / down) + 1e-6)
        b -= RATE * (mb / up) / (np.sqrt(vb / down) + 1e-6)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[used] = w
    return Model(weights, float(b), prior)


def held_out(doc: str = "doc_id"):
    """Rows never trained on: crc32 of the id as text leaves 2 modulo 4; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc}`").cast("string")), F.lit(4)) == 2, F.lit(False))


def _featurise(batches):
    for batch in batches:
        for piece in tokens.slices(batch, "text"):
            words, starts = features(piece.column("text"))
            rows = [words[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.record_batch([piece.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "words"])


def train(
    documents: DataFrame,
    labels: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    prior: float | None = None,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
    max_values: int = MAX_VALUES,
) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    Positives are rows labelled 1; the unlabelled sample is drawn from all rows,
    and their labels are not used. Both are the rows with the least hash of the
    id, at most ``max_positives`` and ``max_unlabelled``, fewer if their texts hold
    more than ``max_values`` distinct words together. ``prior`` defaults to the
    share of positives among all labels that are not held out.

    An id labelled twice counts as toxic if one label says so; null labels and
    null ids are left out; of several texts with one id one is taken.
    """
    spark = documents.sparkSession
    marked = labels.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{label}`").alias("label"))
    marked = marked.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0)).alias("p")).first()
    prior = prior if prior is not None else (counts["p"] / counts["n"] if counts["n"] else 0.0)
    place = F.xxhash64("doc_id")
    drawn = lambda rows, most: rows.orderBy(place, "doc_id").limit(most).select("doc_id")
    positives = drawn(marked.filter("label = 1"), max_positives).withColumn("positive", F.lit(True))
    sample = positives.unionAll(drawn(marked, max_unlabelled).withColumn("positive", F.lit(False)))
    chosen = [(r["doc_id"], r["positive"]) for r in sample.collect()]
    ids = sorted({i for i, _ in chosen})
    if not ids:
        return fit([], [], prior)
    # at most max_positives + max_unlabelled ids: a bounded table, so documents need no shuffle
    wanted = spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("doc_id", labels.schema[doc].dataType)]))
    narrow = documents.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    narrow = narrow.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_id", "text")
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("words", T.BinaryType())])
    hashed = map_batches(narrow, _featurise, schema).groupBy("doc_id").agg(F.min("words").alias("words"))
    held, values = {}, 0
    for row in hashed.withColumn("place", place).orderBy("place").toLocalIterator():
        values += len(row["words"]) // 4
        if values > max_values and held:
            break
        held[row["doc_id"]] = np.frombuffer(row["words"], dtype=np.int32)
    of = lambda wanted: [held[i] for i, positive in chosen if positive == wanted and i in held]
    return fit(of(True), of(False), prior)


def _scorer(shared, text: str, below: float | None):
    """Rows with a score instead of the text; or, given a limit, whole rows that score below it."""

    def run(batches):
        model = shared.value
        for batch in batches:
            for piece in tokens.slices(batch, text):
                scores = model.scores(*features(piece.column(text)))
                if below is not None:
                    yield piece.filter(pa.array(scores < below))
                    continue
                names = [c for c in piece.schema.names if c != text]
                yield pa.record_batch([*[piece.column(c) for c in names], pa.array(scores)], names=[*names, "score"])

    return run


def score(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Only the text is scored, whole; null and empty texts get the score of a
    text without words. Repeated rows are scored each; an empty table gives an
    empty one; other columns are ignored. One pass, no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    narrow = documents.select(
        F.col(f"`{doc}`").alias("doc_id"), held_out(doc).alias("held_out"), F.col(f"`{text}`").alias("text")
    )
    fields = [narrow.schema["doc_id"], narrow.schema["held_out"], T.StructField("score", T.DoubleType())]
    scored = map_batches(narrow, _scorer(shared, "text", None), T.StructType(fields))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, whole, whose text scores below ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return map_batches(documents, _scorer(shared, text, threshold), documents.schema)
