"""Document quality by Bradley-Terry pairwise ranking.

A document labelled good is preferred to one labelled bad. The chance that x is
preferred to y is the logistic function of w . (f(x) - f(y)) over text features, so the
loss sees feature differences only and a document's score is w . f. Documents pass above
a quantile of the training scores, the one that separates the labelled sample best.

Scores are mapped to 0..1 so that the quantile falls on THRESHOLD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.features import NAMES, text_features

THRESHOLD = 0.3
#: The model is fitted on so many labelled documents or so, a sample by a hash of doc_id.
MAX_LABELLED = 20_000
PAIRS_PER_DOCUMENT = 12


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        raw = (expanded(features) - self.mean) / self.spread @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def expanded(features: np.ndarray) -> np.ndarray:
    """The features with their square roots and steps, so that a linear score can bend."""
    return np.concatenate([features, np.sqrt(features), np.minimum(1, features * 10)], axis=1)


def fit(features: np.ndarray, good: np.ndarray, seed: int = 7) -> QualityModel:
    """The ranking fitted on labelled rows; with one label only, all rows score alike."""
    x = expanded(features) if len(features) else np.zeros((0, 3 * len(NAMES)))
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return QualityModel(mean, spread, np.zeros(x.shape[1]), 1.0 if len(down) else -1.0)
    z = (x - mean) / spread
    rng = np.random.default_rng(seed)
    winners = rng.choice(up, PAIRS_PER_DOCUMENT * len(x))
    losers = rng.choice(down, PAIRS_PER_DOCUMENT * len(x))
    weights, ridge = np.zeros(x.shape[1]), 1e-3 * len(winners)
    grad = np.zeros_like(weights)
    for _ in range(12):  # Newton steps on the pairwise logistic loss, in blocks of pairs
        grad, hess = ridge * weights, ridge * np.eye(len(weights))
        for at in range(0, len(winners), 50_000):
            diff = z[winners[at : at + 50_000]] - z[losers[at : at + 50_000]]
            miss = 1 / (1 + np.exp(np.clip(diff @ weights, -40, 40)))
            grad -= diff.T @ miss
            hess += (diff * (miss * (1 - miss))[:, None]).T @ diff
        step = np.linalg.solve(hess, grad)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weights
    order = np.sort(raw)
    cuts = np.unique(np.quantile(order, np.linspace(0, 1, 401)))
    middles = np.concatenate([[order[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [order[-1] + 1]])
    recall_up = 1 - np.searchsorted(np.sort(raw[up]), middles) / len(up)
    recall_down = np.searchsorted(np.sort(raw[down]), middles) / len(down)
    accuracy = (recall_up * len(up) + recall_down * len(down)) / len(x)
    return QualityModel(mean, spread, weights, float(middles[np.argmax(accuracy + 0.2 * (recall_up + recall_down))]))


def bounded_labels(labels: DataFrame, column: str, bound: int = MAX_LABELLED, fold: int = 5) -> DataFrame:
    """(doc_id, label) of the training folds, `bound` rows or so.

    Rows whose crc32 of doc_id modulo `fold` is 0 are held out. The least label stands
    for a doc_id that has several; null ids and labels are left out.
    """
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string")) % fold != 0)
    total = rows.count()
    if total > bound:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * bound / total))
    return rows


def _labelled_features(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_features(batch.column("text"))
            yield pa.record_batch([batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "features"])

    sample = bounded_labels(labels, "quality")
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    rows = joined.mapInArrow(run, "label int, features array<double>").toArrow()
    if not rows.num_rows:
        return np.zeros((0, len(NAMES))), np.zeros(0, np.int64)
    features = np.array(rows.column("features").to_pylist())
    order = np.lexsort((*features.T, rows.column("label").to_numpy()))  # whatever order tasks end in
    return features[order], rows.column("label").to_numpy()[order]


def trained(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model of labels (doc_id, quality) over docs (doc_id, text), held-out rows left out.

    The sample is bounded, so its rows are broadcast and its features collected.
    """
    return fit(*_labelled_features(docs, labels))


def scored(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """`docs` with the score of each row's whole text (double, 0 to 1); null texts count as empty.

    A column of `docs` that is called `name` is replaced. Other columns, rows that repeat
    and null ids pass as they are; an empty table stays empty.
    """
    names = [c for c in docs.columns if c != name]
    frame = docs.select([F.col(f"`{c}`") for c in names])
    schema = StructType([*frame.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                scores = pa.array(model.scores(text_features(part.column(names.index("text")))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*names, name])

    return frame.mapInArrow(run, schema)
