"""Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import one_text, smallest, spare, typed, without
from assayer.llm.text import U64, blocks, column, mix

#: Distinct n-grams that one learnt row is held to at most, so that the sample's size in memory doesn't depend on its longest texts. Scores read all.
MOST_FEATURES = 8192


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Example:
    index: np.ndarray
    value: np.ndarray
    label: int
    weight: float = 1.0
    #: The same example with its identity terms swapped, if it has any.
    swapped: tuple[np.ndarray, np.ndarray] | None = None


class Ftrl:
    """Per-coordinate FTRL-proximal; coordinate `dim` is the bias."""

    def __init__(self, dim: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.dim, self.alpha, self.beta, self.l1, self.l2 = dim, alpha, beta, l1, l2
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(np.asarray(i) == self.dim, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, i: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        n = self.n[i]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] = n + g * g

    def learn(self, e: Example, pull: float = 0.0) -> None:
        """One example; `pull` weighs the squared difference between its score and that of its swapped form.

        Both parts of the loss make one step: coordinates that both forms share get the gradient of the label alone.
        """
        i, x = np.append(e.index, self.dim), np.append(e.value, 1.0)
        if not pull or e.swapped is None:
            w = self.weights(i)
            self.step(i, (sigmoid(w @ x) - e.label) * x * e.weight, w)
            return
        j, y = np.append(e.swapped[0], self.dim), np.append(e.swapped[1], 1.0)
        both, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        own, other = np.zeros(len(both)), np.zeros(len(both))
        own[at[: len(i)]], other[at[len(i) :]] = x, y
        w = self.weights(both)
        s = w @ own
        self.step(both, e.weight * ((sigmoid(s) - e.label) * own + pull * (s - w @ other) * (own - other)), w)

    def model(self) -> tuple[np.ndarray, float]:
        w = self.weights(np.arange(self.dim + 1))
        return w[:-1].astype(np.float32), float(w[-1])


def train(examples: list[Example], dim: int, epochs: int, pull: float = 0.0, **args) -> tuple[np.ndarray, float]:
    learner = Ftrl(dim, **args)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            learner.learn(examples[k], pull)
    return learner.model()


def sampled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, float]]:
    """(id, label, text) of a bounded sample: of each class the `per_class` labelled ids with the smallest hash; and the share of each class that it holds.

    Null ids and labels are left out; an id that is labelled repeatedly counts once, by its largest label; of documents that share an id one is learnt.
    """
    each = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    chosen, totals = smallest(each, "label", per_class)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return one_text(rows, chosen, "id", "label"), {k: min(1.0, per_class / n) for k, n in totals.items()}


def weights(labels: list[int], share: dict[int, float], mean: float = 1.0) -> np.ndarray:
    """The weight of each sampled row: in proportion to the rows of its class that it stands for, and `mean` on average."""
    w = np.array([1 / share[x] for x in labels])
    return w * mean / w.mean() if len(w) else w


def few(index: np.ndarray, most: int = MOST_FEATURES) -> np.ndarray:
    """Which hashed n-grams of a row are learnt: all, or the `most` with the smallest hash of the hash."""
    if len(index) <= most:
        return np.ones(len(index), bool)
    h = mix(index.astype(U64) + U64(1))
    return h <= np.partition(h, most - 1)[most - 1]


def features_of(rows: DataFrame, features) -> list:
    """Collects (id, label, features) of the bounded sample, by id; `features` maps texts to one bytes object each."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(column(batch, "text")):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([column(part, "id").cast(pa.int64()), column(part, "label"), pa.array(features(column(part, "text")), pa.binary())], names=["id", "label", "x"])

    return sorted(rows.mapInArrow(run, "id bigint, label int, x binary").collect())


def scored(docs: DataFrame, score, held, text: str, keep: tuple[str, ...], threshold: float) -> DataFrame:
    """The `keep` columns, score and predicted of every row; `score` maps a block of texts and the broadcast model to scores.

    Columns to keep that are called score or predicted are replaced.
    """
    keep = without(keep, "score", "predicted")
    own = spare(keep, "text")
    chosen = docs.select(*keep, F.col(text).alias(own))

    def run(batches):
        for batch in batches:
            texts = column(batch, own)
            parts = [score(texts[a:b], held.value) for a, b in blocks(texts)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return chosen.mapInArrow(run, typed(docs, keep, "score double", "predicted int"))
