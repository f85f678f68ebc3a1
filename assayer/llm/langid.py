"""Language identification by nearest centroid.

A text is a vector of hashed byte bigrams and trigrams of its lower-cased letters, weighted by TF-IDF and
scaled to length one. Each language has several centroids, found by spherical k-means over its labelled
texts; centroids whose members mostly carry another label are dropped, so mislabelled texts can't pull a
language over. A text takes the language of the centroid with the largest cosine and is rejected if its
distance is larger than that of the labelled texts of about its length, plus a margin. Where fewer than 20 labelled
texts are of about its length, the limit comes from the lengths that have as many: for a shorter text the nearest
one's least cosine scaled by the root of the lengths' ratio, as cosines of texts of few n-grams are, and else the most
lenient limit of all. Without any such length nothing is rejected for its distance.

Fitting reads a bounded sample of labelled rows: the `per_language` ids of each language with the smallest
hash (default 300), one row each. Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0 and is rejected; empty tables
predict nothing, and fitting without labelled rows gives a model that calls every text `und`; equal texts get
equal predictions; null labels, and rows without an id, aren't learnt from; of rows that share an id and a language one is learnt;
columns to keep that are called like a result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import one_text, smallest, spare, typed, without
from assayer.llm.text import LOWER, blocks, column, raw

DIM = 4096
PER_LANGUAGE = 300
CLUSTERS = 4
UNDETERMINED = "und"
_SHARPNESS = 20.0
_MARGIN = 0.1
_LEAST_SEEN = 20
#: Texts whose counts (DIM of them each) are held at once.
_ROWS = 256
#: ASCII bytes that are no letters count as space.
_LETTERS = LOWER.copy()
_LETTERS[:65] = 32
_LETTERS[91:97] = 32
_LETTERS[123:128] = 32


def counts(texts: pa.Array) -> np.ndarray:
    """n-gram counts, one row a text."""
    buf, offsets = raw(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = len(offsets) - 1
    out = np.zeros(n * DIM, np.int64)
    b = _LETTERS[buf].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offsets))
    for k, factor in ((2, 0x85EBCA6B), (3, 0x9E3779B1)):
        if len(b) < k:
            continue
        gram = b[: len(b) - k + 1].copy()
        for i in range(1, k):
            gram |= b[i : len(b) - k + 1 + i] << np.uint32(8 * i)
        ok = (doc[: len(gram)] == doc[k - 1 :]) & (gram != (0x202020 >> 8 * (3 - k)))
        h = (gram * np.uint32(factor)) >> np.uint32(20)
        out += np.bincount((doc[: len(gram)] + h)[ok], minlength=n * DIM)
    return out.reshape(n, DIM)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # index of each centroid's language
    floor: np.ndarray  # least cosine by log2 of the number of n-grams

    def vectors(self, c: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(c).astype(np.float32) * self.idf)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, distance, rejected) of each text."""
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
        lang, score, dist, rejected = [], [], [], []
        for a, b in blocks(texts, rows=_ROWS):
            c = counts(texts[a:b])
            known = letters[a:b]
            if not len(self.centroids):
                known = np.zeros(b - a, bool)
                best = np.zeros((b - a, 1), np.float32)
            else:
                cosine = self.vectors(c) @ self.centroids.T
                best = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
            top = best.argmax(axis=1)
            most = best[np.arange(len(top)), top].astype(float)
            share = 1 / np.exp(_SHARPNESS * (best - most[:, None])).sum(axis=1)
            size = np.minimum(np.log2(c.sum(axis=1) + 1).astype(int), len(self.floor) - 1)
            far = most < self.floor[size]
            lang += [self.languages[k] if ok else UNDETERMINED for k, ok in zip(top, known, strict=True)]
            score.append(np.where(known, share, 0.0))
            dist.append(np.where(known, 1 - most, 1.0))
            rejected.append(~known | far)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return lang, join(score, float), join(dist, float), join(rejected, bool)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts."""
    centres = [_unit(x.mean(axis=0))]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin((x @ np.array(centres).T).max(axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[near == i].mean(axis=0)) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def train(labels: list[str], c: np.ndarray, clusters: int = CLUSTERS) -> Model:
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], int)
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(languages, idf, np.zeros((0, DIM), np.float32), np.zeros(0, int), np.full(64, -1.0))
    if not len(c):
        return model
    x = model.vectors(c)
    centres, owner = [], []
    for k in range(len(languages)):
        own = _clusters(x[y == k], clusters)
        centres += list(own)
        owner += [k] * len(own)
    centres, owner = np.array(centres), np.array(owner)
    near = (x @ centres.T).argmax(axis=1)
    pure = np.array([np.bincount(y[near == i], minlength=len(languages)).argmax() == o if (near == i).any() else False for i, o in enumerate(owner)])
    for k in range(len(languages)):  # a language keeps one centroid at least
        if not pure[owner == k].any():
            pure[np.flatnonzero(owner == k)[0]] = True
    model.centroids, model.owner = centres[pure].astype(np.float32), owner[pure]
    most = (x @ model.centroids.T).max(axis=1)
    size = np.log2(c.sum(axis=1) + 1).astype(int)
    filled = []
    for s in range(len(model.floor)):
        seen = most[np.abs(size - s) <= 1]
        if len(seen) >= _LEAST_SEEN:
            model.floor[s] = seen.min() - _MARGIN
            filled.append(s)
    for s in range(len(model.floor)):
        if filled and s not in filled:
            model.floor[s] = model.floor[filled[0]] * 2.0 ** ((s - filled[0]) / 2) if s < filled[0] else model.floor[filled].min()
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS) -> Model:
    """Learns from the bounded sample of the labelled rows given."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    chosen, _ = smallest(rows, "lang", per_language)
    rows = one_text(rows, chosen, "id", "lang")

    def run(batches):
        for batch in batches:
            for a, b in blocks(column(batch, "text"), rows=_ROWS):
                part = batch.slice(a, b - a)
                c = [np.stack([at := np.flatnonzero(x), x[at]]).astype(np.uint32).tobytes() for x in counts(column(part, "text"))]
                yield pa.RecordBatch.from_arrays([column(part, "id").cast(pa.string()), column(part, "lang"), pa.array(c, pa.binary())], names=["id", "lang", "counts"])

    got = sorted(rows.mapInArrow(run, "id string, lang string, counts binary").collect())
    c = np.zeros((len(got), DIM), np.uint32)
    for row, r in zip(c, got, strict=True):
        at, n = np.frombuffer(r.counts, np.uint32).reshape(2, -1)
        row[at] = n
    return train([r.lang for r in got], c, clusters)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, lang_pred, score, distance and rejected of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    outs = ["lang_pred", "score", "distance", "rejected"]
    keep = without(keep, *outs)
    own = spare(keep, "text")
    chosen = docs.select(*keep, F.col(text).alias(own))

    def run(batches):
        for b in batches:
            lang, score, dist, rejected = held.value.predict(column(b, own))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(dist), pa.array(rejected)], names=[*keep, *outs])

    return chosen.mapInArrow(run, typed(docs, keep, "lang_pred string", "score double", "distance double", "rejected boolean"))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            rejected = held.value.predict(column(b, text))[3]
            yield b.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
