"""Quality scores: hashed word n-gram logistic regression trained with FTRL, scored as sparse dot products.

Texts are read as words and as runs of symbols between them. The n-grams are single words and pairs in lower
case, and pairs and triples of word shapes (capitals, capitalised, lower, digits, and each symbol run as
itself), all hashed into one space; a text is its n-gram counts divided by their number.

Fitting reads a bounded sample of labelled rows, `per_class` of each class (default 2000), weighted back to the
shares of the classes; the weights are 10 on average, so prior and regularisation don't depend on the number of
labelled rows. Of a learnt row at most `linear.MOST_FEATURES` distinct n-grams are used, picked by hash. Scoring reads every whole text.

Defined cases: null and empty texts have no n-grams and get the bias as their score; equal texts get equal scores;
without labelled rows every score is 0.5; empty tables give empty results; labels without an id or a value aren't learnt, an id that is
labelled repeatedly counts once, and of documents that share an id one is learnt; columns to keep called score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm import linear
from assayer.llm.text import LOWER, NON_WORD, SPACES, U64, Grams, Words, gram_starts, raw, spans_hash, prefix_sums, mix

DIM = 1 << 18
PER_CLASS = 2000
THRESHOLD = 0.3
SCALE = 8.0
MEAN_WEIGHT = 10.0
_BASE = 0xC2B2AE3D27D4EB4F
_KIND = np.where(SPACES, 0, np.where(NON_WORD, 2, 1)).astype(np.uint8)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words and symbol runs of the texts, their hashes in lower case, and their shapes."""
    buf, offsets = raw(texts)
    kind = _KIND[buf]
    fresh = np.ones(len(buf), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[offsets < len(buf)]] = True
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(buf))
    told = kind[starts] > 0
    starts, ends = starts[told], ends[told]
    h = spans_hash(prefix_sums(LOWER[buf].astype(U64) + U64(1), _BASE), starts, ends, _BASE)
    upper, digit = (np.concatenate([[0], np.cumsum(x[buf])]) for x in (_UPPER, _DIGIT))
    n = ends - starts
    ups = upper[ends] - upper[starts]
    shape = np.where(ups == 0, 1, np.where((ups == 1) & _UPPER[buf[starts]] if len(starts) else ups == 1, 2, np.where(ups == n, 3, 4))).astype(U64)
    shape = np.where(digit[ends] - digit[starts] == n, U64(5), shape)
    shape = mix(np.where(kind[starts] == 2, h, shape))
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets)), h, shape


def ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hashed n-gram) of every n-gram, and the number of texts."""
    w, h, shape = tokens(texts)
    doc, grams, shapes = w.doc, Grams(h), Grams(shape, 1)
    out = [(doc, h)]
    for of, k in ((grams, 2), (shapes, 2), (shapes, 3)):
        at = gram_starts(w.first, k)
        out.append((doc[at], of.spans(at, at + k)))
    d = np.concatenate([x for x, _ in out])
    return d, (np.concatenate([x for _, x in out]) % U64(DIM)).astype(np.int64), len(w.first) - 1


def features(texts: pa.Array) -> list[bytes]:
    d, i, n = ids(texts)
    key, c = np.unique(d * DIM + i, return_counts=True)
    at = np.searchsorted(key, np.arange(n + 1) * DIM)
    out = []
    for a, b in zip(at, at[1:], strict=False):
        few = linear.few(index := key[a:b] % DIM)
        out.append(np.concatenate([index[few], c[a:b][few]]).astype(np.int32).tobytes())
    return out


def score(texts: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    d, i, n = ids(texts)
    total = np.bincount(d, weights=model[0][i], minlength=n)
    return linear.sigmoid(model[1] + SCALE * total / np.maximum(np.bincount(d, minlength=n), 1))


def examples(rows: list, share: dict[int, float]) -> list[linear.Example]:
    out = []
    for r, weight in zip(rows, linear.weights([r.label for r in rows], share, MEAN_WEIGHT), strict=True):
        x = np.frombuffer(r.x, np.int32).reshape(2, -1)
        out.append(linear.Example(x[0].astype(np.int64), SCALE * x[1] / max(1, x[1].sum()), int(r.label > 0), weight))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS, epochs: int = 5) -> tuple[np.ndarray, float]:
    rows, share = linear.sampled(docs, labels, label, per_class, text, doc_id)
    return train(linear.features_of(rows, features), share, epochs)


def train(rows: list, share: dict[int, float], epochs: int = 5) -> tuple[np.ndarray, float]:
    return linear.train(examples(rows, share), DIM, epochs, alpha=0.5, l1=0.002, l2=0.01)


def scores(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    return linear.scored(docs, score, docs.sparkSession.sparkContext.broadcast(model), text, keep, threshold)
