"""Toxicity scores by a counterfactual-regularised classifier.

The model is a logistic regression on the presence of hashed words, word pairs and stems (the first bytes of longer
words, which catches inflected forms). Where a labelled text names an
identity group, its terms are swapped for another term of the same kind (words, pairs and stems alike), and training penalises the
squared difference between both scores; a mention alone then carries no weight, which spares neutral texts about groups.

Fitting reads a bounded sample of labelled rows, `per_class` of each class (default 3000), weighted back to the shares
of the classes; the weights are 1 on average, so prior and regularisation don't depend on the number of labelled rows.
Of a learnt row at most `linear.MOST_FEATURES` distinct n-grams are used, picked by hash. Scoring reads every whole text.

Defined cases: null and empty texts get the bias as their score; equal texts get equal scores; without labelled rows
every score is 0.5; empty tables give empty results; labels without an id or a value aren't learnt, an id that is labelled repeatedly
counts once, and of documents that share an id one is learnt; columns to keep called score or predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from assayer.llm import linear
from assayer.llm.text import NON_WORD, U64, Grams, gram_starts, mix, prefix_sums, raw, spans_hash, words

DIM = 1 << 20
PER_CLASS = 3000
THRESHOLD = 0.3
PULL = 1.0
STEM_BYTES = 5
_STEM_BASE = 0x165667B19E3779F9
#: Terms that name groups, by kind; a swap stays within a kind. Each is one word: of "african-american" both words are swapped.
IDENTITY_TERMS = {
    "faith": "muslim christian jewish hindu buddhist atheist catholic protestant sikh musulman chrétien juif moslem christ jude musulmán cristiano judío",
    "faiths": "muslims christians jews hindus buddhists atheists catholics protestants sikhs musulmans chrétiens juifs moslems christen juden musulmanes cristianos judíos",
    "origin": "african asian european american mexican arab chinese indian turkish polish latino immigrant refugee foreigner",
    "colour": "black white brown",
    "sex": "woman man girl boy lady gentleman femme homme frau mann mujer hombre",
    "sexes": "women men girls boys ladies gentlemen femmes hommes frauen männer mujeres hombres",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual transgender queer trans",
    "ability": "blind deaf disabled autistic paralyzed sighted hearing",
    "age": "young old elderly teenage senior",
}


def _hash_words(texts: pa.Array):
    w = words(*raw(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))), NON_WORD)
    return w, w.hashes()


def _stems(w) -> np.ndarray:
    """The hash of each longer word's first bytes; 0 for a short word."""
    long = w.ends - w.starts > STEM_BYTES
    h = spans_hash(prefix_sums(w.buf.astype(U64) + U64(1), _STEM_BASE), w.starts, np.minimum(w.ends, w.starts + STEM_BYTES), _STEM_BASE)
    return np.where(long, mix(h), U64(0))


def _swaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the terms, sorted, and hashes and stems of the next term of the same kind."""
    old, new, stems = [], [], []
    for terms in IDENTITY_TERMS.values():
        w, h = _hash_words(pa.array(terms.split()))
        old.append(h)
        new.append(np.roll(h, -1))
        stems.append(np.roll(_stems(w), -1))
    old, new, stems = (np.concatenate(x) for x in (old, new, stems))
    order = np.argsort(old)
    return old[order], new[order], stems[order]


_OLD, _NEW, _NEW_STEM = _swaps()


def _present(w, h, stem) -> tuple[np.ndarray, np.ndarray]:
    pairs = gram_starts(w.first, 2)
    doc = w.doc
    stems = np.flatnonzero(stem)
    d = np.concatenate([doc, doc[pairs], doc[stems]])
    i = np.concatenate([h, Grams(h).spans(pairs, pairs + 2), stem[stems]]) % U64(DIM)
    return d, i.astype(np.int64)


def _sets(w, h, stem, n: int) -> list[np.ndarray]:
    d, i = _present(w, h, stem)
    key = np.unique(d * DIM + i)
    at = np.searchsorted(key, np.arange(n + 1) * DIM)
    return [(key[a:b] % DIM).astype(np.int32) for a, b in zip(at, at[1:], strict=False)]


def features(texts: pa.Array) -> list[bytes]:
    """The n-grams of each text, and after them those of its swapped form if it names a group."""
    w, h = _hash_words(texts)
    at = np.minimum(np.searchsorted(_OLD, h), len(_OLD) - 1)
    named = _OLD[at] == h
    swapped = np.where(named, _NEW[at], h)
    stem = _stems(w)
    n = len(texts)
    touched = np.bincount(w.doc[named], minlength=n) > 0
    out = []
    for x, y, t in zip(_sets(w, h, stem, n), _sets(w, swapped, np.where(named, _NEW_STEM[at], stem), n) if named.any() else [None] * n, touched, strict=True):
        if t:  # what both forms share is kept or left out in both
            few = np.union1d(x, y)
            few = few[linear.few(few)]
            x, y = x[np.isin(x, few)], y[np.isin(y, few)]
        else:
            x = x[linear.few(x)]
        out.append(np.concatenate([np.array([len(x)], np.int32), x, *([y] if t else [])]).tobytes())
    return out


def score(texts: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    w, h = _hash_words(texts)
    d, i = _present(w, h, _stems(w))
    told = model[0][i] != 0
    key = np.unique(d[told] * DIM + i[told])
    total = np.bincount(key // DIM, weights=model[0][key % DIM], minlength=len(texts))
    return linear.sigmoid(model[1] + total)


def examples(rows: list, share: dict[int, float]) -> list[linear.Example]:
    out = []
    for r, weight in zip(rows, linear.weights([r.label for r in rows], share), strict=True):
        x = np.frombuffer(r.x, np.int32)
        n = int(x[0])
        a, b = x[1 : n + 1].astype(np.int64), x[n + 1 :].astype(np.int64)
        out.append(linear.Example(a, np.ones(n), int(r.label > 0), weight, (b, np.ones(len(b))) if len(b) else None))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS, epochs: int = 6, pull: float = PULL) -> tuple[np.ndarray, float]:
    rows, share = linear.sampled(docs, labels, label, per_class, text, doc_id)
    return train(linear.features_of(rows, features), share, epochs, pull)


def train(rows: list, share: dict[int, float], epochs: int = 6, pull: float = PULL) -> tuple[np.ndarray, float]:
    return linear.train(examples(rows, share), DIM, epochs, pull, alpha=0.5, l1=5.0, l2=0.01)


def scores(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    return linear.scored(docs, score, docs.sparkSession.sparkContext.broadcast(model), text, keep, threshold)
