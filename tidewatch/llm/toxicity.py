"""Toxicity by a chain of linear classifiers.

Categories are predicted in turn; each category's logistic model sees the features of a text and the probabilities of the categories before
it. In training those probabilities are out of fold, from models that have not seen the document, as they are for new texts; they also
give the threshold, the least one that flags few documents of the other class.

Features are words and beginnings of words, and that they come up at least two, three or four times: insults are words in one language and
built from one stem in another. Each model keeps the features, WORDS at most, that tell its classes apart on the documents that it is fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import MARKS, U64, arrow_rows, in_chunks, mix, word_hashes

CATEGORIES = ("quality", "toxic")
#: The models are fitted on so many labelled documents, in expectation, drawn by a hash of the id.
TRAIN_DOCS = 16_000
BITS, WORDS, FOLDS = 20, 2000, 5
#: Bytes of the beginnings of longer words, and how often a feature counts.
STEMS, TIMES = (4, 6), 4
#: Standard deviations by which a feature's share in a class must be off, and the documents that must have it.
LEAST_Z, LEAST_DOCS = 3.5, 3
#: The threshold: the least of these that flags no more than so many of the other class' documents, out of fold, or else the last.
THRESHOLDS, FALSE_SHARE = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5), 0.005
_L2, _ROUNDS = 0.1, 300


def _features(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct feature numbers (hashes of BITS bits) of each text."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    whole, counts = word_hashes(raw, MARKS)
    doc = np.repeat(np.arange(len(texts)), counts)
    hashes, docs = [whole], [doc]
    for k in STEMS:
        h, longer = word_hashes(raw, MARKS, k)
        hashes.append(mix(h[longer] + U64(k)))
        docs.append(doc[longer])
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    h, doc = h[first], doc[first]
    number = np.concatenate([h, *[mix(h[times >= t] + U64(t)) for t in range(2, TIMES + 1)]]) >> U64(64 - BITS)
    doc = np.concatenate([doc, *[doc[times >= t] for t in range(2, TIMES + 1)]])
    both = np.unique(doc << BITS | number.astype(np.int64))
    ends = np.searchsorted(both, np.arange(1, len(texts) + 1) << BITS)
    return np.split((both & ((1 << BITS) - 1)).astype(np.int32), ends[:-1]) if len(texts) else []


@dataclass
class Link:
    """A logistic model of (words, probabilities of earlier categories)."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margins(self, flat: np.ndarray, doc: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, flat), max(len(self.words) - 1, 0))
        hit = self.words[at] == flat if len(self.words) else np.zeros(len(flat), dtype=bool)
        return np.bincount(doc[hit], weights=self.weights[at[hit]], minlength=n) + earlier @ self.earlier + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_link(flat: np.ndarray, doc: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> Link:
    """flat, doc: word numbers and the rows that they are in; y: 0 or 1 by row."""
    n, pos = len(y), y.sum()
    if not n or pos in (0, n):
        return Link(np.empty(0, np.int32), np.empty(0), np.zeros(earlier.shape[1]), 40.0 if n and pos else -40.0)
    df = np.bincount(flat, minlength=1 << BITS).astype(np.float64)
    with_y = np.bincount(flat, weights=y[doc].astype(np.float64), minlength=1 << BITS)
    rate = pos / n
    z = np.abs(with_y - df * rate) / np.sqrt(np.maximum(df * rate * (1 - rate), 1e-9))
    z[df < LEAST_DOCS] = 0
    words = np.sort(np.argsort(-z, kind="stable")[:WORDS]).astype(np.int32)
    words = words[z[words] >= LEAST_Z]
    at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
    hit = words[at] == flat if len(words) else np.zeros(len(flat), dtype=bool)
    col, row = at[hit], doc[hit]
    # accelerated steps; as no feature is negative, a row's sum bounds how they curve together, and each has a step of its own
    w, b, e = np.zeros(len(words)), float(np.log(pos / (n - pos))), np.zeros(earlier.shape[1])
    per_row = np.bincount(row, minlength=n) + earlier.sum(axis=1) + 1
    curve_w, curve_e, curve_b = np.bincount(col, weights=per_row[row], minlength=len(words)) / 4 + _L2, earlier.T @ per_row / 4 + _L2, per_row.sum() / 4
    vw, vb, ve = w.copy(), b, e.copy()
    for i in range(_ROUNDS):
        g = _sigmoid(np.bincount(row, weights=vw[col], minlength=n) + earlier @ ve + vb) - y
        nw = vw - (np.bincount(col, weights=g[row], minlength=len(words)) + _L2 * vw) / curve_w
        nb, ne = vb - g.sum() / curve_b, ve - (earlier.T @ g + _L2 * ve) / curve_e
        t = i / (i + 3)
        vw, vb, ve = nw + t * (nw - w), nb + t * (nb - b), ne + t * (ne - e)
        w, b, e = nw, nb, ne
    return Link(words, w, e, float(b))


class Chain:
    def __init__(self, categories: tuple[str, ...], bags: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> None:
        """labels: rows by categories, -1 where unknown; fold: the part of each row. threshold is the last category's."""
        self.categories, self.links = categories, []
        earlier = np.zeros((len(bags), 0))
        for j in range(len(categories)):
            y, known = labels[:, j], labels[:, j] >= 0
            out = np.zeros(len(bags))
            for f in range(FOLDS):
                # a row without this label is predicted by a model of its fold as well
                link = self._fit(bags, y, known & (fold != f), earlier)
                own = np.flatnonzero(fold == f)
                flat, doc = flatten([bags[i] for i in own])
                out[own] = _sigmoid(link.margins(flat, doc, len(own), earlier[own]))
            self.links.append(self._fit(bags, y, known, earlier))
            clean = out[known & (y == 0)]
            self.threshold = next((t for t in THRESHOLDS if (clean >= t).sum() <= FALSE_SHARE * len(clean)), THRESHOLDS[-1])
            earlier = np.column_stack([earlier, out])

    @staticmethod
    def _fit(bags, y, rows, earlier) -> Link:
        at = np.flatnonzero(rows)
        return fit_link(*flatten([bags[i] for i in at]), y[at].astype(np.float64), earlier[at])

    def predict(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probabilities, rows by categories."""
        flat, doc = flatten(bags)
        out = np.zeros((len(bags), 0))
        for link in self.links:
            out = np.column_stack([out, _sigmoid(link.margins(flat, doc, len(bags), out))])
        return out


def flatten(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not bags:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(x) for x in bags])


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, train_docs: int = TRAIN_DOCS) -> Chain | None:
    """Fit on documents (doc_id, text) with labels (doc_id, a 0 or 1 per category, null if unknown). Of an id's labels the largest counts."""
    ship(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.coalesce(F.max(c).cast("int"), F.lit(-1)).alias(f"y{i}") for i, c in enumerate(categories)])
    n = labels.count()
    if not n:
        return None
    # the sample's size has a bound, so that it is sent to the texts
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, train_docs / n) * (1 << 30)) + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(drawn), "id")
    ys = [f"y{i}" for i in range(len(categories))]

    def run(batches):
        for chunk in in_chunks(arrow_rows(batches, "id", "text", *ys), 1):
            bags = _features([x[1] for x in chunk])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in chunk], pa.int64()), pa.array([x.tobytes() for x in bags], pa.binary()), *[pa.array([x[2 + i] for x in chunk], pa.int32()) for i in range(len(ys))]], names=["id", "bag", *ys])

    got = rows.mapInArrow(run, "id long, bag binary, " + ", ".join(f"{y} int" for y in ys)).withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS))).toArrow().sort_by([("id", "ascending"), ("bag", "ascending")])
    if not got.num_rows:
        return None
    return Chain(tuple(categories), [np.frombuffer(x, np.int32) for x in got.column("bag").to_pylist()], np.column_stack([got.column(y).to_numpy() for y in ys]), got.column("fold").to_numpy())


def score(docs: DataFrame, chain: Chain | None, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(doc_id, text) to (doc_id, p_<category>...), a row for each row. A text without words, null or empty, has probabilities 0, as all have without labels."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in categories]

    def run(batches):
        for chunk in in_chunks(arrow_rows(batches, "doc_id", "text"), 1):
            p = np.zeros((len(chunk), len(names)))
            if shared.value:
                bags = _features([t for _, t in chunk])
                p = shared.value.predict(bags) * np.array([len(x) > 0 for x in bags])[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunk], pa.int64()), *[pa.array(p[:, j]) for j in range(len(names))]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"`{n}` double" for n in names))


def toxic_documents(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, threshold: float | None = None) -> DataFrame:
    """The documents whose last category is likely: (doc_id, p_<category>..., toxic), a row for each such row.

    A text without words, null or empty, is not toxic. Rows that repeat or have no id are scored like any others, and a document's probability
    depends on its text alone. Without a threshold the out-of-fold one is taken. Empty tables give no rows.
    """
    chain = train(docs, labels, categories)
    least = threshold if threshold is not None else chain.threshold if chain else 1.0
    return score(docs, chain, categories).where(F.col(f"p_{categories[-1]}") >= least).withColumn("toxic", F.lit(True))
