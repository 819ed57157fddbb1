"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte pairs, hashed, and a marker for words that repeat the word before. Term shares, dampened and
weighted by inverse document frequency, are projected to the leading right singular vectors of a bounded labelled sample.
The sample's vectors, at most ``2 * per_class`` of them, go to every task; each document is compared with all of them in
blocks, and its nearest ones vote with their labels, weighted by similarity and by how many labelled rows one sampled
row of its class stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import byte_view, row_blocks, text_of
from .words import word_hashes

TERMS = 1024
#: The marker of a repeated word counts as so many terms, about as many as a word has byte pairs.
REPEAT_WEIGHT = 6.0
#: Texts in one block: bounds the dense matrices.
BLOCK_ROWS = 1000


@dataclass
class Model:
    """What every task gets: at most 2 * per_class sampled vectors of ``rank`` numbers, and the projection."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    neighbours: int
    power: float

    @property
    def prior(self) -> float:
        total = self.weights.sum()
        return float((self.weights * self.labels).sum() / total) if total else 0.5

    def embed(self, terms: np.ndarray) -> np.ndarray:
        v = (terms * self.idf) @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(terms), self.prior)
        # rounded, so that the last bits, which differ with a block's shape, decide nothing
        near = np.round(self.embed(terms) @ self.vectors.T, 5)
        k = min(self.neighbours, near.shape[1])
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1]
        row, at = np.nonzero(near >= least[:, None])
        w = np.maximum(near[row, at].astype(np.float64), 0) ** self.power * self.weights[at]
        total, good = (np.bincount(row, x, len(terms)) for x in (w, w * self.labels[at]))
        return np.round(np.where(total > 0, good / np.where(total > 0, total, 1), self.prior), 9)


def term_matrix(texts: pa.Array) -> np.ndarray:
    """Dampened term shares, one row a text; an empty text is a row of zeros."""
    data, off = byte_view(texts)
    n = len(off) - 1
    out = np.zeros((n, TERMS + 1), np.float32)
    if len(data) > 1:
        pair = (data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761) >> np.uint32(22)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))[:-1]
        inside = np.ones(len(pair), bool)
        cut = off[1:-1] - 1
        inside[cut[(cut >= 0) & (cut < len(pair))]] = False
        out[:, :TERMS] = np.bincount((doc * TERMS + pair)[inside], minlength=n * TERMS).reshape(n, TERMS)
        h, first, _ = word_hashes(data, off)
        if len(h):
            repeats = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])])
            lo, hi = first[:-1], first[1:]
            out[:, TERMS] = REPEAT_WEIGHT * (repeats[hi] - repeats[np.minimum(lo + 1, hi)])
    return np.log1p(1000.0 * out / np.maximum(out.sum(1, keepdims=True), 1))


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    for a, b in row_blocks(texts):
        for c in range(a, b, BLOCK_ROWS):
            yield texts.slice(c, min(b, c + BLOCK_ROWS) - c)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row.astype(np.float16).tobytes() for x in _blocks(text_of(batch, "text")) for row in term_matrix(x)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "terms"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model, text_col: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [model.score(term_matrix(x)) for x in _blocks(text_of(batch, text_col))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, name])


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = 2048, rank: int = 48, neighbours: int = 25, power: float = 8.0) -> Model:
    """Learn from at most ``per_class`` labelled rows of each label, the first by a hash of their ids; held-out rows are left out.

    Without labelled rows the model answers 0.5 to everything; with one label, that label. Null ids and labels don't count, nor
    do ids that have both labels. The ``neighbours`` nearest vote, and all that are as near as the last of them (cosines are
    compared to five digits), each with its cosine to the power of ``power``, times its label's rows per sampled row.
    """
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("label")).filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    order = F.md5(F.concat(F.lit("sample:"), F.col("_id").cast("string")))
    sample = known.filter("label = 0").orderBy(order, "_id").limit(per_class).union(known.filter("label = 1").orderBy(order, "_id").limit(per_class))
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(sample), "_id").select("label", "text")  # at most 2 * per_class rows
    # repeated ids could bring more rows than were sampled
    got = texts.mapInArrow(_terms, "label int, terms binary").orderBy("label", "terms").limit(2 * per_class).collect()
    y = np.array([r["label"] for r in got], np.float64)
    if not len(y):
        return Model(np.zeros(TERMS + 1), np.zeros((TERMS + 1, 0)), np.zeros((0, 0)), y, y, neighbours, power)
    x = np.stack([np.frombuffer(r["terms"], np.float16) for r in got]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    _, _, v = np.linalg.svd(x * idf, full_matrices=False) if len(x) < TERMS else (0, 0, np.linalg.eigh((x * idf).T @ (x * idf))[1][:, ::-1].T)
    sampled = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.array([counts.get(int(c), 0) / sampled[int(c)] for c in y])
    model = Model(idf, v[:rank].T.astype(np.float32), np.zeros((0, 0)), y, weights, neighbours, power)
    model.vectors = model.embed(x)
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher if label 1 is likelier. Nulls and empty texts get the labels' mean.

    One pass over the texts without a shuffle. Only the text is read; a column of ``docs`` named ``name`` is replaced.
    """
    kept = docs.drop(name)
    schema = StructType([*kept.schema.fields]).add(name, DoubleType())
    return kept.mapInArrow(partial(_scored, model=model, text_col=text_col, name=name), schema)
