"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, their stems (their first `STEMS` bytes, so that inflected forms share a weight), pairs of
neighbours and pairs one word apart of the lower-cased text, hashed to `BITS` bits and counted once a document.
Per-coordinate learning rates and an L1 term leave few weights, which every task gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled
from .scratch import reachable
from .text import U, Words, mix, slices, span_hashes

BITS = 20
#: At most so many labelled rows, chosen by a hash of doc_id, are fitted on.
FIT_ROWS = 10_000
STEMS = (6, 8)
EPOCHS, ALPHA, BETA, L1, L2 = 5, 1.0, 1.0, 5.0, 0.1
CUTOFF = 0.5


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every feature occurrence."""
    h, row = words.hash, words.row
    rows, out = [row], [mix(h ^ U(0x1B873593))]
    for size in STEMS:
        long = words.end - words.start > size
        rows.append(row[long])
        out.append(mix(span_hashes(words.raw, words.start[long], words.start[long] + size) + U(size)))
    for gap, salt in ((1, 0xCC9E2D51), (2, 0xE6546B64)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            out.append(mix(h[:-gap][same] * U(0x9FB21C651E98DF25) + h[gap:][same] + U(salt)))
    return np.concatenate(rows), (np.concatenate(out) >> U(64 - bits)).astype(np.int64)


def _indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, label, texts = batch.column(0), batch.column(1), batch.column(2)
        for lo, hi in slices(texts):
            words = Words(texts.slice(lo, hi - lo))
            row, index = features(words)
            both = np.unique((row << BITS) | index)
            at = np.searchsorted(both, np.arange(words.rows + 1) << BITS)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.record_batch([doc.slice(lo, hi - lo), label.slice(lo, hi - lo), lists], names=["doc_id", "label", "index"])


def ftrl(examples: list[np.ndarray], y: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, index, weight) of FTRL-proximal over sets of active coordinates; the bias has no penalty."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    bias = lambda: -zb * ALPHA / (BETA + np.sqrt(nb))
    weights = lambda zi, ni: np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
    for _ in range(epochs):
        for at, label in zip(examples, y):
            zi, ni = z[at], n[at]
            w, b = weights(zi, ni), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - label
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - s * w, ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * b
            nb += g * g
    w = weights(z, n)
    some = np.flatnonzero(w)
    return float(bias()), some, w[some]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """The model of a bounded sample of labelled documents, which `labelled` chooses; they are learned in an order by hash.
    Without labels the model is empty, and every document scores 0.5."""
    known = labelled(reachable(docs), labels, "toxic", rows).select("doc_id", "label", "text").mapInArrow(_indices, "doc_id long, label double, index array<int>")
    table = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "label", "index").toArrow()
    flat = table.column("index").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    at, value = flat.offsets.to_numpy(), flat.values.to_numpy()
    return ftrl([value[a:b] for a, b in zip(at[:-1], at[1:])], table.column("label").to_numpy() > 0.5)


def scored(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], cutoff: float = CUTOFF) -> DataFrame:
    """(row, toxicity, toxic): the struct `row` has all columns of `docs`.

    A text without words, or null, scores 0. Repeated rows score alike, texts of any length are looked at as a whole, and
    an empty table gives an empty table. The model goes to the tasks as its few coordinates that aren't zero.
    """
    bias, index, weight = model
    sent = reachable(docs).sparkSession.sparkContext.broadcast((bias, index.astype(np.int32), weight))

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        at, keys, values = sent.value
        dense = np.zeros(1 << BITS)
        dense[keys] = values
        out = []
        for lo, hi in slices(texts):
            words = Words(texts.slice(lo, hi - lo))
            row, where = features(words)
            active = dense[where] != 0
            both = np.unique((row[active] << BITS) | where[active])
            total = np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], minlength=words.rows)
            out.append(np.where(words.count > 0, 1 / (1 + np.exp(-np.clip(total + at, -30, 30))), 0.0))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("toxicity", toxicity(F.col("row.text")))
    return rows.select("row", "toxicity", (F.col("toxicity") >= cutoff).alias("toxic"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its probability of being toxic, and the verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("row.doc_id", "toxicity", "toxic")
