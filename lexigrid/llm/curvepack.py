"""Packing along a space-filling curve.

Hashed word vectors are projected to `DIMS` dimensions, the place in that space becomes a Hilbert key, documents are
range-sorted by key, and the sorted stream of tokens is cut into sequences of equal length. So a sequence holds documents
that are neighbours on the curve. Tokens are white-space separated words; a document that crosses a cut goes on in
the next sequence, and the texts of its pieces, joined, are its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import reachable, stage
from .text import SOLID, U, Words, buffers, slices, spans

DIMS, DEPTH = 4, 12
#: Tokens of a sequence.
LENGTH = 2048
#: Bytes of text that a task sorts, about, the most such tasks, and documents sampled for each to find where its range ends.
PART_BYTES, MOST_PARTS, SAMPLES = 16 << 20, 50_000, 50


def hilbert(points: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Hilbert keys of integer points (n x dims, each below 2**depth), by the transposed form of the curve."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = U(q - 1)
        for i in range(dims):
            high = (x[i] & U(q)) != 0
            swap = np.where(high, U(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (depth - 1)
    while q > 1:
        t = np.where((x[dims - 1] & U(q)) != 0, t ^ U(q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for bit in range(depth - 1, -1, -1):
        for i in range(dims):
            key = (key << U(1)) | (((x[i] ^ t) >> U(bit)) & U(1))
    return key.astype(np.int64)


def places(words: Words, dims: int = DIMS, depth: int = DEPTH) -> np.ndarray:
    """Points of the curve's grid: sums of signed word hashes over the number of words, squashed to the unit cube."""
    out = np.empty((words.rows, dims), np.int64)
    for d in range(dims):
        sign = ((words.hash >> U(11 * d + 5)) & U(1)).astype(np.float64) * 2 - 1
        t = 8 * np.bincount(words.row, sign, minlength=words.rows) / np.maximum(words.count, 1)
        out[:, d] = np.clip((0.5 + 0.5 * t / np.sqrt(1 + t * t)) * (1 << depth), 0, (1 << depth) - 1)
    return out


def _sizes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Curve key and number of tokens of each text."""
    keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(texts):
        part = texts.slice(lo, hi - lo)
        keys.append(hilbert(places(Words(part))))
        raw, offsets = buffers(part)
        sizes.append(np.bincount(spans(raw, offsets, SOLID)[2], minlength=hi - lo).astype(np.int64))
    return np.concatenate(keys), np.concatenate(sizes)


def _keyed(edges: np.ndarray, ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) -> (doc_id, text, key, n, part) of rows that have tokens; part is the range of (key, doc_id) between edges."""
        for batch in batches:
            key, n = _sizes(batch.column(1))
            doc = pa.compute.fill_null(batch.column(0), np.iinfo(np.int64).min).to_numpy()
            part = np.searchsorted(edges, key, side="left")
            after = np.searchsorted(edges, key, side="right")
            for value in np.unique(key[after > part]):
                at = np.flatnonzero(key == value)
                first, last = np.searchsorted(edges, value, side="left"), np.searchsorted(edges, value, side="right")
                part[at] = first + np.searchsorted(ids[first:last], doc[at], side="right")
            some = pa.array(np.flatnonzero(n > 0))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(key), pa.array(n), pa.array(part.astype(np.int32))], names=["doc_id", "text", "key", "n", "part"]).take(some)

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(_sizes(batch.column(1))[0])], names=["doc_id", "key"])


def ranges(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Edges (keys, and doc_ids among equal keys) of ranges of about `part_bytes` of text, from a sample of documents by hash.
    They decide which task sorts what; the order of documents, and so the result, is the same for any edges."""
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = min(MOST_PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // part_bytes)))
    share = max(1, rows // (SAMPLES * parts))
    some = docs.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0) & F.col("text").isNotNull()).select("doc_id", "text")
    found = some.mapInArrow(_sampled, "doc_id long, key long").toArrow()
    key, doc = found.column("key").to_numpy(), pa.compute.fill_null(found.column("doc_id"), np.iinfo(np.int64).min).to_numpy()
    order = np.lexsort((doc, key))
    at = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
    return key[at], doc[at]


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the tokens before each row in it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(3).to_numpy()
        upto = before + np.cumsum(n)
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n)], names=["doc_id", "text", "key", "n", "part", "start"])
        before = int(upto[-1]) if len(n) else before


def _cut(length: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text, key, n, start) -> one row for each sequence that a document has tokens in."""
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                n, start = part.column(3).to_numpy(), part.column(4).to_numpy()
                first, last = start // length, (start + n - 1) // length
                times = last - first + 1
                row = np.repeat(np.arange(hi - lo), times)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                begin = np.maximum(seq * length - start[row], 0)
                end = np.minimum((seq + 1) * length - start[row], n[row])
                raw, offsets = buffers(part.column(1))
                token, _, owner = spans(raw, offsets, SOLID)
                base = np.searchsorted(owner, np.arange(hi - lo))
                at = np.append(token, len(raw))
                # A piece starts at its first token, but a document's first piece at the document's start.
                cuts = np.where(begin == 0, offsets[row], at[np.minimum(base[row] + begin, len(token))])
                cuts = np.append(cuts, len(raw))
                text = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
                at_row = pa.array(row)
                yield pa.record_batch(
                    [pa.array(seq), pa.array((start[row] + begin - seq * length).astype(np.int32)), part.column(0).take(at_row), pa.array(begin), pa.array((end - begin).astype(np.int32)), part.column(2).take(at_row), text.cast(pa.string())],
                    names=["sequence", "sequence_start", "doc_id", "doc_start", "n_tokens", "curve_key", "text"],
                )

    return pieces


def pack(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence, sequence_start, doc_id, doc_start, n_tokens, curve_key, text): every document's pieces in the sequences.

    Documents are in the order of curve key, doc_id (nulls first) and a hash of the text. Every sequence but the last has
    `length` tokens. Null and blank texts have nothing to pack and are left out; repeated rows are packed as often as they
    occur. Columns beside doc_id and text aren't looked at. Texts of any length are packed whole; an empty table packs to none.
    """
    some = reachable(docs).select("doc_id", "text")
    edges = ranges(some)
    rows = some.where("text is not null").mapInArrow(_keyed(*edges), "doc_id long, text string, key long, n long, part int")
    ranged = rows.repartitionById(len(edges[0]) + 1, "part").sortWithinPartitions("key", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = stage(ranged.select("doc_id", "text", "key", "n").mapInArrow(_running, "doc_id long, text string, key long, n long, part int, start long"), "curve")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    placed = ranged.join(F.broadcast(ahead), "part")  # a row a partition, of which there are MOST_PARTS at most
    return placed.select("doc_id", "text", "key", "n", (F.col("ahead") + F.col("start")).alias("start")).mapInArrow(
        _cut(length), "sequence long, sequence_start int, doc_id long, doc_start long, n_tokens int, curve_key long, text string"
    )


def op2_curve_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed along the curve."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
