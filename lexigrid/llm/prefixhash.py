"""Document fingerprints by prefix polynomial hashes.

For every text the sums of byte codes times powers of a base, modulo the prime 2**31 - 1 and for two bases, are kept for
all prefixes. The hash of any span is a difference of two of them, shifted to the origin; so equality of two spans is one
comparison, and the longest common extension of two places is found by binary search over its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import reachable, stage
from .text import U, buffers, mix, slices

PRIME, BASES = (1 << 31) - 1, (911_382_323, 972_663_749)
#: Bytes that a document and a passage share at least for the place to be looked at.
SEED = 48
#: Bytes of passages that tasks are given at once; more are handled in several passes.
PASSAGE_BYTES = 16 << 20
_P = U(PRIME)
#: Fields of a span, as `Passages.shared` returns them.
SPAN = ("item", "doc_start", "item_start", "size")
_tables: dict[tuple[int, bool], np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(31))
    x = (x & _P) + (x >> U(31))
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, inverse: bool, n: int) -> np.ndarray:
    have = _tables.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, PRIME) if inverse else base
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, _mod(have * U(pow(step, len(have), PRIME)))])
        _tables[(base, inverse)] = have
    return have[:n]


class Prefixes:
    """Prefix arrays of a byte string, in memory linear in its length."""

    def __init__(self, raw: np.ndarray):
        self.size = len(raw)
        codes = raw.astype(np.uint64) + U(1)
        self.sums = []
        for base in BASES:
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_mod(codes * _powers(base, False, len(raw))), out=sums[1:])
            self.sums.append(_mod(sums).astype(np.uint32))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes (62 bits) of the spans [start, end)."""
        out = np.zeros(len(start), np.uint64)
        for base, sums in zip(BASES, self.sums):
            part = _mod(sums[end].astype(np.uint64) + _P - sums[start].astype(np.uint64))
            out = (out << U(31)) | _mod(part * _powers(base, True, self.size + 1)[start])
        return out


def equal(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes at i of a and j of b are equal."""
    return a.spans(i, i + size) == b.spans(j, j + size)


def extend(a: Prefixes, i: np.ndarray, b: Prefixes, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """Length, at most `most`, of the longest common extension of each place i of a and j of b: to the right, or with `back` to the left."""
    low, high = np.zeros(len(i), np.int64), most.astype(np.int64).copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = equal(a, i - middle, b, j - middle, middle) if back else equal(a, i, b, j, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


class Passages:
    """Passages, their prefix arrays, and all their windows of SEED bytes by hash."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        self.ids = ids
        self.raw, self.offsets = buffers(texts)
        self.prefixes = Prefixes(self.raw)
        start = np.arange(max(0, len(self.raw) - SEED + 1))
        row = np.searchsorted(self.offsets, start, side="right") - 1
        start = start[start + SEED <= self.offsets[row + 1]] if len(start) else start
        value = self.prefixes.spans(start, start + SEED)
        order = np.argsort(value, kind="stable")
        self.value, self.start = value[order], start[order]
        size = np.diff(self.offsets)
        #: Passages shorter than SEED by the largest power of two that isn't longer: sorted hashes of their beginnings, and which.
        self.short = []
        for width in (32, 16, 8, 4, 2, 1):
            which = np.flatnonzero((size >= width) & (size < min(2 * width, SEED)))
            if len(which):
                value = self.prefixes.spans(self.offsets[which], self.offsets[which] + width)
                order = np.argsort(value, kind="stable")
                self.short.append((width, value[order], which[order]))
        self.bits = max(16, int(4 * max(1, len(start))).bit_length())
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(mix(self.value) >> U(64 - self.bits)).astype(np.int64)] = True

    def shared(self, raw: np.ndarray, offsets: np.ndarray, prefixes: Prefixes) -> dict[str, np.ndarray]:
        """All spans of SEED bytes or more that texts share with passages and that can't be extended to either side, and all
        occurrences of passages shorter than that: `row`, `item`, `doc_start`, `item_start`, `size`; by row, the longest first, of
        equally long ones that of the least id, then the first in the text and in the passage."""
        found = np.concatenate([self._long(raw, offsets, prefixes), *self._short(offsets, prefixes)])
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], -found[:, 4], found[:, 0]))]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]).any(1)  # a passage may be given twice
        return dict(zip(("row", *SPAN), found[fresh].T))

    def _short(self, offsets: np.ndarray, prefixes: Prefixes) -> Iterator[np.ndarray]:
        """Occurrences of the passages that are shorter than SEED."""
        for width, value, which in self.short:
            start = np.arange(max(0, prefixes.size - width + 1))
            here = prefixes.spans(start, start + width)
            lo = np.searchsorted(value, here, side="left")
            count = np.searchsorted(value, here, side="right") - lo
            at = np.repeat(start, count)
            item = which[np.repeat(lo, count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]
            row = np.searchsorted(offsets, at, side="right") - 1
            size = self.offsets[item + 1] - self.offsets[item]
            inside = at + size <= offsets[row + 1]
            at, item, row, size = at[inside], item[inside], row[inside], size[inside]
            same = equal(prefixes, at, self.prefixes, self.offsets[item], size)
            at, item, row, size = at[same], item[same], row[same], size[same]
            yield np.stack([row, self.ids[item], at - offsets[row], np.zeros(len(at), np.int64), size], 1)

    def _long(self, raw: np.ndarray, offsets: np.ndarray, prefixes: Prefixes) -> np.ndarray:
        """Rows (row, item, doc_start, item_start, size) of the maximal spans of SEED bytes or more."""
        start = np.arange(max(0, len(raw) - SEED + 1))
        if not len(start) or not len(self.value):
            return np.zeros((0, 5), np.int64)
        value = prefixes.spans(start, start + SEED)
        start = start[self.filter[(mix(value) >> U(64 - self.bits)).astype(np.int64)]]
        row = np.searchsorted(offsets, start, side="right") - 1
        inside = start + SEED <= offsets[row + 1]
        start, row = start[inside], row[inside]
        value = value[start]
        lo = np.searchsorted(self.value, value, side="left")
        count = np.searchsorted(self.value, value, side="right") - lo
        at = np.repeat(np.arange(len(start)), count)
        i, row = start[at], row[at]
        j = self.start[np.repeat(lo, count) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)]
        item = np.searchsorted(self.offsets, j, side="right") - 1
        # Where the bytes before are equal too, the extension of an earlier place covers this one.
        fresh = (i == offsets[row]) | (j == self.offsets[item]) | (raw[i - 1] != self.raw[j - 1])
        i, j, row, item = i[fresh], j[fresh], row[fresh], item[fresh]
        size = extend(prefixes, i, self.prefixes, j, np.minimum(offsets[row + 1] - i, self.offsets[item + 1] - j))
        return np.stack([row, self.ids[item], i - offsets[row], j - self.offsets[item], size], 1)[size >= SEED]


SPANS = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("item_id", "doc_start", "item_start", "span_bytes")]))
FOUND = f"doc_id long, digest string, fingerprint long, n_bytes long, spans {SPANS.simpleString()}"


def _scan(sent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, digest, text) -> FOUND; passages are hashed once a task."""
        passages = Passages(*sent.value)
        for batch in batches:
            for lo, hi in slices(batch.column(2), 1 << 21):
                part = batch.slice(lo, hi - lo)
                raw, offsets = buffers(part.column(2))
                prefixes = Prefixes(raw)
                whole = prefixes.spans(offsets[:-1], offsets[1:]).astype(np.int64)
                found = passages.shared(raw, offsets, prefixes)
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[k])) for k in SPAN], names=SPANS.elementType.names)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found["row"], np.arange(hi - lo + 1)).astype(np.int32)), spans)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(whole), pa.array(np.diff(offsets)), lists], names=["doc_id", "digest", "fingerprint", "n_bytes", "spans"])

    return scan


def fingerprints(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """One row a row of `docs`: doc_id, `fingerprint` and `n_bytes` of the whole text, `copy_of` (the least doc_id of equal
    text, nulls last), the longest span shared with a passage: item_id, doc_start, item_start, span_bytes (bytes of UTF-8;
    null without a span of SEED bytes), and `spans`: all of them of SEED bytes or more, with every passage and at every place,
    that can't be extended to either side, in that order (longest first, then by item_id, doc_start and item_start).

    Copies agree in a 128-bit digest of their bytes beside the fingerprint, whose base is public. A passage shorter than SEED is found
    wherever it stands as a whole. A null or empty text has no fingerprint and is no copy, texts of any length are scanned whole,
    repeated rows are copies of each other, and an empty table gives an empty table. Null and empty passages match nothing. More
    passages than PASSAGE_BYTES are taken in several passes over `docs`.
    """
    spark = reachable(docs).sparkSession
    items = passages.where(F.col("item_id").isNotNull() & (F.octet_length("text") > 0)).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // PASSAGE_BYTES))
    rows, every = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text"), None
    for k in range(passes):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").toArrow()
        sent = spark.sparkContext.broadcast((some.column("item_id").to_numpy().astype(np.int64), some.column("text").combine_chunks() if some.num_rows else pa.array([], pa.string())))
        found = rows.mapInArrow(_scan(sent), FOUND)
        every = found if every is None else every.union(found)
    flat = every
    if passes > 1:  # a row has one result a pass: repeated rows agree in all, and are counted
        flat = flat.groupBy("doc_id", "digest", "fingerprint", "n_bytes").agg(F.collect_set("spans").alias("spans"), (F.count(F.lit(1)) / passes).cast("int").alias("times"))
        turned = F.transform(F.flatten("spans"), lambda s: F.struct(-s["span_bytes"], s["item_id"], s["doc_start"], s["item_start"])).cast("array<struct<less:long,item_id:long,doc_start:long,item_start:long>>")
        spans = F.transform(F.array_sort(F.array_distinct(turned)), lambda s: F.struct(s["item_id"], s["doc_start"], s["item_start"], -s["less"])).cast(SPANS)
        flat = flat.select("doc_id", "digest", "fingerprint", "n_bytes", spans.alias("spans"), F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    flat = stage(flat.select("doc_id", "digest", "fingerprint", "n_bytes", "spans"), "fingerprints")
    least = flat.where("n_bytes > 0").groupBy("fingerprint", "n_bytes", "digest").agg(F.min("doc_id").alias("copy_of"))
    both = flat.join(least, ["fingerprint", "n_bytes", "digest"], "left")
    longest = F.get("spans", F.lit(0))
    return both.select(
        "doc_id", F.when(F.col("n_bytes") > 0, F.col("fingerprint")).alias("fingerprint"), "n_bytes", "copy_of",
        *[longest[c].alias(c) for c in SPANS.elementType.names], "spans",
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, its copies, its longest span shared with a benchmark passage, and all such spans."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
