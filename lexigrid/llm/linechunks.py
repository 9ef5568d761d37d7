"""Line deduplication by runs of lines.

All pairs of neighbouring lines, and long lines by themselves, are compared by hash and then by their bytes; those that
occur again anywhere are removed but for their first occurrence. The pairs overlap, so a repeated run of two lines or more
goes as a whole, wherever it stands and however it is laid out. `Chunks` is the cheaper partition in which a rolling hash
over `WINDOW` lines decides where chunks end; runs that its boundaries cut differently in two places are missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, reachable, stage
from .text import SOLID, U, buffers, mix, slices, span_hashes, spans

#: Lines under the rolling hash, and the number of its values of which one ends a chunk.
WINDOW, DIVISOR = 2, 2
#: A run of lines without a boundary is cut after each so many.
MOST_LINES = 32
#: A chunk is compared if it has so many lines; a line of LONG_WORDS words (by white space) is compared by itself too.
LEAST_LINES, LONG_WORDS = 2, 50
#: A row that shares this part of its units, and of the other's, with another is a copy of it as a whole.
COPY = 2 / 3


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, byte start, end (with the newline), end of the body (without) and number of words of every line."""
    filled = offsets[1:] > offsets[:-1]
    end = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, offsets[1:][filled]]))
    start = np.concatenate([offsets[:1], end[:-1]]) if len(end) else end
    row = np.searchsorted(offsets, start, side="right") - 1
    body = end - (raw[end - 1] == 10) if len(end) else end
    word = spans(raw, offsets, SOLID)[0]
    return row, start, end, body, np.searchsorted(word, end) - np.searchsorted(word, start)


class Runs:
    """What is compared in a slice of texts, in order: each line that has words with the next such line of its row (and the
    blank lines between), and each line of LONG_WORDS by itself. Attributes as in `Chunks`; the spans overlap."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = buffers(texts)
        *lines, words = _lines(self.raw, self.offsets)
        row, start, end, body, words = (x[words > 0] for x in (*lines, words))
        pair = np.flatnonzero(row[1:] == row[:-1])
        long = np.flatnonzero(words >= LONG_WORDS)
        first, last = np.concatenate([pair, long]), np.concatenate([pair + 1, long])
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        self.row, self.start, self.end, self.body = row[first], start[first], end[last], body[last]
        self.hash = span_hashes(self.raw, self.start, self.body)
        self.whole = np.ones(len(first), bool)
        self.index = np.arange(len(first)) - np.searchsorted(self.row, self.row, side="left")


class Chunks:
    """Chunks of a slice of texts, in order: `row`, byte `start`, `end` (with the last newline) and `body` (without), `index` in the row, `hash`, and `whole`: whether it is compared."""

    def __init__(self, texts: pa.Array):
        self.raw, self.offsets = raw, offsets = buffers(texts)
        row, start, end, body, words = _lines(raw, offsets)
        line = span_hashes(raw, start, body)
        same = np.zeros(len(row), bool)
        same[1:] = row[1:] == row[:-1]
        long = words >= LONG_WORDS
        rolling, ok = line.copy(), np.ones(len(row), bool)
        for k in range(1, WINDOW):
            ok[k:] &= same[k:] & ok[k - 1 : -1] if k > 1 else same[k:]
            ok[:k] = False
            rolling[ok] = rolling[ok] * U(0x9E3779B97F4A7C15) + line[np.flatnonzero(ok) - k]
        cut = (mix(rolling) % U(DIVISOR) == 0) | long
        cut[:-1] |= long[1:] | ~same[1:]
        cut[-1:] = True
        at = np.arange(len(row))
        before = np.maximum.accumulate(np.where(np.concatenate([[True], cut[:-1]]), at, 0)) if len(at) else at
        cut |= (at - before) % MOST_LINES == MOST_LINES - 1
        stop = np.flatnonzero(cut)
        begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        self.row, self.start, self.end, self.body = row[begin], start[begin], end[stop], body[stop]
        self.hash = span_hashes(raw, self.start, self.body)
        self.whole = (stop - begin + 1 >= LEAST_LINES) | long[begin]
        self.index = np.arange(len(begin)) - np.searchsorted(self.row, self.row, side="left")


def _spot(batches: Iterator[pa.RecordBatch], units: type) -> Iterator[pa.RecordBatch]:
    """(id, doc, text) -> (id, doc, index, hash) of the units to compare."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            chunks = units(part.column(2))
            row = pa.array(chunks.row[chunks.whole])
            yield pa.record_batch([part.column(0).take(row), part.column(1).take(row), pa.array(chunks.index[chunks.whole].astype(np.int32)), pa.array(chunks.hash[chunks.whole].view(np.int64))], names=["id", "doc", "index", "hash"])


def _fetch(batches: Iterator[pa.RecordBatch], units: type) -> Iterator[pa.RecordBatch]:
    """(id, doc, text, wanted) -> (id, doc, index, hash, bytes) of the wanted units."""
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            chunks = units(part.column(2))
            at = _places(chunks, part.column(3))
            whole = memoryview(np.ascontiguousarray(chunks.raw))
            content = pa.array([whole[a:b] for a, b in zip(chunks.start[at].tolist(), chunks.body[at].tolist())], pa.binary())
            row = pa.array(chunks.row[at])
            yield pa.record_batch([part.column(0).take(row), part.column(1).take(row), pa.array(chunks.index[at].astype(np.int32)), pa.array(chunks.hash[at].view(np.int64)), content], names=["id", "doc", "index", "hash", "bytes"])


def _places(chunks: Runs | Chunks, lists: pa.Array) -> np.ndarray:
    """Positions in `chunks` of the indexes in each row's list."""
    first = np.searchsorted(chunks.row, np.arange(len(lists)))
    owner = pa.compute.list_parent_indices(lists).to_numpy()
    return first[owner] + pa.compute.list_flatten(lists).to_numpy()


def removed(texts: pa.Array, lists: pa.Array, units: type) -> pa.Array:
    """Texts without the units of the given indexes, which ascend in each list (`clean`), and the number of unbroken stretches that went (`gone`)."""
    out = []
    for lo, hi in slices(texts):
        chunks = units(texts.slice(lo, hi - lo))
        at = _places(chunks, lists.slice(lo, hi - lo))
        row, start, end = chunks.row[at], chunks.start[at], np.maximum.accumulate(chunks.end[at])
        new = np.ones(len(at), bool)  # the others go on in the stretch before them
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
        row, start, end = row[new], start[new], end[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else end
        step = np.zeros(len(chunks.raw) + 1, np.int8)
        step[start] += 1
        step[end] -= 1
        keep = np.cumsum(step[:-1], dtype=np.int8) == 0
        size = chunks.offsets - np.concatenate([[0], np.cumsum(end - start)])[np.searchsorted(end, chunks.offsets, side="right")]
        gone = np.bincount(row, minlength=hi - lo)
        clean = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(chunks.raw[keep])))
        out.append(pa.StructArray.from_arrays([clean.cast(pa.string()), pa.array(gone.astype(np.int32))], names=["clean", "gone"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("clean", pa.string()), ("gone", pa.int32())]))


def _later(found: DataFrame) -> DataFrame:
    """(id, doc, index, first): the units of `found` that stand elsewhere before, with their first place. Units of equal hashes
    are compared byte by byte here: a group is one content."""
    place = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("id").alias("id"), F.col("index").alias("index"))
    equal = found.groupBy("hash", "check", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    first = equal.groupBy("hash", "check").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("contents"), F.max("first").alias("first"))
    first = first.where("n > 1 and contents = 1").select("hash", "check", "first")
    return found.select("id", "doc", "index", "hash", "check", place.alias("place")).join(first, ["hash", "check"]).where("place <> first").select("id", "doc", "index", "first")


def _copies(later: DataFrame, spots: DataFrame) -> DataFrame:
    """(id, doc) of the rows that share COPY of their units, and of the other's, with the row that has them first."""
    units = spots.groupBy("id", "doc").agg((F.max("index") + 1).alias("units"))
    lost = later.groupBy("id", "doc", F.col("first.id").alias("of_id"), F.col("first.doc").alias("of_doc")).agg(F.size(F.collect_set("index")).alias("lost"))
    own = units.select(F.col("id").alias("own_id"), F.col("doc").alias("own_doc"), F.col("units").alias("own"))
    its = units.select(F.col("id").alias("its_id"), F.col("doc").alias("its_doc"), F.col("units").alias("its"))
    both = lost.join(own, (F.col("id") == F.col("own_id")) & F.col("doc").eqNullSafe(F.col("own_doc"))).where(F.col("lost") >= F.col("own") * COPY)
    both = both.join(its, (F.col("of_id") == F.col("its_id")) & F.col("of_doc").eqNullSafe(F.col("its_doc"))).where(F.col("lost") >= F.col("its") * COPY)
    return both.select(F.col("id").alias("copy_id"), F.col("doc").alias("copy_doc")).distinct()


def repeated(docs: DataFrame, units: type, copies: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, gone): rows is (row, id, doc), partitioned by id; gone is (id, doc, gone) with the list of unit indexes to remove from a row.

    Occurrences of a unit are counted where they are read, and only then shuffled by its hash, where a unit that is everywhere
    may be split among tasks.
    """
    identity = F.xxhash64("doc_id", "text").alias("id"), F.col("doc_id").alias("doc")
    rows = reachable(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *identity).repartition("id")
    texts = docs.where(F.col("text").isNotNull()).select(*identity, "text")
    spots = stage(texts.mapInArrow(partial(_spot, units=units), "id long, doc long, index int, hash long"), "spots")
    twice = spots.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    wanted = spots.join(twice, "hash", "left_semi").groupBy("id", "doc").agg(F.sort_array(F.collect_set("index")).alias("wanted"))
    wanted = wanted.select(F.col("id").alias("want_id"), F.col("doc").alias("want_doc"), "wanted")
    same = (F.col("id") == F.col("want_id")) & F.col("doc").eqNullSafe(F.col("want_doc"))
    found = texts.join(wanted, same).select("id", "doc", "text", "wanted").mapInArrow(partial(_fetch, units=units), "id long, doc long, index int, hash long, bytes binary")
    found = stage(found.withColumn("check", F.xxhash64("bytes")), "found")
    rest, whole = found, None
    if not copies:
        whole = stage(_copies(_later(found), spots), "copies")
        rest = found.join(whole, (F.col("id") == F.col("copy_id")) & F.col("doc").eqNullSafe(F.col("copy_doc")), "left_anti")
    gone = _later(rest).groupBy("id", "doc").agg(F.sort_array(F.collect_set("index")).alias("gone"))
    gone = stage(gone.select(F.col("id").alias("gone_id"), F.col("doc").alias("gone_doc"), "gone"), "gone")
    discard(spots, found, *([] if copies else [whole]))
    return rows, gone


def cleaned(docs: DataFrame, units: type = Chunks, copies: bool = True) -> DataFrame:
    """(row, clean, gone): all columns of `docs` in the struct `row`, the text without what is repeated, and the number of
    stretches that went. `units` says what is compared: with `Runs` every repeated run goes, with `Chunks` repeated chunks.

    The first occurrence stays: the one of the least doc_id (nulls last), then by hash of the text and place in it. Of
    overlapping runs each line's text stays at its first place, though its neighbours may stay elsewhere. Rows that
    agree in doc_id and text are one document, and keep or lose the same lines. A null text stays null. Units whose
    two hashes agree though their bytes don't are left alone. Without `copies`, rows that are copies of another as a whole
    (COPY) stay as they are, for a search for near duplicates to drop; a run that stands in only one of the other rows stays
    there. Texts of any length are looked at as a whole, and an empty table gives an empty table.
    """

    @F.arrow_udf("clean string, gone int")
    def without(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return removed(texts, lists, units)

    without = without.asNondeterministic()  # so that it is evaluated once, though a filter looks at its result
    rows, gone = repeated(docs, units, copies)
    both = rows.join(gone, (F.col("id") == F.col("gone_id")) & F.col("doc").eqNullSafe(F.col("gone_doc")), "left")
    # Texts that stay as they are pass by Python.
    some = F.col("gone").isNotNull()
    out = both.select("row", some.alias("some"), without(F.when(some, F.col("row.text")), "gone").alias("out"))
    return out.select("row", F.when(F.col("some"), F.col("out.clean")).otherwise(F.col("row.text")).alias("clean"), F.when(F.col("some"), F.col("out.gone")).otherwise(F.lit(0)).alias("gone"))


def line_dedup(docs: DataFrame, copies: bool = True) -> DataFrame:
    """`docs` with texts cleaned by `cleaned`, and n_chars to match; rows of which nothing is left go. Other columns, also of clashing names, stay as they are."""
    rows = cleaned(docs, Runs, copies)
    rows = rows.where((F.col("gone") == 0) | (F.trim(F.translate("clean", "\n\t\r", "   ")) != ""))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("gone") > 0, F.length("clean")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op5_line_chunks(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its text without repeated runs of lines, and the number of stretches removed."""
    rows = cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"), Runs)
    return rows.select("row.doc_id", F.col("clean").alias("text"), F.col("gone").alias("removed_chunks"))
