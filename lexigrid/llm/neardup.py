"""Near-duplicate groups of documents by ProbMinHash signatures, banding and verification.

A document is a weighted set: its word shingles with their counts. Every shingle is a Poisson process whose rate is its
weight; each arrival falls into one of `REGISTERS` registers, which keep the shingle that arrives first. Two documents
agree in a register with the probability Jaccard similarity of their weights. Arrivals are generated in rounds, and a
shingle stops when its next arrival is later than all registers of its document (early termination; exact).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .scratch import discard, reachable, stage
from .text import U, Words, buffers, mix, slices

REGISTERS, ROWS, SHINGLE = 128, 4, 3
#: Probability Jaccard from which two documents are near duplicates.
THRESHOLD = 0.5
#: A pair is verified unless its signatures agree in less than this share, about four standard errors below THRESHOLD.
ESTIMATE = 0.33
#: Share, about four standard errors above THRESHOLD, from which a pair counts as joined before it is verified.
CERTAIN = 0.67
#: Members of a bucket that one task pairs with as many others, and pairs of one document that one task verifies, about.
BLOCK = 1000
_GOLD = 0x9E3779B97F4A7C15


def weighted(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted by row and shingle."""
    row, value = words.shingles(n)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row))).astype(np.float64)


def prob_minhash(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures (rows x m, 32 bits of the first shingle); rows without shingles get zeros."""
    none = np.iinfo(np.uint64).max
    best = np.full(rows * m, none, np.uint64)
    total = np.bincount(row, weight, minlength=rows)
    with np.errstate(divide="ignore"):
        limit = np.where(total > 0, m * (np.log(m) + 6) / total, 0.0)
    todo = total > 0
    while todo.any():
        live = todo[row]
        r, h, w = row[live], value[live], weight[live]
        time, k = np.zeros(len(r)), 0
        while len(r):
            bits = mix(h + U((2 * k + 1) * _GOLD % (1 << 64)))
            time = time - np.log(((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            keep = time <= limit[r]
            r, h, w, time, bits = r[keep], h[keep], w[keep], time[keep], bits[keep]
            packed = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (h >> U(32))
            np.minimum.at(best, r * m + (bits & U(m - 1)).astype(np.int64), packed)
            k += 1
            if k & (k - 1) == 0 and len(r):  # the latest register of each row bounds what can still arrive
                worst = best.reshape(rows, m).max(axis=1)
                late = (worst >> U(32)).astype(np.uint32).view(np.float32).astype(np.float64) * (1 + 1e-6)
                limit = np.where(worst == none, limit, np.minimum(limit, late))
        todo &= best.reshape(rows, m).max(axis=1) == none
        best.reshape(rows, m)[todo] = none
        limit = np.where(todo, limit * 2, limit)
    best[best == none] = 0
    return (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(rows, m)


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted keys, weights), in n log n."""
    keys, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(keys):
        return 0.0
    x, y = a[1][ia], b[1][ib]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    ratio = y / x
    # Elements of b alone have an infinite ratio and those of a alone a ratio of zero.
    upto = np.searchsorted(ratio, ratio, side="right")
    cx = np.concatenate([[0.0], np.cumsum(x)])
    cy = np.concatenate([[0.0], np.cumsum(y)])
    only_a, only_b = a[1].sum() - cx[-1], b[1].sum() - cy[-1]
    return float(np.sum(1.0 / ((only_a + cx[upto]) / x + (only_b + cy[-1] - cy[upto]) / y)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, texts, check = batch.column(0), batch.column(1), batch.column(2)
        for lo, hi in slices(texts):
            words = Words(texts.slice(lo, hi - lo))
            some = np.flatnonzero(words.count > 0)
            if len(some):
                sig = (prob_minhash(*weighted(words), words.rows) & 0xFFFF).astype(np.uint16)[some]
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(some), [None, pa.py_buffer(np.ascontiguousarray(sig))])
                at = pa.array(some + lo)
                yield pa.record_batch([node.take(at), binary.cast(pa.binary()), check.take(at)], names=["node", "sig", "check"])


def node_of(text: Column) -> Column:
    """What stands for a text: texts of one node are equal if `check_of` them is equal too."""
    return F.xxhash64(text)


def check_of(text: Column) -> Column:
    """A second hash, independent of `node_of`, with the length: 96 bits and the length stand for a text."""
    return F.shiftleft(F.octet_length(text).cast("long"), 32) + F.crc32(text.cast("binary"))


def signatures(docs: DataFrame) -> DataFrame:
    """(node, sig, least, most) of every node that has a word: the signature of the text of the least check, and the range of checks."""
    node, check = node_of(F.col("text")), check_of(F.col("text"))
    rows = reachable(docs).where(F.col("text").isNotNull()).select(node.alias("node"), "text", check.alias("check"))
    signed = rows.mapInArrow(_sign, "node long, sig binary, check long")
    return signed.groupBy("node").agg(F.min_by("sig", "check").alias("sig"), F.min("check").alias("least"), F.max("check").alias("most"))


def bands(signed: DataFrame) -> DataFrame:
    """(band, node): as many rows a node as there are bands; band stands for the band's number and registers."""
    width = 2 * ROWS
    number = F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1))).alias("number")
    cut = F.col("sig").substr(F.col("number") * width + 1, F.lit(width))
    return signed.select("node", "sig", number).select(F.xxhash64("number", cut).alias("band"), "node")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text) sorted by a and b; the row with b = a, which comes first, has the text of a."""
    lead, base = None, None
    for batch in batches:
        a, b, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        own = batch.column(3).to_numpy(zero_copy_only=False)
        keep_a, keep_b, score = [], [], []
        for lo, hi in slices(texts):
            words = Words(texts.slice(lo, hi - lo))
            row, value, count = weighted(words)
            at = np.searchsorted(row, np.arange(words.rows + 1))
            for i in range(words.rows):
                part = value[at[i] : at[i + 1]], count[at[i] : at[i + 1]]
                if own[lo + i]:
                    lead, base = a[lo + i], (part[0].copy(), part[1].copy())
                elif base is not None and lead == a[lo + i]:
                    keep_a.append(a[lo + i])
                    keep_b.append(b[lo + i])
                    score.append(prob_jaccard(base, part))
        yield pa.record_batch([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])


def likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share, `share`, of at least ESTIMATE."""
    left, right = signed.toDF("a", "sa"), signed.toDF("b", "sb")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.mapInArrow(_agree, "a long, b long, share double")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
        share = (sa == sb).mean(axis=1)
        pairs = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")]
        yield pa.record_batch([*pairs, pa.array(share)], names=["a", "b", "share"]).filter(pa.array(share >= ESTIMATE))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b) by their texts (node, text). A text goes once to each pair that it is `b` of, and once for
    each BLOCK of pairs that it is `a` of, so that no task has all pairs of a large group."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1")
    pairs = pairs.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int"))
    ends = pairs.select("a", "part", "b", F.col("b").alias("node"), F.lit(False).alias("own"))
    leads = pairs.select("a", "part").distinct().select("a", "part", F.col("a").alias("b"), F.col("a").alias("node"), F.lit(True).alias("own"))
    ends = ends.union(leads)
    # Both sides grow with the corpus, so that neither is broadcast at any size.
    needed = texts.join(ends.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.min_by("text", check_of(F.col("text"))).alias("text"))
    rows = ends.join(needed, "node").select("a", "b", "text", "own", "part")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("own").desc(), "b")
    return rows.select("a", "b", "text", "own").mapInArrow(_verify, "a long, b long, similarity double")


def crossed(crowd: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of members (band, node, label) of one band that differ in label. Members of a large band are split
    into blocks, and every two blocks meet in a task of their own."""
    split = crowd.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("lo <> hi").select("band", "parts")
    tiles = crowd.join(split, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("band", F.least("own", "meets").alias("low"), F.greatest("own", "meets").alias("high"), "own", "node", "label")
    pairs = tiles.join(tiles.toDF("band", "low", "high", "its", "other", "their"), ["band", "low", "high"])
    pairs = pairs.where("node < other and label <> their and (low = high or own <> its)")
    return pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of nodes that join the near-duplicate groups, and (node, least) of nodes that stand for several texts.

    Step one compares the signature of every member of a bucket with that of the bucket's least node. Step two compares
    members with each other that this leaves in different groups, where only a share of CERTAIN joins. So every pair
    that shares a bucket is either compared or already joined. All pairs of at least ESTIMATE are then verified by their
    texts, in one pass over these.
    """
    every = stage(signatures(docs), "signatures")
    signed = every.select("node", "sig")
    mixed = stage(every.where("least <> most").select("node", "least"), "mixed")
    texts = docs.where(F.col("text").isNotNull()).select(node_of(F.col("text")).alias("node"), "text")
    keyed = bands(signed).repartition("band")
    size = keyed.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").select("band", "a")
    crowd = stage(keyed.join(size.hint("merge"), "band"), "crowd")
    star = crowd.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = stage(likely(star, signed), "likely")
    label = components(first.where(F.col("share") >= CERTAIN).select("a", "b"))
    named = crowd.join(label, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    both = stage(first.union(likely(crossed(named).join(star, ["a", "b"], "left_anti"), signed)), "likely")
    discard(every, crowd, first, label)
    good = stage(verified(both.select("a", "b"), texts), "links")
    discard(both)
    return good.where(F.col("similarity") >= threshold).select("a", "b"), mixed


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, check, label): the near-duplicate group of every row of `docs`.

    Texts that are equal are one node. A null, empty or wordless text is in no group: its label is null. Of different texts
    of one node, which need equal hashes, only that of the least check is compared; the others are in no group. Repeated
    rows are copies of each other. Texts of any length are looked at as a whole. An empty table gives an empty table.
    """
    pairs, mixed = links(docs, threshold)
    label = components(pairs)
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"), check_of(F.col("text")).alias("check"), wordy.alias("wordy"))
    rows = rows.join(label, "node", "left").join(mixed, "node", "left")
    alone = ~F.col("wordy") | (F.col("least").isNotNull() & (F.col("least") != F.col("check")))
    return rows.select("doc_id", "node", "check", F.when(~alone, F.coalesce("label", "node")).alias("label"))


def marked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, copies, keep, node, check): one row a row of `docs`.

    `group_id` is the least doc_id of the group and `copies` its number of rows. One row of each group is kept, the
    one of the least doc_id (nulls last), then of the least node; of rows equal in both, any one. Rows in no
    group (see `groups`) are kept, with copies 1.
    """
    rows = stage(groups(docs, threshold), "groups")
    top = F.lit((1 << 63) - 1)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", top).alias("doc"), F.col("node").alias("at"))
    best = rows.where("label is not null").groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("copies"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "node", "label").orderBy(F.lit(0)))
    rows = rows.withColumn("turn", turn).join(best, "label", "left")
    same = F.col("node").eqNullSafe(F.col("best.at")) & F.col("doc_id").eqNullSafe(F.when(~F.col("best.none"), F.col("best.doc")))
    return rows.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).when(~F.col("best.none"), F.col("best.doc")).alias("group_id"),
        F.coalesce("copies", F.lit(1).cast(T.LongType())).alias("copies"),
        (F.col("label").isNull() | (same & (F.col("turn") == 1))).alias("keep"),
        "node",
        "check",
    )


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each near-duplicate group, as `marked` chooses it; all columns stay as they are.

    Works for nulls in any column, repeated rows, wordless texts and further columns of any name.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), node_of(F.col("text")).alias("node"), check_of(F.col("text")).alias("check"))
    gone = marked(docs, threshold).where(~F.col("keep")).groupBy(F.col("doc_id").alias("gone_doc"), F.col("node").alias("gone_node"), F.col("check").alias("gone_check")).agg(F.count(F.lit(1)).alias("gone"))
    both = rows.join(gone, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("node") == F.col("gone_node")) & (F.col("check") == F.col("gone_check")), "left")
    turn = F.row_number().over(Window.partitionBy("doc", "node", "check").orderBy(F.lit(0)))
    return both.withColumn("turn", turn).where(F.col("turn") > F.coalesce("gone", F.lit(0))).select("row.*")


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its near-duplicate group, the group's size, and whether the row stays."""
    return marked(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("node", "check")
