"""Token-id matrices: best-fit-decreasing packing of tokenised documents into sequences of equal length.

Documents go to shards by a hash of doc_id and text; a shard is tokenised and packed by one task. Texts are cut where the pre-tokens
of byte-level BPE certainly end (at a single blank or newline between other characters), every distinct cut is encoded
once in a batch, and equality of bytes, not only of hashes, is checked before ids are reused.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, reachable
from .text import buffers, slices, span_hashes

#: Ranks of a byte-level BPE of fewer than 65536 ids, and the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of a sequence, and what fills it up.
LENGTH, PAD = 2048, 50256
#: Bytes of text of a shard, about.
SHARD_BYTES = 24 << 20
#: Tasks that shards are spread over at most.
MOST_PARTS = 50_000
_loaded: dict[str, tuple] = {}


def encoder(path: str):
    """(encoding, bytes of each id) of a rank file; kept by each worker."""
    if path not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _loaded[path]


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces that can be encoded by themselves: rows, and single blanks or newlines between characters that surely are no white space."""
    graph = (raw > 32) & (raw < 127)
    lead = ((raw >= 0xC3) & (raw <= 0xDF)) | ((raw >= 0xE4) & (raw <= 0xF4))
    tail = np.zeros(len(raw), bool)  # the last byte of a two-byte letter that isn't in the block of the no-break space
    tail[1:] = (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
    good = np.zeros(len(raw), bool)
    if len(raw) > 2:
        good[1:-1] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & (graph | tail)[:-2] & (graph | lead)[2:]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    good[starts] = True
    inside = offsets[1:-1]
    inside = inside[(inside > 0) & (inside < len(raw))]
    good[inside] = True
    last = inside - 1  # a row's last character is followed by nothing
    good[last[(~np.isin(last, starts))]] = False
    return np.flatnonzero(good)


def encode(texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text in them): exactly those that the tokenizer gives."""
    enc, size = encoder(path)
    raw, offsets = buffers(texts)
    if not len(raw):
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    start = _cuts(raw, offsets)
    end = np.append(start[1:], len(raw))
    _, first, which = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
    width = end - start
    pick = lambda at: np.repeat(start[at] - np.cumsum(width[at]) + width[at], width[at]) + np.arange(width[at].sum())
    own = raw[pick(first)]
    ids = _encode_rows(enc, own, width[first])
    ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum(width[first]))
    begin, stop = np.concatenate([[0], ends[:-1] + 1]), ends + 1
    source = np.repeat((np.cumsum(width[first]) - width[first])[which] - np.cumsum(width) + width, width) + np.arange(width.sum()) if (width == width[first][which]).all() else None
    if source is None or not np.array_equal(own[source], raw[start[0] :]):
        out = [np.asarray(enc.encode_ordinary(t or ""), np.uint16) for t in texts.to_pylist()]  # two contents of one hash
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])
    count = (stop - begin)[which]
    at = np.repeat(begin[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
    total = np.concatenate([[0], np.cumsum(count)])
    return ids[at].astype(np.uint16), total[np.searchsorted(start, offsets)]


def _encode_rows(enc, raw: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Ids of pieces one after another. A piece that starts with a blank or newline may follow any other that doesn't end
    with one, and so such pieces are encoded as one text; the others one by one."""
    upto = np.cumsum(width)
    begin = upto - width
    edge = np.isin(raw[begin], [32, 10]) & (width > 1)
    ends_white = np.isin(raw[upto - 1], [9, 10, 11, 12, 13, 32]) | (raw[upto - 1] >= 0x80)
    joined = edge.copy()
    joined[1:] &= ~ends_white[:-1]
    plain = (raw[np.minimum(begin + 1, len(raw) - 1)] > 32)
    joined &= plain
    joined[:1] = False
    parts = np.append(np.flatnonzero(~joined), len(width))
    data = raw.tobytes()
    out = [np.asarray(enc.encode_to_numpy(data[begin[a] : upto[b - 1]].decode("utf-8")), np.int64) for a, b in zip(parts[:-1], parts[1:])]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Rooms:
    """Bins by free room: the smallest room of at least a size is found in a segment tree over room sizes."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest bin, no longer in the tree; None if there is none."""
        at, tree = size + self.size, self.tree
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.size
        which = self.bins[room].pop()
        while at:
            tree[at] -= 1
            at >>= 1
        return room, which


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each piece (each at most `length`), by best fit in order of decreasing size; ties in the given order."""
    rooms, out, used = Rooms(length), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = rooms.take(size)
        room, which = found if found else (length, used)
        used += found is None
        out[i] = which
        if room > size:
            rooms.add(room - size, which)
    return out


COLUMNS = "shard int, sequence int, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


def _packed(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, doc_id, text) of whole shards, sorted by shard and doc_id."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a:
                    if held and held[-1].column(0)[0].as_py() != shard[a]:
                        yield from _matrix(held, path, length)
                        held = []
                    held.append(_tokens(batch.slice(a, b - a), path))
        if held:
            yield from _matrix(held, path, length)

    return run


def _tokens(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    """(shard, doc_id, ids as bytes): of the texts only their ids are kept."""
    values, sizes = [np.zeros(0, np.uint16)], []
    for lo, hi in slices(batch.column(2)):
        ids, offsets = encode(batch.column(2).slice(lo, hi - lo), path)
        values.append(ids)
        sizes.append(np.diff(offsets))
    upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) * 2
    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(upto), pa.py_buffer(np.concatenate(values))])
    return pa.record_batch([batch.column(0), batch.column(1), data], names=["shard", "doc_id", "ids"])


def _matrix(held: list[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    shard = held[0].column(0)[0].as_py()
    docs = pa.concat_arrays([b.column(1) for b in held])
    ids = np.concatenate([np.frombuffer(b.column(2).buffers()[2] or b"", np.uint16) for b in held])
    size = np.concatenate([np.diff(np.frombuffer(b.column(2).buffers()[1], np.int64)) for b in held]) // 2
    first = np.cumsum(size) - size
    times = -(-size // length)
    row = np.repeat(np.arange(len(size)), times)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)) * length
    piece = np.minimum(size[row] - begin, length)
    bins = best_fit(piece, length)
    order = np.lexsort((np.arange(len(row)), -piece, bins))
    row, begin, piece, bins = row[order], begin[order], piece[order], bins[order]
    edges = np.searchsorted(bins, np.arange(bins[-1] + 2 if len(bins) else 1))
    for lo in range(0, len(edges) - 1, 512):
        part = edges[lo : lo + 513]
        n = len(part) - 1
        a, b = part[0], part[-1]
        matrix = np.full((n, length), PAD, np.uint16)
        upto = np.cumsum(piece[a:b])
        base = np.concatenate([[0], upto])[part[:-1] - a]
        seq = bins[a:b] - lo
        slot = upto - piece[a:b] - base[seq]
        source = np.repeat(first[row[a:b]] + begin[a:b] - upto + piece[a:b], piece[a:b]) + np.arange(upto[-1])
        matrix.reshape(-1)[np.repeat(seq * length + slot - upto + piece[a:b], piece[a:b]) + np.arange(upto[-1])] = ids[source]
        total = np.bincount(seq, piece[a:b], minlength=n).astype(np.int32)
        where = pa.array((part - a).astype(np.int32))
        bounds = np.insert((slot + piece[a:b]).astype(np.int32), part[:-1] - a, 0)
        cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), n, [None, pa.py_buffer(matrix)])
        yield pa.record_batch(
            [
                pa.array(np.full(n, shard, np.int32)),
                pa.array(np.arange(lo, lo + n, dtype=np.int32)),
                cells.cast(pa.binary()),
                pa.array(total),
                pa.ListArray.from_arrays(pa.array((part - a + np.arange(n + 1)).astype(np.int32)), pa.array(bounds)),
                pa.ListArray.from_arrays(where, pa.array(slot.astype(np.int32))),
                pa.ListArray.from_arrays(where, docs.take(pa.array(row[a:b]))),
                pa.ListArray.from_arrays(where, pa.array(begin[a:b].astype(np.int64))),
            ],
            names=[c.split()[0] for c in COLUMNS.split(", ")],
        )


def packed_ids(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a packed sequence: `ids` (`length` little-endian uint16, filled up with PAD), cumulative segment lengths
    `cu_seqlens`, `position_resets` (where positions start at 0 again), and for each segment its doc_id and the token
    of the document that it starts with.

    Documents longer than `length` are cut into pieces, none of which is lost. Null and empty texts have no tokens and are
    in no sequence; repeated rows are packed as often as they occur; other columns aren't looked at; an empty table packs to
    none. Within a shard,
    documents go by doc_id (nulls first) and a hash of the text, so that ties are resolved alike in each run.
    """
    return _sharded(docs, shard_bytes).mapInArrow(_packed(path, length), COLUMNS)


def _sharded(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, doc_id, text) with whole shards in each partition, one after another. Rows without a doc_id are spread by their texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    each = -(-shards // MOST_PARTS)
    shard = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(shards)).cast("int")
    rows = reachable(docs).where(F.octet_length("text") > 0).select(shard.alias("shard"), "doc_id", "text")
    rows = rows.repartitionById(int(-(-shards // each)), (F.col("shard") / each).cast("int"))
    return rows.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


FILES = COLUMNS.replace("ids binary", "file string, offset long")


def written_ids(docs: DataFrame, folder: str, path: str = VOCABULARY, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """As `packed_ids`, with the ids in files below the URI `folder`: `file` and the byte `offset` of the sequence in it take
    the place of `ids`.

    Each shard has `NAME.ids` (a row-major uint16 matrix), and for its sequences in order `NAME.lens` (int32, their
    cumulative segment lengths, each sequence from 0 to its number of tokens), and `NAME.resets` (int32, the places in the
    row-major matrix where positions start at 0 again). Names hold a fresh id, so that a task that is run again never touches
    what another has written; rows name the files of the one that counts.
    """
    pack = _packed(path, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        shard, name, out, at = None, "", [], 0
        try:
            for batch in pack(batches):
                if batch.column(0)[0].as_py() != shard:
                    for f in out:
                        f.close()
                    shard, at = batch.column(0)[0].as_py(), 0
                    name = f"shard-{shard:07d}-{uuid.uuid4().hex[:12]}"
                    out = [fs.open_output_stream(f"{root}/{name}.{kind}") for kind in ("ids", "lens", "resets")]
                n, lists = len(batch), batch.column(5)
                cells = np.frombuffer(batch.column(2).buffers()[2], np.uint8)
                begin = at // (2 * length) + np.arange(n)
                out[0].write(cells[: 2 * length * n].tobytes())
                out[1].write(batch.column(4).values.to_numpy().astype("<i4").tobytes())
                owner = np.repeat(begin, np.diff(lists.offsets.to_numpy()))
                out[2].write((lists.values.to_numpy() + owner * length).astype("<i4").tobytes())
                where = pa.array(at + 2 * length * np.arange(n, dtype=np.int64))
                at += 2 * length * n
                columns = [*batch.columns[:2], pa.array([f"{name}.ids"] * n), where, *batch.columns[3:]]
                yield pa.record_batch(columns, names=[c.split()[0] for c in FILES.split(", ")])
        finally:
            for f in out:
                f.close()

    return _sharded(docs, shard_bytes).mapInArrow(run, FILES)


def unpacked(rows: list, path: str = VOCABULARY) -> dict:
    """Texts by doc_id of collected rows of `packed_ids` (each doc_id once): the round trip."""
    enc, _ = encoder(path)
    pieces: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], np.uint16)
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["doc_starts"])):
            pieces.setdefault(doc, []).append((start, ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]))
    return {doc: enc.decode(np.concatenate([x for _, x in sorted(p, key=lambda q: q[0])]).tolist()) for doc, p in pieces.items()}


def read_ids(folder: str, file: str, offset: int, length: int = LENGTH) -> bytes:
    """The ids of one sequence of `written_ids`."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{file}") as f:
        return f.read_at(2 * length, offset)


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    """All documents as packed matrices of token ids in files of the shared folder, with what the sequences are made of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh(spark, "token-ids")
    return written_ids(docs, folder).withColumn("file", F.concat(F.lit(folder + "/"), "file"))
