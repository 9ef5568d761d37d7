"""Media columns: payloads addressed by content in tar shards, and metadata read from their headers only.

Every task writes the payloads of its rows to tar files in the shared folder as it scans them, so that payloads aren't
shuffled; what occurs again elsewhere is found by digest before and written once. Payloads of text kinds are stored
deflated, which a reader can begin to inflate from the first bytes. Rows keep digest, shard, offset and length, and a
second pass reads the first `HEADER_BYTES` of each payload at its place, and further small ranges only where its header goes on
elsewhere, to fill metadata columns.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, reachable, stage

#: Bytes of a payload that are read for its metadata, and of a shard, about.
HEADER_BYTES, SHARD_BYTES = 1024, 256 << 20
#: So many repeated digests at most are broadcast; more are joined.
BROADCAST_ROWS = 100_000
PLACE = "digest string, shard string, offset long, length long, encoding string, raw_length long"
META = "mime string, width int, height int, channels int, sample_rate int, seconds double, charset string, language string, title string"


Ranges = Callable[[int, int], bytes]


def header(data: bytes, length: int, more: Ranges | None = None) -> dict:
    """Metadata of a payload of `length` bytes: PNG, GIF, JPEG, BMP, WAV, NPY, PDF, HTML or other text.

    `data` are its first bytes, and `more(offset, size)` reads a range of it, for the segments of a JPEG and for an HTML head
    that go beyond; without it what isn't in `data` is null. A header that can't be read gives its mime type alone.
    """
    try:
        return _header(data, length, more or (lambda at, size: data[at : at + size]))
    except (ValueError, struct.error, IndexError, OverflowError):
        return {"mime": _header(data[:12].ljust(12, b"\0"), 12, lambda at, size: b"")["mime"]}


def _header(data: bytes, length: int, more: Ranges) -> dict:
    out: dict = {"mime": "application/octet-stream"}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 26:
        w, h, _, color = struct.unpack(">IIBB", data[16:26])
        out = {"mime": "image/png", "width": w if w < 1 << 31 else None, "height": h if h < 1 << 31 else None, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)}
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        w, h = struct.unpack("<HH", data[6:10])
        out = {"mime": "image/gif", "width": w, "height": h, "channels": 1}
    elif data[:2] == b"BM" and len(data) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        out = {"mime": "image/bmp", "width": w, "height": min(abs(h), (1 << 31) - 1), "channels": max(1, bits // 8)}
    elif data[:3] == b"\xff\xd8\xff":
        out, at = {"mime": "image/jpeg"}, 2
        while len(part := data[at : at + 10] if at + 10 <= len(data) else more(at, 10)) >= 4 and part[0] == 0xFF:
            kind, size = part[1], struct.unpack(">H", part[2:4])[0]
            if kind == 0xFF:  # a fill byte
                at += 1
                continue
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                if len(part) == 10:
                    h, w = struct.unpack(">HH", part[5:9])
                    out |= {"width": w, "height": h, "channels": part[9]}
                break
            if kind == 0xDA or size < 2:
                break
            at += 2 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WAVE" and len(data) >= 36:
        channels, rate, per_second = struct.unpack("<HII", data[22:32])
        out = {"mime": "audio/wav", "channels": channels, "sample_rate": rate if rate < 1 << 31 else None, "seconds": max(length - 44, 0) / per_second if per_second else None}
    elif data[:6] == b"\x93NUMPY":
        shape = re.search(rb"'shape':\s*\(([^)]*)\)", data)
        sizes = [int(x.strip().rstrip(b"L")) for x in shape[1].split(b",") if x.strip()] if shape else []
        sizes = [x if 0 <= x < 1 << 31 else None for x in sizes]
        out = {"mime": "application/x-npy", "height": sizes[0] if sizes else None, "width": sizes[1] if len(sizes) > 1 else None}
    elif data[:5] == b"%PDF-":
        out = {"mime": "application/pdf"}
    elif re.match(rb"\s*(<!doctype html|<html)", data, re.I):
        while not re.search(rb"</head|<body", data, re.I) and (rest := more(len(data), max(HEADER_BYTES, len(data)))):
            data += rest
        find = lambda p: (m := re.search(p, data, re.I | re.S)) and m[1].decode("utf-8", "replace")
        out = {"mime": "text/html", "charset": find(rb"<meta[^>]*charset=[\"']?([\w-]+)"), "language": find(rb"<html[^>]*\blang=[\"']?([\w-]+)"), "title": find(rb"<title[^>]*>(.*?)</title>")}
    elif data and b"\0" not in data:
        out = {"mime": "text/plain"}
    return out


class Shards:
    """Tar files of one task below a URI; a new one begins at SHARD_BYTES. Names hold a fresh id, so that a task that is run again never touches what another has written."""

    def __init__(self, folder: str):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.folder, self.out, self.at = folder, None, 0

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        """(shard, offset of the payload)."""
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.fs.create_dir(self.root, recursive=True)
            self.name, self.at = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + (-len(data) % 512)
        return self.name, offset

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, payload, digest, elsewhere) -> (row, place)."""
        shards, kept = Shards(folder), {}
        try:
            for batch in batches:
                places = []
                for payload, digest, elsewhere, again in zip(*(batch.column(k) for k in range(1, 5))):
                    if not payload.is_valid:
                        places.append(None)
                        continue
                    data, name = payload.as_py(), digest.as_py()
                    place = kept.get(name)
                    if place is None:
                        text = header(data[:HEADER_BYTES], len(data))["mime"].startswith("text/")
                        stored = zlib.compress(data, 6) if text else data
                        shard, offset = (None, None) if elsewhere.as_py() else shards.add(name + ".zz" * text, stored)
                        place = {"digest": name, "shard": shard, "offset": offset, "length": len(stored), "encoding": "deflate" if text else "none", "raw_length": len(data)}
                        if again.as_py():
                            kept[name] = place
                    places.append(place)
                kind = pa.struct([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("encoding", pa.string()), ("raw_length", pa.int64())])
                yield pa.record_batch([batch.column(0), pa.array(places, kind)], names=["row", "place"])
        finally:
            shards.close()

    return run


def stored(table: DataFrame, payload: str, key: str, folder: str) -> DataFrame:
    """(row, place): the other columns of `table` in the struct `row`, and where its payload is, a struct of PLACE.

    A digest that occurs again is written where its least `key` is; where rows also agree in that, each task that has one
    writes it, and all rows point to the first of these. Null payloads have no place; empty ones have.
    """
    content = F.col(f"`{payload}`").cast("binary")
    rows = reachable(table).select(F.struct(*[F.col(f"`{c}`") for c in table.columns if c != payload]).alias("row"), content.alias("payload"), F.sha2(content, 256).alias("digest"), F.col(f"`{key}`").alias("key"))
    some = rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("owner")).where("n > 1").select(F.col("digest").alias("twice"), "owner")
    some = stage(some, "repeated")
    small = some.count() <= BROADCAST_ROWS
    marked = rows.join(F.broadcast(some) if small else some.hint("merge"), F.col("digest") == F.col("twice"), "left")
    marked = marked.select("row", "payload", "digest", (F.col("twice").isNotNull() & ~F.col("key").eqNullSafe(F.col("owner"))).alias("elsewhere"), F.col("twice").isNotNull().alias("again"))
    kind = table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns if c != payload]).alias("row")).schema["row"].dataType.simpleString()
    placed = stage(marked.mapInArrow(_write(folder), f"row {kind}, place struct<{PLACE.replace(' ', ':').replace(',:', ',')}>"), "placed")
    found = placed.where("place.shard is not null").join(some, F.col("place.digest") == F.col("twice"), "left_semi")
    found = found.groupBy(F.col("place.digest").alias("of")).agg(F.min(F.struct("place.shard", "place.offset")).alias("first"))
    found = F.broadcast(found) if small else found
    both = placed.join(found, F.col("place.digest") == F.col("of"), "left")
    first = lambda k: F.coalesce(f"first.{k}", f"place.{k}").alias(k)
    place = F.struct("place.digest", first("shard"), first("offset"), "place.length", "place.encoding", "place.raw_length")
    return both.select("row", F.when(F.col("place").isNotNull(), place).alias("place"))


def read(folder: str, shard: str, offset: int, length: int, encoding: str) -> bytes:
    """A whole payload by its place."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{shard}") as f:
        data = f.read_at(length, offset)
    return zlib.decompress(data) if encoding == "deflate" else data


def _plain(file, place: dict) -> Ranges:
    return lambda at, size: file.read_at(max(0, min(size, place["length"] - at)), place["offset"] + at)


def _inflated(file, place: dict) -> Ranges:
    """Ranges of a deflated payload, of which no more is read than they need."""
    inflate, have, read = zlib.decompressobj(), bytearray(), 0

    def more(at: int, size: int) -> bytes:
        nonlocal read
        while len(have) < at + size and read < place["length"]:
            data = file.read_at(min(HEADER_BYTES, place["length"] - read), place["offset"] + read)
            read += len(data)
            have.extend(inflate.decompress(data))
        return bytes(have[at : at + size])

    return more


def with_metadata(places: DataFrame, folder: str) -> DataFrame:
    """(row, place, meta): `meta` is a struct of META from the header of each payload, read at its place; null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        name = file = last = meta = None
        for batch in batches:
            out = []
            for place in batch.column(1).to_pylist():
                if place is None:
                    out.append(None)
                    continue
                if place["shard"] != name:
                    if file is not None:
                        file.close()
                    name, file = place["shard"], fs.open_input_file(f"{root}/{place['shard']}")
                if last != (name, place["offset"]):
                    more = _inflated(file, place) if place["encoding"] == "deflate" else _plain(file, place)
                    last, meta = (name, place["offset"]), header(more(0, HEADER_BYTES), place["raw_length"], more)
                out.append(meta)
            kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
            kind = pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in META.split(", ")])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, kind)], names=["row", "place", "meta"])
        if file is not None:
            file.close()

    kind = {f.name: f.dataType.simpleString() for f in places.schema}
    near = places.repartition("place.shard").sortWithinPartitions("place.shard", "place.offset")
    return near.mapInArrow(run, f"row {kind['row']}, place {kind['place']}, meta struct<{META.replace(' ', ':').replace(',:', ',')}>")


def media_columns(table: DataFrame, payload: str, key: str, folder: str | None = None) -> DataFrame:
    """`table` with the column `payload` replaced by its place in `folder` (PLACE) and its metadata (META); a column of `table` whose name is among these stays, and the new one gets a trailing underscore.

    Repeated rows and an empty table are allowed, as are null and empty payloads (see `stored`). Payloads of any length are stored
    whole, each within the memory of one task; headers that are broken give a mime type and nulls.
    """
    folder = folder or fresh(table.sparkSession, "media")
    rows = with_metadata(stored(table, payload, key, folder), folder)
    own = [c for c in table.columns if c != payload]
    name = lambda c: c + "_" * (c.lower() in {x.lower() for x in own})
    new = [F.col(f"{k}.{c.split()[0]}").alias(name(c.split()[0])) for k, kinds in (("place", PLACE), ("meta", META)) for c in kinds.split(", ")]
    return rows.select(*[F.col(f"row.`{c}`") for c in own], *new)


def op10_media(spark, sf_dir: str) -> DataFrame:
    """All pages, with their HTML as payloads in tar shards of the shared folder."""
    return media_columns(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", "page_id")
