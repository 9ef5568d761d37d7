"""Operators against brute-force versions, exact round trips and held-out labels, on the smallest tables."""

import io
import itertools
import re
import struct
import tarfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import curvepack, licenses, linechunks, media, neardup, prefixhash, quality, scratch, tokenbin, toxicity
from lexigrid.llm.text import Words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def bag(text):
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())
    n = neardup.SHINGLE
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def prob_jaccard(x, y):
    both = x.keys() & y.keys()
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in both)


def test_prob_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = (Counter({int(k): int(v) for k, v in zip(rng.choice(30, 12, False), rng.integers(1, 6, 12))}) for _ in range(2))
        a, b = ((np.array(sorted(c)), np.array([c[k] for k in sorted(c)], float)) for c in (x, y))
        assert neardup.prob_jaccard(a, b) == pytest.approx(prob_jaccard(x, y))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 600)]
    for rate in (0.02, 0.05, 0.1):
        other = [w if rng.random() > rate else "new" + w for w in base]
        signed = neardup.prob_minhash(*neardup.weighted(Words(pa.array([" ".join(base), " ".join(other)]))), 2, m=1024)
        assert (signed[0] == signed[1]).mean() == pytest.approx(prob_jaccard(bag(" ".join(base)), bag(" ".join(other))), abs=0.06)


def test_near_duplicates_recall(docs, texts):
    bags = {k: bag(v) for k, v in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(bags), 2) if bags[a].keys() & bags[b].keys() and prob_jaccard(bags[a], bags[b]) >= neardup.THRESHOLD]
    marks = neardup.marked(docs).collect()
    group = {r.doc_id: r.group_id for r in marks}
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs) > 0
    joined = {x for p in pairs for x in p}
    assert all(r.copies == 1 and r.keep for r in marks if r.doc_id not in joined)
    members = defaultdict(list)
    for r in marks:
        members[r.group_id].append(r)
    assert all(sum(r.keep for r in g) == 1 and len(g) == g[0].copies for g in members.values())


def test_line_chunks(docs, texts):
    whole = defaultdict(list)
    for k, v in sorted(texts.items()):
        c = linechunks.Chunks(pa.array([v]))
        for i, (a, b, ok) in enumerate(zip(c.start, c.body, c.whole)):
            if ok:
                whole[v.encode()[a:b]].append((k, i))
    gone = {p for places in whole.values() for p in places[1:]}
    want = {}
    for k, v in texts.items():
        c = linechunks.Chunks(pa.array([v]))
        want[k] = b"".join(v.encode()[a:b] for i, (a, b) in enumerate(zip(c.start, c.end)) if (k, i) not in gone).decode()
    got = {r.doc_id: r.clean for r in linechunks.cleaned(docs).select("row.doc_id", "clean").collect()}
    assert gone and got == want


def test_repeated_runs_go_in_any_context(spark):
    rng = np.random.default_rng(4)
    line = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 10**6, n))
    passages = [[line(60 // n + 1) for _ in range(n)] for n in (2, 3, 4, 8) for _ in range(20)]
    passages.append([line(30), "", "\t", line(30)])
    passages.append(["\t".join(line(50).split())])  # words by any white space
    short = line(10)
    docs, want = {}, {}
    for k in range(3):
        for p, passage in enumerate(passages):
            before, after = ([line(12) for _ in range(rng.integers(1, 4))] for _ in range(2))
            docs[k * 1000 + p] = "\n".join([short, *before, *passage, *after, short])
            want[k * 1000 + p] = docs[k * 1000 + p] if k == 0 else docs[k * 1000 + p].replace("\n".join(passage) + "\n", "")
    docs[5000] = want[5000] = "  ".join(line(30).split())  # 30 words, not 59
    docs[5001] = want[5001] = docs[5000]
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = linechunks.cleaned(table, linechunks.Runs).select("row.doc_id", "clean", "gone").collect()
    assert {r.doc_id: r.clean for r in rows} == want
    assert {r.doc_id: r.gone for r in rows} == {k: int(1000 <= k < 5000) for k in docs}
    assert {r.doc_id: r.text for r in linechunks.line_dedup(table).collect()} == want


def test_runs(docs, texts):
    places, found = defaultdict(list), {}
    for k, v in sorted(texts.items()):
        found[k] = lines = v.splitlines(keepends=True)
        full = [i for i, x in enumerate(lines) if x.split()]
        for i, j in [*zip(full, full[1:]), *((i, i) for i in full if len(lines[i].split()) >= 50)]:
            places["".join(lines[i : j + 1]).removesuffix("\n")].append((k, i, j))
    gone = {(k, x) for p in places.values() for k, i, j in sorted(p)[1:] for x in range(i, j + 1)}
    want = {k: "".join(x for i, x in enumerate(lines) if (k, i) not in gone) for k, lines in found.items()}
    got = {r.doc_id: r.clean for r in linechunks.cleaned(docs, linechunks.Runs).select("row.doc_id", "clean").collect()}
    assert gone and got == want


def test_shifted_chunks_meet():
    rng = np.random.default_rng(1)
    lines = [" ".join(f"t{x}" for x in rng.integers(0, 99, 6)) for _ in range(60)]
    a, b = (set(linechunks.Chunks(pa.array(["\n".join(x)])).hash) for x in (lines, ["one more", *lines]))
    assert len(a & b) >= len(a) - 3


def test_quality_and_toxicity_held_out(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = quality.fit(table, train)
    rows = quality.scored(table, model).select("row.doc_id", "keep", "score").join(test, "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in rows]) >= 0.95
    stats = quality.statistics(table, F.col("text")).select("doc_id", "stat.*").toPandas().set_index("doc_id")
    want = dict(zip(stats.index, model.predict(stats.to_numpy())))
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) for r in rows)
    rows = toxicity.scored(table, toxicity.fit(table, train)).select("row.doc_id", F.col("toxic").alias("said")).join(test, "doc_id").collect()
    assert np.mean([r.said == (r.toxic == 1) for r in rows]) >= 0.9


def test_hilbert_is_a_continuous_bijection():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = curvepack.hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_packing(docs, texts):
    rows = curvepack.pack(docs, 500).collect()
    keys = {r.doc_id: r.curve_key for r in rows}
    start, want = 0, []
    for k in sorted(keys, key=lambda k: (keys[k], k)):
        n = len(texts[k].split())
        want += [(k, s, max(start, s * 500) - s * 500, min(start + n, (s + 1) * 500) - max(start, s * 500)) for s in range(start // 500, (start + n - 1) // 500 + 1)]
        start += n
    assert sorted((r.doc_id, r.sequence, r.sequence_start, r.n_tokens) for r in rows) == sorted(want)
    assert {k: "".join(r.text for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.doc_start)) for k in keys} == {k: texts[k] for k in keys}


def test_token_ids_round_trip(docs, texts):
    rows = tokenbin.packed_ids(docs, length=256, shard_bytes=100_000).collect()
    assert tokenbin.unpacked(rows) == texts
    enc, _ = tokenbin.encoder(tokenbin.VOCABULARY)
    odd = ["", " ", "a  b", "é è  ü", "x y z　", "don't 12 !!\n\nb \n c", "\n\n", "日本 語", "a\n", " 😀 a"]
    ids, at = tokenbin.encode(pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [enc.encode_ordinary(x) for x in odd]


def test_best_fit_is_best_fit():
    sizes = np.random.default_rng(2).integers(1, 60, 400)
    got, free = tokenbin.best_fit(sizes, 64), []
    for i in np.argsort(-sizes, kind="stable"):
        room = min((f for f in free if f >= sizes[i]), default=None)
        if room is None:
            free.append(64 - sizes[i])
        else:
            free[free.index(room)] -= sizes[i]
    used = np.bincount(got, sizes)
    assert used.max() <= 64 and sorted(64 - used) == sorted(free)


def test_licenses(spark):
    header = licenses.TEMPLATES["Apache-2.0-header"].split()
    worn = header[:20] + ["really"] + header[20:40] + header[42:]
    table = spark.createDataFrame([(1, "x y z " + " ".join(worn) + " tail"), (2, "no notice of that kind here"), (3, "foo\nReleased under the MIT License.\nbar")], "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.license_matches(table).collect()}
    assert (3, "MIT-notice") in got and not any(k[0] == 2 for k in got)
    assert got[1, "Apache-2.0-header"].word_start == 3 and 0.9 < got[1, "Apache-2.0-header"].coverage < 1
    r = got[3, "MIT-notice"]
    assert "foo\nreleased under the mit license.\nbar"[r.byte_start : r.byte_end] == "released under the mit license"


def test_fingerprints(docs, texts, spark):
    a, b = np.frombuffer(b"abcabcabx" * 20, np.uint8), np.frombuffer(b"zabcabcaby" * 20, np.uint8)
    pa_, pb = prefixhash.Prefixes(a), prefixhash.Prefixes(b)
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, len(a), 200), rng.integers(0, len(b), 200)
    got = prefixhash.extend(pa_, i, pb, j, np.minimum(len(a) - i, len(b) - j))
    left = prefixhash.extend(pa_, i, pb, j, np.minimum(i, j), back=True)
    for x, y, n, m in zip(i, j, got, left):
        k = next((k for k in range(min(len(a) - x, len(b) - y)) if a[x + k] != b[y + k]), min(len(a) - x, len(b) - y))
        assert n == k and (a[x - m : x] == b[y - m : y]).all() and (m == min(x, y) or a[x - m - 1] != b[y - m - 1])
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {k for k, v in texts.items() for r in items.collect() if r.text in v}
    rows = prefixhash.fingerprints(docs, items).collect()
    assert whole <= {r.doc_id for r in rows if r.item_id is not None}
    first = {}
    for k in sorted(texts):
        first.setdefault(texts[k], k)
    assert {r.doc_id: r.copy_of for r in rows} == {k: first[v] for k, v in texts.items()}


def test_fingerprints_of_several_passages(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b, c, d = (word(n) for n in (90, 70, 80, 60))
    items = {1: a, 2: b, 3: c + d, 4: a, 5: d + word(50), 6: word(100)}
    table = {1: "x" + a + "é" + b + "--" + a, 2: c + "!" + d, 3: c + d, 4: b[:60] + "?" + b[10:], 5: word(200), 6: "", 7: None}

    def maximal(x, y):
        x, y = x.encode(), y.encode()
        for i, j in itertools.product(range(len(x)), range(len(y))):
            if x[i] == y[j] and (i == 0 or j == 0 or x[i - 1] != y[j - 1]):
                n = next((n for n in range(min(len(x) - i, len(y) - j)) if x[i + n] != y[j + n]), min(len(x) - i, len(y) - j))
                if n >= prefixhash.SEED:
                    yield i, j, n

    want = {k: sorted(((m, i, j, n) for m, y in items.items() for i, j, n in maximal(x or "", y)), key=lambda s: (-s[3], *s[:3])) for k, x in table.items()}
    assert {m for m, *_ in want[1]} == {1, 2, 4} and len(want[1]) == 5 and {m for m, *_ in want[3]} == {3, 5} and len(want[4]) == 2
    docs = spark.createDataFrame([*table.items(), (1, table[1])], "doc_id long, text string")
    passages = spark.createDataFrame([*items.items(), (2, b)], "item_id long, text string")
    for size in (prefixhash.PASSAGE_BYTES, 200):
        monkeypatch.setattr(prefixhash, "PASSAGE_BYTES", size)
        rows = prefixhash.fingerprints(docs, passages).collect()
        assert sorted(r.doc_id for r in rows) == [1, *table]
        assert all([tuple(s) for s in r.spans] == want[r.doc_id] for r in rows)
        assert all((r.item_id, r.doc_start, r.item_start, r.span_bytes) == (want[r.doc_id] or [(None,) * 4])[0] for r in rows)


def test_media_headers_and_shards(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 640, 480, 8, 2, 0, 0, 0) + b"x" * 5000
    wav = b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 0, b"WAVE", b"fmt ", 16, 1, 2, 44100, 176400, 4, 16, b"data", 352800) + b"\0" * 352800
    buffer = io.BytesIO()
    np.save(buffer, np.zeros((3, 5)))
    html = b"<html lang=de><head><meta charset=utf-8><title>Hallo</title></head>" + b"<p>text</p>" * 999
    rows = [(1, png), (2, wav), (3, buffer.getvalue()), (4, html), (5, png), (6, b"GIF89a" + struct.pack("<HH", 7, 9)), (7, b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x20\x00\x10\x03")]
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id long, body binary").repartition(3)
    folder = scratch.fresh(spark, "media-test")
    got = {r.id: r for r in media.media_columns(table, "body", "id", folder).collect()}
    assert {k: media.read(folder, r.shard, r.offset, r.length, r.encoding) for k, r in got.items()} == dict(rows)
    assert (got[1].shard, got[1].offset) == (got[5].shard, got[5].offset)
    assert (got[1].width, got[1].height, got[1].channels) == (640, 480, 3) and (got[2].sample_rate, got[2].seconds) == (44100, 2.0)
    assert (got[3].mime, got[3].height, got[3].width) == ("application/x-npy", 3, 5) and (got[4].language, got[4].title) == ("de", "Hallo")
    assert (got[6].width, got[6].height) == (7, 9) and (got[7].width, got[7].height) == (16, 32)
    with tarfile.open(f"{folder.removeprefix('file://')}/{got[2].shard}") as tar:
        assert f"{got[2].digest}" in tar.getnames()
