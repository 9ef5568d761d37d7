"""Skew, collisions, headers, schedules, models and files against plain versions, on rows made for them."""

import io
import itertools
import struct
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import curriculum, licenses, linechunks, media, neardup, prefixhash, quality, scratch, text, tokenbin, toxicity
from lexigrid.llm.text import Words


def test_labelled_rows_are_bounded_by_hash_alone(spark):
    docs = spark.range(30_000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = quality.labelled(docs, labels, "quality", 20).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 20 and {r.label for r in rows} == {0.0, 1.0}
    assert all(r.label == r.doc_id % 2 for r in rows)


def test_lasso_is_optimal():
    rng = np.random.default_rng(1)
    z = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1])))).astype(float)
    bias, w = quality.lasso_logistic(z, y, 0.02, steps=4000)
    gradient = z.T @ (1 / (1 + np.exp(-(z @ w + bias))) - y) / len(y)
    on = np.abs(w) > 1e-6
    assert on[:2].all() and not on.all()
    assert np.allclose(gradient[on], -0.02 * np.sign(w[on]), atol=1e-3) and (np.abs(gradient[~on]) <= 0.02 + 1e-3).all()


def test_ftrl_is_the_plain_one():
    rng = np.random.default_rng(2)
    examples = [np.unique(rng.integers(0, 64, 9)) for _ in range(80)]
    y = np.array([3 in e for e in examples], float)
    bias, index, weight = toxicity.ftrl(examples, y, bits=6, epochs=3)
    z, n, zb, nb = [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def value(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for e, label in zip(examples, y):
            w, b = [value(i) for i in e], -zb * toxicity.ALPHA / (toxicity.BETA + nb**0.5)
            g = 1 / (1 + np.exp(-(sum(w) + b))) - label
            for i, wi in zip(e, w):
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * wi
                n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / toxicity.ALPHA * b
            nb += g * g
    want = {i: value(i) for i in range(64) if value(i)}
    assert want and dict(zip(index.tolist(), weight)) == pytest.approx(want) and bias == pytest.approx(-zb * toxicity.ALPHA / (toxicity.BETA + nb**0.5))


def test_positions_under_three_knots(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 3 > 0]) for i in range(60)], "doc_id long, text string, source string")
    knots = [("a", 0.0, 3.0), ("b", 0.0, 1.0), ("a", 0.3, 1.0), ("b", 0.3, 1.0), ("a", 1.0, 0.0), ("b", 1.0, 2.0)]
    rows = curriculum.positioned(docs, spark.createDataFrame(knots, "source string, knot double, weight double"), 1.5).select("row.doc_id", "source", "n_tokens", "epoch", "position").collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    grid = np.linspace(0, 1, 200_001)
    share = {s: np.interp(grid, [0, 0.3, 1], v) for s, v in (("a", [0.75, 0.5, 0]), ("b", [0.25, 0.5, 1]))}
    total = 1.5 * sum(1 + i % 7 for i in range(60))
    for s in "ab":
        area = np.concatenate([[0], np.cumsum((share[s][1:] + share[s][:-1]) / 2 * np.diff(grid))]) * total
        mine, upto = sorted((r for r in rows if r.source == s), key=lambda r: (r.epoch, r.position)), 0
        for r in mine:
            assert r.position == pytest.approx(np.interp(upto, area, grid), abs=1e-4)
            upto += r.n_tokens
        assert upto >= area[-1] - 1e-6


def test_repeated_runs_of_copies_stay_for_the_next_stage(spark):
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    body = [line(f"a{j}x", 12) for j in range(20)]
    passage = [line("p", 30), line("q", 30)]
    docs = {1: body, 2: [*body[:-1], line("z", 12)], 3: [line("c", 9), *passage, line("d", 9)], 4: [line("e", 9), *passage, line("f", 9)]}
    table = spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in linechunks.line_dedup(table, copies=False).collect()}
    assert got == {**docs, 4: [docs[4][0], docs[4][-1]]}
    assert {r.doc_id: r.text for r in linechunks.line_dedup(table).collect()}[2] == line("z", 12)


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(neardup, "node_of", lambda text: F.when(text.isNotNull(), F.lit(7).cast("long")))
    texts = ["one two three four five", "quite another text with other words", "one two three four five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.text for r in neardup.near_dedup(docs).collect())
    assert set(kept) == set(texts)


def test_large_buckets_and_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = [(b, n, n % 4) for b in (1, 2) for n in range(b, 17)] + [(3, 90, 1), (3, 91, 1)]
    got = neardup.crossed(spark.createDataFrame(rows, "band long, node long, label long")).collect()
    want = {(x, y) for (b, x, i), (c, y, j) in itertools.product(rows, rows) if b == c and x < y and i != j}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:i], "new", *base[i:]]) for i in range(12)]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = spark.createDataFrame([(0, b) for b in range(1, 12)], "a long, b long")
    assert neardup.verified(pairs, table).where("similarity > 0.7").count() == 11


def test_headers_beyond_the_first_kilobyte(spark):
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 4098) + b"e" * 4096 + b"\xff\xc0\x00\x11\x08\x00\x20\x00\x10\x03" + b"\0" * 9
    html = b"<html><head><script>" + bytes(np.random.default_rng(0).integers(97, 122, 9000, np.uint8)) + b"</script><meta charset=utf-8><title>Late</title></head><body>" + b"<p>x</p>" * 99
    buffer = io.BytesIO()
    np.save(buffer, np.zeros((3, 5)))
    old = buffer.getvalue().replace(b"(3, 5), }", b"(3L, 5L)}")
    broken = buffer.getvalue().replace(b"(3, 5)", b"(q, 5)")
    rows = [(1, jpeg), (2, html), (3, old), (4, broken), (5, b"\xff\xd8\xff"), (6, b"BM")]
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id long, body binary")
    got = {r.id: r for r in media.media_columns(table, "body", "id").collect()}
    assert (got[1].width, got[1].height, got[1].channels) == (16, 32, 3)
    assert (got[2].title, got[2].charset) == ("Late", "utf-8")
    assert (got[3].height, got[3].width) == (3, 5) and (got[4].mime, got[4].height) == ("application/x-npy", None)
    assert got[5].mime == "image/jpeg" and got[5].width is None


def test_license_spans_and_short_notices(spark):
    text = "İİİİ Released under the MIT License."
    (r,) = licenses.license_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert text.encode()[r.byte_start : r.byte_end].decode() == "Released under the MIT License"
    notice = "Licensed under the Apache License Version 2 0".split()
    worn = [" ".join([*notice[:i], "other", *notice[i + 1 :]]) for i in (0, len(notice) - 1)]
    rows = licenses.license_matches(spark.createDataFrame(list(enumerate(worn)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.license == "Apache-2.0-notice"} == {0, 1}


def test_license_coverage_without_a_band():
    rng = np.random.default_rng(4)
    for name in ("MIT-grant", "GPL-3.0-header", "ISC"):
        words = licenses.TEMPLATES[name].split()
        worn = [w for w in words if rng.random() > 0.03]
        index = licenses.Index({name: licenses.TEMPLATES[name]})
        text = "before it " + " ".join(worn) + " after it"
        (row,) = licenses.matches(pa.array([text]), index)
        a, b = Words(pa.array([text])).hash.tolist(), index.words[0].hash.tolist()
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert row[2] == best[-1, -1]


def test_written_matrices(spark):
    docs = spark.createDataFrame([(i if i % 4 else None, "some words " * (i % 90) + f"end {i}") for i in range(200)], "doc_id long, text string")
    folder = scratch.fresh(spark, "ids-test")
    rows = tokenbin.written_ids(docs, folder, length=128, shard_bytes=20_000).orderBy("shard", "sequence").collect()
    plain = tokenbin.packed_ids(docs, length=128, shard_bytes=20_000).orderBy("shard", "sequence").collect()
    assert len({r.shard for r in rows if None in r.doc_ids}) > 1  # rows without a doc_id are in several shards
    assert [tokenbin.read_ids(folder, r.file, r.offset, 128) for r in rows] == [bytes(r.ids) for r in plain]
    root = folder.removeprefix("file://")
    for name in {r.file for r in rows}:
        mine = [r for r in rows if r.file == name]
        lens, resets = (np.fromfile(f"{root}/{name.removesuffix('ids')}{kind}", "<i4").tolist() for kind in ("lens", "resets"))
        assert lens == [x for r in mine for x in r.cu_seqlens]
        assert resets == [k * 128 + x for k, r in enumerate(mine) for x in r.position_resets]


def test_short_passages_are_found(spark):
    items = spark.createDataFrame([(1, "what is it?"), (2, "x" * 40), (3, "né")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so what is it? what is it?"), (2, "y" + "x" * 41), (3, "what is"), (4, "né")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in prefixhash.fingerprints(docs, items).collect()}
    assert got == {1: [(1, 3, 0, 11), (1, 15, 0, 11)], 2: [(2, 1, 0, 40), (2, 2, 0, 40)], 3: [], 4: [(3, 0, 0, 3)]}


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch.folder(session)


def _peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_worker_holds_little_beside_its_batch():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    lines = [" ".join(words[rng.integers(0, 5000, 12)]) for _ in range(60)]
    many = pa.array(["\n".join(rng.permutation(lines)) for _ in range(3000)])  # 12 MB
    long = pa.array(["\n".join(many.to_pylist())])
    for texts, most in ((many, 60e6), (long, 16 * long.nbytes)):
        ids = pa.array(np.arange(len(texts)))
        lists = pa.array([[0, 1, 7]] * len(texts), pa.list_(pa.int32()))
        batch = pa.record_batch([ids, ids, texts, lists], names=["id", "doc", "text", "wanted"])
        for f in (linechunks._spot, linechunks._fetch):
            assert _peak(lambda: [x.num_rows for x in f(iter([batch]), linechunks.Runs)]) < most  # noqa: B023
        assert _peak(lambda: linechunks.removed(texts, lists, linechunks.Runs)) < most  # noqa: B023
    ids = pa.array(np.arange(len(many)))
    batch = pa.record_batch([ids, many, ids], names=["node", "text", "check"])
    assert _peak(lambda: [x.num_rows for x in neardup._sign(iter([batch]))]) < 60e6


def test_spans_have_one_hash_across_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 256, 1000).astype(np.uint8)
    begin = rng.integers(0, 1001, 400)
    end = rng.integers(begin, 1001)
    whole = text.span_hashes(raw, begin, end)
    for block in (1, 64, 1000):
        monkeypatch.setattr(text, "BLOCK", block)
        assert (text.span_hashes(raw, begin, end) == whole).all()
        alone = [text.span_hashes(raw[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(begin, end)]
        assert (np.array(alone) == whole).all()


def test_stretches_are_those_of_bytes_taken_one_by_one():
    rng = np.random.default_rng(5)
    texts = ["", None, "one line", "a b\n", *("\n".join(rng.choice(["x y", "", "z", "w " * 60, "ж"], n)) + "\n" * (n % 2) for n in range(1, 40))]
    array = pa.array(texts)
    count = np.bincount(linechunks.Runs(array).row, minlength=len(texts))
    lists = [sorted(rng.choice(c, rng.integers(0, c + 1), replace=False).tolist()) if c else None for c in count]
    got = linechunks.removed(array, pa.array(lists, pa.list_(pa.int32())), linechunks.Runs).to_pylist()
    for t, chosen, row in zip(texts, lists, got):
        runs, data = linechunks.Runs(pa.array([t])), (t or "").encode()
        off = {p for i in chosen or [] for p in range(runs.start[i], runs.end[i])}
        assert row["clean"].encode() == bytes(b for p, b in enumerate(data) if p not in off)
        assert row["gone"] == sum(p - 1 not in off for p in off)
