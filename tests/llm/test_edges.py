"""Each operator over the cases that break things: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from lexigrid.llm import curriculum, curvepack, licenses, linechunks, media, neardup, prefixhash, quality, tokenbin, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, node long, position double, hash string, place string"
LONG = " ".join(f"word{i % 7919} and{i % 13}" for i in range(150_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs away from seven angry hounds in the dark wood"


def rows():
    pad = ("x", 0.5, 7, 0.1, "h", "p")
    return [
        (1, WORDS, "en", "a", len(WORDS), *pad),
        (1, WORDS, "en", "a", len(WORDS), *pad),
        (2, WORDS, None, None, None, *pad),
        (None, WORDS + " again", "en", "b", 5, *pad),
        (None, None, None, None, None, None, None, None, None, None, None),
        (3, None, "en", "a", 0, *pad),
        (4, "", "en", "a", 0, *pad),
        (5, "   \n ", "en", "b", 4, *pad),
        (6, "!!! ???", "en", "b", 7, *pad),
        (7, LONG, "en", "b", len(LONG), *pad),
        (8, "é", "fr", "c", 1, *pad),
        (9, "one\ntwo\n\nthree\n", "en", "c", 15, *pad),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 0, 1), (None, 1, 1), (7, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(docs, none, labels):
    model = quality.fit(docs, labels)
    out = quality.scored(docs, model).select("row.doc_id", "row.text", "score", "keep").collect()
    assert len(out) == len(rows()) and all(r.score is not None for r in out)
    assert all(r.score == 0 and not r.keep for r in out if not (r.text or "").strip())
    assert quality.quality_filter(docs, labels).columns == docs.columns
    assert quality.quality_filter(none, labels).count() == 0
    assert quality.quality_filter(docs, labels.limit(0)).count() == sum(bool((r[1] or "").strip()) for r in rows())


def test_toxicity(docs, none, labels):
    out = toxicity.scored(docs, toxicity.fit(docs, labels)).select("row.*", "toxicity", "toxic").collect()
    assert len(out) == len(rows())
    assert {r.toxicity for r in out if r.doc_id in (3, 4, 5, 6)} == {0.0}
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.toxicity for r in toxicity.scored(docs.where("doc_id = 1"), empty).collect()} == {0.5}


def test_line_chunks(docs, none):
    out = linechunks.line_dedup(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))  # one line of 20 words isn't compared
    assert linechunks.line_dedup(none).count() == 0


def test_near_duplicates(docs, none):
    marks = neardup.marked(docs).collect()
    assert len(marks) == len(rows())
    kept = [r.doc_id for r in neardup.near_dedup(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 4, 5, 6, 7, 8, 9] and kept.count(None) == 1
    assert neardup.near_dedup(docs).columns == docs.columns
    assert neardup.near_dedup(none).count() == 0


def test_curriculum(docs, none):
    out = curriculum.mix_sources(docs, budget=3.0)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {1, 2, None, 6, 7, 8, 9}
    assert curriculum.mix_sources(none).count() == 0
    where = curriculum.positioned(docs, budget=2.0).select("position").collect()
    assert all(0 <= r.position <= 1 for r in where)


def test_packing(docs, none):
    out = curvepack.pack(docs, 64).collect()
    assert {r.doc_id for r in out} == {1, 2, None, 6, 7, 8, 9}
    assert "".join(r.text for r in sorted((r for r in out if r.doc_id == 7), key=lambda r: r.doc_start)) == LONG
    assert sum(r.n_tokens for r in out if r.doc_id == 1) == 2 * len(WORDS.split())
    assert curvepack.pack(none).count() == 0


def test_token_ids(docs, none):
    out = tokenbin.packed_ids(docs, length=128).collect()
    assert tokenbin.unpacked(out)[7] == LONG and tokenbin.unpacked(out)[5] == "   \n "
    assert sorted(d for r in out for d, s in zip(r.doc_ids, r.doc_starts) if d == 1 and s == 0) == [1, 1]
    assert tokenbin.packed_ids(none).count() == 0


def test_licenses(docs, none, spark):
    assert licenses.license_matches(docs).count() == 0
    assert licenses.license_matches(none).count() == 0
    many = spark.createDataFrame([(1, "All rights reserved. " * 3), (1, "All rights reserved. " * 3), (None, "ALL RIGHTS RESERVED"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in licenses.license_matches(many).collect()) == ["1"] * 6 + ["None"]


def test_fingerprints(docs, none, spark):
    items = spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (None, WORDS), (4, WORDS)], "item_id long, text string")
    out = prefixhash.fingerprints(docs, items).collect()
    assert len(out) == len(rows())
    assert {(r.item_id, r.doc_start, r.item_start, r.span_bytes) for r in out if r.doc_id in (1, 2)} == {(1, 0, 0, len(WORDS))}
    assert {r.copy_of for r in out if r.doc_id in (1, 2)} == {1} and {r.fingerprint for r in out if r.doc_id in (3, 4)} == {None}
    assert prefixhash.fingerprints(none, items).count() == 0
    assert prefixhash.fingerprints(docs, items.limit(0)).where("item_id is not null").count() == 0


def test_media(docs, none):
    out = media.media_columns(docs.withColumn("offset", F.lit("mine")), "text", "doc_id").collect()
    assert len(out) == len(rows())
    assert all((r.digest is None) == (r.raw_length is None) and r.offset == "mine" for r in out)
    assert len({(r.shard, r.offset_) for r in out if r.doc_id in (1, 2)}) == 1
    assert [r.raw_length for r in out if r.doc_id == 4] == [0]
    assert media.media_columns(none, "text", "doc_id").count() == 0


def test_pipeline_stages(docs, none, labels, spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    for table in (docs, none):
        now = table
        for name, step in corpus_pipeline.STAGES:
            now = spark.createDataFrame(step(spark, now, folder).collect(), step(spark, now, folder).schema) if table is none else step(spark, now, folder)
            if name != "packing":
                assert now.columns == table.columns
            now = now.cache()
        assert (now.count() == 0) == (table is none)
