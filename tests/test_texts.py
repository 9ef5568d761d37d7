"""Tokens and search from texts in one step, against the operators on rows, and the plans of queries that use them."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexigrid.functions import names
from lexigrid.operators import columns, match, texts
from lexigrid.operators import tokens as tk
from lexigrid.operators.finder import Finder
from lexigrid.schemas import QUERY
from lexigrid.sources import words as src

WORDS = (
    "Соколова Т.В. Т. В соколовой ИВАНОВУ Салтыков- Щедрин Собо- лев 12 12) 3. (слово), АрхиповаЮГ ТВСоколова МП МВД Ю-Г Ю:Г: г.Москва the The and in of On- tion- a I I. A. T. O. "
    "straße Straße- Ё — –слово сло–во a-b- a-b c b-c x_ ٣) 3)3. X.Y.Z Ali. .. а.б. é 𝒳y ŉ ΑΣ Thing things Eser Eser- Onst-er And THE Erst Ing Of Отчество Иваныч Петровна Т.В.С.А.К. \x1cq ­x ОТ по. ИП К. Н."
).split(" ")
GAPS = [" "] * 6 + ["  ", "\n", "\n\n", "\t", "\r\n", "　", "\x85", "\n" * 30]


def rows():
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice(WORDS) + draw.choice(GAPS) for _ in range(n))
    some = [(i % 60, text(draw.choice([1, 5, 40, 200]))) for i in range(90)]
    return [*some, (1, some[1][1]), (None, "Thing"), (7, None), (80, ""), (81, " \n "), (70, " ".join(WORDS * 5)), (71, "a- " * 50), (72, "b-\n" * 200), (73, "Thing\r\n\x00And T.O.")]


@pytest.fixture(scope="module")
def asked(spark):
    terms = ["Соколова Т В", "Thing", "The In Of", "And T. O.", "Erst a i", "Eser", "Onst-er", "Ing A", "Салтыков-Щедрин", "Иванов", "Иванова А", "Straße", "Отчество И О", "Соколова Татьяна Вас"]
    parts = [(100, "КН", None, "К", None, "Н", None), (101, "A", None, "A", None, None, None), (102, "I", None, None, None, "I", None), (103, "p", "The", None, None, "O", "Of"), (104, "x", " Thing ", None, None, None, None), (100, "again", None, "К", None, "Н", None)]
    return names.literal_terms(spark, terms).unionByName(spark.createDataFrame(parts, QUERY))


def listed(df, *columns_):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns_).collect())))


def test_same_as_operators_on_rows(spark, asked):
    table = spark.createDataFrame(rows(), "doc_id long, text string")
    asked = asked.dropDuplicates(["term_ord"])
    words = src.words(table).persist()
    tokens = tk.tokens(words).persist()
    pairs = [
        (texts.expand(table), tk.expand(words)), (texts.tokens(table), tokens), (texts.surname_matches(table, asked), match.surname_matches(tokens, asked)),
        (texts.candidates(table, asked), match.candidates(tokens, asked).select("doc_id", "term_ord", F.col("s.idx").alias("surname_idx"), F.col("t.idx").alias("idx"), "is_name", "is_patronymic")),
        (texts.scores(table, asked), match.best_names(tokens, asked).withColumn("surname_idx", F.col("s.idx"))), (texts.search(table, asked), match.search(tokens, asked)),
    ]
    for got, want in pairs:
        assert (one := listed(got, *got.columns)) == listed(want, *got.columns) and one
    words.unpersist(), tokens.unpersist()
    assert texts.search(table.limit(0), asked).count() == 0 == texts.search(table, asked.limit(0)).count() == texts.tokens(table.where("doc_id > 79")).count()


def test_documents_longer_than_a_slice(spark, asked, monkeypatch):
    """Slices end amid documents, lines, pages and broken words; nothing is lost or told twice."""
    of = sorted((r for r in rows() if None not in r), key=lambda r: (r[0], r[1].encode()))
    finder = Finder([r.asDict() for r in asked.collect()])

    def batches():
        for k in range(0, len(of), 7):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in of[k : k + 7]], kind) for i, kind in enumerate((pa.int64(), pa.string()))], ["doc_id", "text"])

    def told(size):
        monkeypatch.setattr(columns, "SLICE", size)
        out = [("f", *x) for c in columns.fragments(batches()) for x in zip(*[c[k].tolist() for k in ("doc_id", "idx", "block", "col", "end")], c["raw"].to_pylist())]
        out += [("t", *x) for c, _ in columns.tokens(batches(), False) for x in zip(*[c[k].tolist() for k in ("doc_id", "idx", "block", "col", "end", "down", "kind")], c["text"].to_pylist())]
        for c, whole in columns.tokens(batches(), True):
            s = finder.slice(c, whole)
            for name in ("surname_rows", "candidate_rows", "score_rows", "hit_rows"):
                out += [(name, *x) for a in getattr(finder, name)(s) for x in zip(*[y.to_pylist() for y in a])]
        return sorted(out, key=repr)

    whole = told(1 << 20)
    assert len({x[0] for x in whole}) == 6
    for size in (1, 40, 700):
        assert told(size) == whole


FINDINGS = {
    "F1": "o10_highlighted",
    "F2": "o11_report",
    "F5": "o62_search",
    "F6": "o63_coverage",
    "F7": "o64_summary",
    "F8": "o65_files",
    "F9": "o09_annotations",
    "F3": "o57_scores_russian",
    "F10": "o57_o58_scores",
    "F4": "o60_o61_full_names",
    "F11": "o46_hyphens",
    "F12": "o50_by_surname",
    "F13": "o46_tokens",
    "F14": "o54_initials",
    "F15": "o49_surnames",
    "F16": "o36_o40_geometry",
    "F17": "o51_o52_candidates",
    "F18": "o26_expand",
    "F19": "o50_by_surname_russian",
}


@pytest.mark.parametrize("finding", FINDINGS)
def test_only_texts_are_shuffled(spark, finding, tmp_path):
    """No table of words or tokens is kept, sorted by windows or joined."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, "Thing a b"), (2, "the in of")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    df = __spark_entry__.queries()[FINDINGS[finding]](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The pages of annotations are laid out after lines of earlier texts of a document.
    assert "MapInArrow" in plan and "InMemoryRelation" not in plan and plan.count("Window [") == (FINDINGS[finding] == "o09_annotations")
    assert not any("idx" in line or "word_pos" in line for line in plan.splitlines() if "Exchange" in line)


def test_lists_of_terms_are_numbered_in_ranges(spark):
    """no task has all terms."""
    table = spark.createDataFrame([*[(i * 7919 % 3001, f" a{i},, b{i} ,c") for i in range(3001)], (None, "first"), (5000, None), (5001, ",")], "at long, text string")
    got = names.terms(table, "text", "at", comma=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    parts = names._turns(table.where("text is not null").select("at", F.lit(0).alias("k")), table.select("at")).groupBy("part").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 220
    lists = sorted(table.where("text is not null").collect(), key=lambda r: (r.at is not None, r.at))
    assert sorted((r.term_ord, r.term) for r in got.collect()) == list(enumerate(x.strip() for r in lists for x in r.text.split(",") if x.strip()))
    alike = spark.createDataFrame([("b", "x,y"), ("a", "z"), ("ё", "w")], "at string, text string")
    assert sorted((r.term_ord, r.term) for r in names.terms(alike, "text", "at", comma=True).collect()) == [(0, "z"), (1, "x"), (2, "y"), (3, "w")]
    nothing = alike.select(F.lit(None).cast("string").alias("at"), "text")
    assert names.terms(nothing, "text", "at", comma=True).count() == 4 and names.terms(alike.limit(0), "text", "at", comma=True).count() == 0
