from pyspark.sql import functions as F

from lexigrid.functions import names
from lexigrid.operators import match, report
from lexigrid.operators.tokens import tokens
from lexigrid.schemas import BLOCK, WORD
from lexigrid.sources import sinks, words
from lexigrid.streaming.stream import search_stream


def word(spark, rows):
    return spark.createDataFrame([(1, i, 1, text, float(x0), float(y0), float(x1), float(y1)) for i, (text, x0, x1, y0, y1) in enumerate(rows)], WORD)


def toks(spark, rows):
    return tokens(word(spark, rows)).orderBy("idx").collect()


def hits(spark, rows, term):
    table = match.search(tokens(word(spark, rows)), names.literal_terms(spark, [term]))
    return [r.found_text for r in table.orderBy("surname_idx", "role_ord").collect()]


def test_block_split(spark):
    block = spark.createDataFrame([(1, 0, 1, "Иванов  Иван", 0.0, 10.0, 120.0, 20.0), (1, 1, 1, "слово", 5.0, 30.0, 99.0, 40.0)], "doc_id long, block int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.text, r.x0, r.x1) for r in words.split_blocks(block).orderBy("word_pos").collect()]
    assert got == [("Иванов", 0, 60), ("Иван", 80, 120), ("слово", 5, 99)]


def test_recognised_blocks(spark):
    box = [{"x": x, "y": y} for x, y in ((140.0, 60.0), (240.0, 60.0), (240.0, 90.0), (140.0, 90.0))]
    rows = spark.createDataFrame([(1, 1, 0, box, " a ", 0.9), (1, 1, 1, box, "b", 0.2), (1, 1, 2, box, "  ", 0.9)], BLOCK)
    (r,) = words.from_recognised(rows, 0.5, 2.0).collect()
    assert (r.text, r.x0, r.y0, r.x1, r.y1) == ("a", 50, 40, 100, 100)


def test_tokens(spark):
    got = toks(spark, [("Т.В.", 165, 190, 0, 10), ("АрхиповаЮГ", 50, 150, 0, 10), ("МП", 0, 9, 0, 9), ("12)", 0, 9, 0, 9), ("123", 0, 9, 0, 9), ("Фамилия:", 0, 9, 0, 9)])
    assert [(r.text, r.type, r.raw) for r in got] == [
        ("Т.", "initial", "Т."), ("В.", "initial", "В."), ("АРХИПОВА", "word", "Архипова"), ("Ю", "initial", "Ю"), ("Г", "initial", "Г"),
        ("МП", "word", "МП"), ("123", "junk", "123"), ("ФАМИЛИЯ", "word", "Фамилия:"),
    ]
    assert [(r.x0, r.x1) for r in got[:5]] == [(165, 177.5), (183.75, 196.25), (50, 130), (140, 150), (160, 170)]
    assert [r.idx for r in got] == [0, 1, 2, 3, 4, 5, 7, 8]


def test_hyphens(spark):
    line = lambda *w: [(x, 100 * i, 100 * i + 50, 0, 12) for i, x in enumerate(w)]
    assert [(r.text, r.raw) for r in toks(spark, line("Салтыков-", "Щедрин"))] == [("САЛТЫКОВ-ЩЕДРИН", "Салтыков-Щедрин")]
    assert [(r.text, r.type) for r in toks(spark, line("Иванов-"))] == [("ИВАНОВ-", "junk")]
    broken = [("Собо-", 400, 450, 100, 112), ("12", 100, 120, 118, 130), ("лев", 410, 440, 118, 130)]
    (one,) = toks(spark, broken)
    assert (one.text, one.raw, len(one.parts)) == ("СОБОЛЕВ", "Собо-лев", 2)
    far = toks(spark, [*broken[:2], ("лев", 600, 640, 118, 130)])
    assert [(r.text, r.type) for r in far] == [("СОБО-", "junk"), ("12", "junk"), ("ЛЕВ", "word")]
    # A swallowed hyphen may not merge: "b-" is a continuation's neighbour only where it isn't consumed.
    chain = toks(spark, [("аа-", 0, 10, 0, 10), ("7-", 0, 10, 12, 22), ("бб", 0, 10, 12, 22), ("вв-", 0, 10, 24, 34), ("гг", 0, 10, 24, 34)])
    assert [r.text for r in chain] == ["ААББ", "ВВ-ГГ"]


def test_full_names(spark):
    page = [("Соколова", 100, 160, 100, 112), ("Т.В.", 165, 190, 100, 112)]
    assert hits(spark, page, "Соколова Т В") == ["Соколова", "Т.", "В."]
    best = match.best_names(tokens(word(spark, page)), names.literal_terms(spark, ["Соколова Т В"])).collect()
    assert [round(r.score, 6) for r in best] == [-1140]
    glued = [("АрхиповаЮГ", 50, 150, 200, 214)]
    assert hits(spark, glued, "Архипова Ю.Г.") == ["Архипова", "Ю", "Г"]
    best = match.best_names(tokens(word(spark, glued)), names.literal_terms(spark, ["Архипова Ю.Г."])).collect()
    assert [round(r.score, 6) for r in best] == [-485]
    assert hits(spark, page[:1], "Соколова Т В") == []


def test_surnames(spark):
    double = [("Салтыков-", 0, 60, 0, 12), ("Щедрин", 70, 120, 0, 12)]
    assert hits(spark, double, "Салтыков") == []
    assert hits(spark, double, "Салтыков-Щедрин") == ["Салтыков-Щедрин"]
    assert hits(spark, [("К.Н.", 0, 20, 0, 10)], "К.Н.") == []
    table = tokens(word(spark, [("ИВАНОВУ", 0, 9, 0, 9), ("ИВАНОВОЙ", 20, 29, 0, 9), ("ИВАНОВ", 40, 49, 0, 9)]))
    asked = names.literal_terms(spark, ["Иванов А", "Иванова А"])
    got = {(r.text, r.term_ord) for r in match.surname_matches(table, asked).collect()}
    assert ("ИВАНОВУ", 0) in got and ("ИВАНОВОЙ", 0) not in got and ("ИВАНОВ", 1) in got


def test_initials(spark):
    asked = spark.createDataFrame([(0, "К.Н.", None, "К", None, "Н", None)], "term_ord int, term string, surname string, name_initial string, name_full string, patronymic_initial string, patronymic_full string")
    table = tokens(word(spark, [("К.", 0, 10, 0, 10), ("77", 20, 30, 0, 10), ("Н.", 40, 50, 0, 10), ("К.", 60, 70, 0, 10), ("слово", 80, 90, 0, 10), ("Н.", 95, 99, 0, 10)]))
    rows = match.by_initials(table, asked).orderBy("surname_idx", "role_ord").collect()
    assert [(r.found_text, r.x0) for r in rows] == [("К.", 0), ("Н.", 40)]


def test_coverage_and_reports(spark):
    page = word(spark, [("Соколова", 100, 160, 100, 112), ("Т.В.", 165, 190, 100, 112)])
    asked = names.literal_terms(spark, ["Соколова Т В", "Ли"])
    found = match.search(tokens(page), asked)
    covered = report.coverage(page, asked, found)
    errors = spark.createDataFrame([(2, "missing")], "doc_id long, error string")
    (s,) = report.global_summary(report.run_results(covered, errors)).collect()
    assert (s.tests, s.errors, s.total_found, s.found_tokens, s.possible_tokens, s.percent) == (2, 1, 3, 3, 4, 75.0)
    assert [r.line for r in report.report_lines(covered).orderBy("line_ord").collect()] == ["Document 1: 3 of 4", "  Соколова Т В: 3", "  Ли: 0"]
    assert sinks.texts(page).first().text == "Соколова Т.В."
    assert sinks.annotations(found, page.where("page > 1")).count() == 0 and sinks.annotations(found, page).count() == 3
    assert sinks.highlighted(page, found).first().highlighted is True


def test_readability(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 60), (1, 2, " " * 90), (2, 1, "x" * 50), (3, 1, None)], "doc_id long, page int, text string")
    assert {r.doc_id: r.readable for r in words.readability(pages).collect()} == {1: False, 2: True, 3: False}


def test_pdf_plugin(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("имя Иванов".encode())
    (tmp_path / "b.pdf").write_bytes(b"\xff")

    def extract(content):
        for i, w in enumerate(content.decode().split()):
            yield 1, w, 10.0 * i, 0.0, 10.0 * i + 9, 9.0

    rows = words.scan_pdf(spark, str(tmp_path), extract).collect()
    assert sorted(r.text for r in rows if r.error is None) == ["Иванов", "имя"] and sum(r.error is not None for r in rows) == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Соколова Т.В. подпись"), (2, "никого")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    run = search_stream(source, names.literal_terms(spark, ["Соколова Т В"]), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("doc_id") == 1).count() == 3
