import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.functions import names
from lexigrid.functions import text as t

PARSED = [
    ("Ангабаева Ольга Сергеевна", "Ангабаева", "О", "Ольга", "С", "Сергеевна"),
    ("Андриевская М Б", "Андриевская", "М", None, "Б", None),
    ("Н. А. Антонова", "Антонова", "Н", None, "А", None),
    ("3. Р. Валиуллин", "Валиуллин", "Р", None, None, None),
    ("Татьяна Эдуардовна Шпилевская", "Шпилевская", "Т", "Татьяна", "Э", "Эдуардовна"),
    ("Климов Л.Я.", "Климов", "Л", None, "Я", None),
    ("Бейкер Джеймс А", "Бейкер", "Д", "Джеймс", None, None),
    ("Пол Ашфорд", "Пол", "А", "Ашфорд", None, None),
    ("Сабина Керимова", "Сабина", "К", "Керимова", None, None),
    ("ДЕНЬЕР ВАН ДЕР", "ДЕНЬЕР", "В", "ВАН", "Д", "ДЕР"),
    ("Анай-оол Чодураа Сергеевна", "Анай-оол", "Ч", "Чодураа", "С", "Сергеевна"),
    ("Ли", "Ли", None, None, None, None),
    ("К.Н.", None, None, None, None, None),
    ("ЮГ", None, None, None, None, None),
]
ODD = ["А.Б.В. Петров", "петров; иван", "Смирнов:А", "  ", "—", "ЛИ", "ли ли ли", "Á É", "Straße X", "А-Б", "--", "1 2 3", "Ю-Г Ким"]


@pytest.mark.parametrize("row", PARSED)
def test_literal_parser(row):
    assert tuple(names.parse_literal(row[0])[p] for p in names.PARTS) == row[1:]


def test_parsers_agree(spark):
    terms = [r[0] for r in PARSED] + ODD
    rows = spark.createDataFrame([(x,) for x in terms], "term string").select("term", names.parse(F.col("term")).alias("q")).collect()
    for r in rows:
        assert r.q.asDict() == names.parse_literal(r.term), r.term


def test_terms_are_split_and_ordered(spark):
    rows = names.literal_terms(spark, "Иванов А, , Ли,К.Н.").orderBy("term_ord").collect()
    assert [(r.term_ord, r.term) for r in rows] == [(0, "Иванов А"), (1, "Ли"), (2, "К.Н.")]


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_forms(spark):
    got = apply(spark, t.surname_forms, ["Иванов", "СОКОЛОВА", "ДОСТОЕВСКИЙ", "ШПИЛЕВСКАЯ", "Ли", ""])
    assert set(got[0]) == {"ИВАНОВ" + e for e in ["", "А", "У", "ОМ", "Е", "ЫМ", "ОГО", "ОМУ", "ЫХ"]} and len(got[0]) == 9
    assert set(got[1]) == {"СОКОЛОВА", "СОКОЛОВОЙ", "СОКОЛОВУ", "СОКОЛОВЕ", "СОКОЛОВОЮ"}
    assert len(got[2]) == 7 and set(got[3]) == {"ШПИЛЕВСКАЯ", "ШПИЛЕВСКОЙ", "ШПИЛЕВСКУЮ"}
    assert got[4] == ["ЛИ"] and got[5] == []
    words = apply(spark, t.word_forms, ["ОРЛОВ", "КОТОВА", "ЛИ"])
    assert len(words[0]) == 5 and len(words[1]) == 6 and words[2] == ["ЛИ"]
    assert apply(spark, t.normalize_surname, ["ИВАНОВА", "ШПИЛЕВСКОЙ", "ШПИЛЕВСКАЯ", "ЕВА", "Ильиным"]) == ["ИВАНОВ", "ШПИЛЕВСКИЙ", "ШПИЛЕВСКАЯ", "ЕВА", "ИЛЬИН"]


def test_fragments(spark):
    f = lambda c: t.fragments(t.unglue(t.colon_to_dot(c)))
    got = apply(spark, f, ["Т.В.", "АрхиповаЮГ", "ТВСоколова", "МП", "МВД", "12АБ", "Ю-Г", "Ю:Г:", "г.Москва"])
    assert got == [["Т.", "В."], ["Архипова", "Ю", "Г"], ["Т", "В", "Соколова"], ["МП"], ["М", "В", "Д"], ["А", "Б"], ["Ю", "Г"], ["Ю.", "Г."], ["г.", "Москва"]]
    clean = lambda c: t.trim_punctuation(t.strip_numbering(c))
    assert apply(spark, clean, ["Фамилия:", "12)", "3.", "123", "(Иванов),", "Ю.", "слово."]) == ["Фамилия", "", "", "123", "Иванов", "Ю.", "слово"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="АБВОИНЕЯабвоин-–. ", max_size=12), min_size=20, max_size=60))
def test_properties(spark, values):
    folded = apply(spark, t.fold_dashes, values)
    assert apply(spark, t.fold_dashes, folded) == folded
    for v, forms, words in zip(values, apply(spark, t.surname_forms, values), apply(spark, t.word_forms, values)):
        if v.strip():
            assert v.strip().upper() in forms and v.strip().upper() in words
