"""Parsing of name queries: as a Column for tables of terms, and in Python for literal lists. Both agree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.schemas import QUERY

from .text import L, PATRONYMIC, SURNAME, fold_dashes, is_upper, let, split_words, strip

#: Two-letter upper-case words that are names and no pairs of initials in a query.
SHORT_NAMES = "АН ДО ЗА ИЗ КЮ ЛИ НА НЕ НИ ОТ ПО УК ЯН".split()
#: So many values at most are looked at to choose the ranges in which terms are numbered.
EDGES = 10_000
PARTS = ("surname", "name_initial", "name_full", "patronymic_initial", "patronymic_full")


def parse(term: Column) -> Column:
    """A struct of PARTS. Without a word all are null; an initial after a full name is not looked at."""
    kinds = F.transform(split_words(F.translate(fold_dashes(term), ",:;", " . ")), _classify)
    words = lambda k: F.array_remove(F.transform(k, lambda x: x["word"]), "")
    initials = lambda k: F.flatten(F.transform(k, lambda x: x["initials"]))
    return let(kinds, lambda k: let(initials(k), lambda i: _assign(words(k), i)))


def _classify(t: Column) -> Column:
    return let(F.regexp_replace(t, rf"[^{L}\-]", ""), lambda letters: _kind(t, letters))


def _kind(t: Column, letters: Column) -> Column:
    pair = t.rlike(rf"\A[{L}]\.[{L}]\.?\z")
    bare = (F.length(letters) == 2) & is_upper(t) & ~F.upper(letters).isin(*SHORT_NAMES)
    none = F.array().cast("array<string>")
    some = pair | (F.length(letters) == 1) | bare
    return let(some, lambda yes: F.struct(F.when(yes, F.lit("")).otherwise(letters).alias("word"), F.when(yes, F.array_remove(F.split(F.upper(letters), ""), "")).otherwise(none).alias("initials")))


def _assign(words: Column, initials: Column) -> Column:
    def scored(ws: Column) -> Column:
        third = (F.size(ws) == 3) & F.upper(F.coalesce(F.get(ws, F.lit(1)), F.lit(""))).rlike(PATRONYMIC)
        points = lambda w, i: F.when(F.upper(w).rlike(SURNAME), 10).otherwise(0) + F.when((i == 2) & third, 20).otherwise(0)
        best = -F.array_max(F.transform(ws, lambda w, i: F.struct(points(w, i).alias("score"), (-i).alias("order"))))["order"]
        return let(best, lambda b: chosen(ws, b))

    def chosen(ws: Column, best: Column) -> Column:
        return let(F.filter(ws, lambda w, i: i != best), lambda rest: parts(F.get(ws, best), rest))

    def parts(surname: Column, rest: Column) -> Column:
        name, patronymic = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
        first = lambda full, k: F.coalesce(F.upper(F.substring(full, 1, 1)), F.get(initials, F.lit(k)))
        values = (surname, first(name, 0), name, first(patronymic, 1), patronymic)
        return F.struct(*[F.when(surname.isNotNull(), v).alias(n) for n, v in zip(PARTS, values)])

    return let(words, scored)


def parse_literal(term: str) -> dict[str, str | None]:
    """The same in Python."""
    words, initials = [], []
    for t in re.sub("[–—−]", "-", term).translate(str.maketrans(",:;", " . ")).split():
        letters = re.sub(rf"[^{L}\-]", "", t)
        if re.fullmatch(rf"[{L}]\.[{L}]\.?", t) or len(letters) == 1 or (len(letters) == 2 and t.isupper() and letters.upper() not in SHORT_NAMES):
            initials.extend(letters.upper())
        elif letters:
            words.append(letters)
    if not words:
        return dict.fromkeys(PARTS)
    third = len(words) == 3 and re.search(PATRONYMIC, words[1].upper())
    score = [10 * bool(re.search(SURNAME, w.upper())) + 20 * bool(i == 2 and third) for i, w in enumerate(words)]
    best = score.index(max(score))
    name, patronymic = ([w for i, w in enumerate(words) if i != best] + [None, None])[:2]
    given = (initials + [None, None])[:2]
    return dict(zip(PARTS, (words[best], name[0].upper() if name else given[0], name, patronymic[0].upper() if patronymic else given[1], patronymic)))


def terms(table: DataFrame, term: str = "term", order: str = "term_ord", comma: bool = False) -> DataFrame:
    """(term_ord, term, PARTS...) of a table of terms; null and blank terms go, repeated ones stay.

    With `comma` a row is a comma-separated list of terms, and `term_ord` numbers all of them by `order` and place in the list.
    Other columns aren't looked at.
    """
    rows = table.where(F.col(term).isNotNull()).select(F.col(order).alias("at"), F.posexplode(F.split(term, ",") if comma else F.array(term)).alias("k", "part"))
    rows = rows.select("at", "k", strip(F.col("part")).alias("term")).where("term <> ''")
    rows = _turns(rows, table.select(F.col(order).alias("at"))) if comma else rows.withColumn("turn", F.col("at"))
    rows = rows.select(F.col("turn").cast("int").alias("term_ord"), "term")
    # A generator keeps filters on the parts above the parsing, which is then done once.
    return rows.select("term_ord", "term", F.explode(F.array(parse(F.col("term")))).alias("q")).select("term_ord", "term", "q.*")


def _further(part: Column, edges: Column, step: int) -> Column:
    """A step of a binary search: `part`, or the part `step` further if that begins before `at`; an edge of null is after all."""
    return let(part, lambda p: F.when(F.get(edges, p + (step - 1)) <= F.col("at"), p + step).otherwise(p))


def _turns(rows: DataFrame, order: DataFrame) -> DataFrame:
    """`rows` with `turn`, their number in the order of (at, k), counted by ranges of `at` and not in one task. The ranges' edges are
    some of its values, and decide only which task numbers what; null comes first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = max(1, (4 * parts - 1).bit_length())
    some = [r.at for r in order.where("at is not null").distinct().orderBy(F.xxhash64("at")).limit(EDGES).orderBy("at").collect()]
    if not some:
        return rows.withColumn("turn", F.row_number().over(Window.orderBy("k")) - 1)
    count = (1 << depth) - 1
    edges = F.array(*[F.lit(some[len(some) * k // (count + 1)]) for k in range(1, count + 1)])
    part = F.lit(0)
    for k in reversed(range(depth)):
        part = _further(part, edges, 1 << k)
    rows = rows.withColumn("part", part)
    sizes, before, offsets = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}, 0, []
    for k in range(count + 1):
        offsets.append(before)
        before += sizes.get(k, 0)
    # A given number isn't coalesced by bytes: parsing, which follows, takes long for few bytes.
    turn = F.row_number().over(Window.partitionBy("part").orderBy("at", "k")) - 1 + F.get(F.lit(offsets), F.col("part"))
    return rows.repartition(parts, "part").withColumn("turn", turn)


def split_terms(text: str | list[str]) -> list[str]:
    """Terms of a comma-separated string, or of a list; blank ones go."""
    return [t.strip() for t in (text.split(",") if isinstance(text, str) else text) if t.strip()]


def literal_terms(spark: SparkSession, text: str | list[str]) -> DataFrame:
    """The queries (schemas.QUERY) of a literal list, parsed here."""
    rows = [(i, t, *(parse_literal(t)[p] for p in PARTS)) for i, t in enumerate(split_terms(text))]
    return spark.createDataFrame(rows, QUERY)


def mode(q: str = "") -> Column:
    """Which search a query is dispatched to: fio, surname, initials, or null."""
    initials = F.col(f"{q}name_initial").isNotNull() | F.col(f"{q}patronymic_initial").isNotNull()
    surname = F.col(f"{q}surname").isNotNull()
    return F.when(surname & initials, "fio").when(surname, "surname").when(initials, "initials")
