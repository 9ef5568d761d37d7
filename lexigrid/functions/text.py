"""Scalar text operators as Columns. L is a Latin or Russian letter, U a capital one; no folding of the letter yo."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

L = "A-Za-zА-Яа-яЁё"
U = "A-ZА-ЯЁ"
LOW = "a-zа-яё"
WORDCHAR = r"\p{L}\p{N}_"
#: Unicode white space.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Short upper-case words that are no initials in a text.
PLAIN_SHORT = "ДО ЗА ИЗ ИЛИ ИП МП МЫ НА НЕ НИ ОН ОНА ОНИ ОТ ПО ПРИ ФИО".split()
FORM_WORDS = "ДАТА ДИРЕКТОР ДОЛЖНОСТЬ ИМЯ М.П. МП ОТЧЕСТВО ПОДПИСЬ РУКОВОДИТЕЛЬ ФАМИЛИЯ".split()
#: Signs after words that trimming drops whatever else there is.
SIGNS = ".,;!?"
PATRONYMIC = "(?:ИЧ|ОВНА|ЕВНА|ИЧНА)$"
SURNAME = "(?:ОВА?|ЕВА?|ИНА?|[СЦ]КИЙ|[СЦ]КАЯ)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(WHITE))


def split_white(c: Column) -> Column:
    """Parts between single characters of white space; a split at a plain blank compiles no pattern for each row."""
    return F.split(F.translate(c, WHITE, " " * len(WHITE)), " ")


def split_words(c: Column) -> Column:
    """White-space separated parts, none of them empty."""
    return F.array_remove(split_white(c), "")


def fold_dashes(c: Column) -> Column:
    return F.translate(c, "–—−", "---")


def colon_to_dot(c: Column) -> Column:
    return F.regexp_replace(c, f"([{L}]):", "$1.")


def unglue(c: Column) -> Column:
    """Blanks between initials and a surname that were read as one, and after dots before letters."""
    c = F.regexp_replace(c, f"^([{U}]{{2}})([{U}][{LOW}]+)", "$1 $2")
    c = F.regexp_replace(c, f"([{U}][{LOW}]+)([{U}]{{2}})$", "$1 $2")
    return F.regexp_replace(c, rf"\.(?=[{L}])", ". ")


def is_upper(c: Column) -> Column:
    """Has a cased character and none that is lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def fragments(c: Column) -> Column:
    """Parts of an unglued word, with two or three bare capitals as single letters."""

    def part(p: Column) -> Column:
        letters = F.regexp_replace(F.upper(p), f"[^{L}]", "")
        bare = F.length(letters).isin(2, 3) & is_upper(p) & ~letters.isin(*PLAIN_SHORT)
        return F.when(bare, F.array_remove(F.split(letters, ""), "")).otherwise(F.array(p))

    return F.flatten(F.transform(split_words(c), part))


def strip_numbering(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\d+[.)\s]+", "")


def trim_punctuation(c: Column) -> Column:
    """Without signs at the ends; a final dot stays only after initials."""
    c = fold_dashes(colon_to_dot(c))
    c = F.regexp_replace(c, rf"^[^{WORDCHAR}\-]+", "")
    c = F.regexp_replace(c, rf"[^{WORDCHAR}.\-]+$", "")
    return let(c, _without_dot)


def _without_dot(c: Column) -> Column:
    dropped = F.regexp_replace(F.substring(c, F.lit(1), F.length(c) - 1), rf"[^{WORDCHAR}\-]+$", "")
    return F.when(c.endswith(".") & ~c.rlike(rf"\A(?:[{L}]\.)+\z"), dropped).otherwise(c)


def plain(c: Column) -> Column:
    """A word that all cleaning leaves as it is: at least two letters, of which only the first may be a capital."""
    return c.rlike(rf"\A[{L}][{LOW}]+\z")


def nearly_plain(c: Column) -> Column:
    """A plain word with signs at its end or none: one fragment, of which `without_signs` is what trimming leaves."""
    return c.rlike(rf"\A[{L}][{LOW}]+[{SIGNS}]*\z")


def without_signs(c: Column) -> Column:
    return F.rtrim(c, F.lit(SIGNS))


def is_initial(c: Column) -> Column:
    return F.upper(c).rlike(rf"\A[{U}]\.?\z")


def is_word(c: Column) -> Column:
    return c.rlike(rf"\A[{L}]+(?:[-–—−][{L}]+)?\z")


def token_type(c: Column) -> Column:
    return F.when(is_initial(c), "initial").when(is_word(c), "word").otherwise("junk")


def normalize_surname(c: Column) -> Column:
    """The nominative of an inflected surname by suffix rules, upper case; at least three letters stay before the suffix."""

    def normal(w: Column) -> Column:
        out = F.regexp_replace(w, "^(.{3,}[СЦ]К)(?:ОГО|ОМУ|ИМ|ОЙ)$", "$1ИЙ")
        out = F.regexp_replace(out, "^(.{3,}(?:ОВ|ЕВ))(?:ОГО|ОМУ|ЫМ|ОМ|ЫХ|ОЙ|У|Е|Ы|А)$", "$1")
        out = F.regexp_replace(out, "^(.{3,}ИН)(?:ОГО|ОМУ|ЫМ|ЫХ|ОЙ|У|Е|Ы|А)$", "$1")
        return F.when(w.rlike("(?:ОВ|ЕВ|ИН|[СЦ]КИЙ)$"), w).otherwise(out)

    return let(F.upper(strip(c)), normal)


def _any(w: Column, *suffixes: str) -> Column:
    out = w.endswith(suffixes[0])
    for s in suffixes[1:]:
        out = out | w.endswith(s)
    return out


def _with(base: Column, endings: str) -> Column:
    return F.array(base, *[F.concat(base, F.lit(e)) for e in endings.split()])


def _cut(w: Column, n: int, endings: str) -> Column:
    return let(F.substring(w, F.lit(1), F.length(w) - n), lambda b: F.array(w, *[F.concat(b, F.lit(e)) for e in endings.split()]))


def surname_forms(c: Column, ready: bool = False) -> Column:
    """Inflected forms of a surname, itself first. `ready` text is in upper case and has no blanks around."""

    def forms(w: Column) -> Column:
        return (
            F.when(w == "", F.array().cast("array<string>"))
            .when(_any(w, "ОВ", "ЕВ", "ИН"), _with(w, "А Е ОГО ОМ ОМУ У ЫМ ЫХ"))
            .when(_any(w, "ОВА", "ЕВА", "ИНА"), _cut(w, 1, "Е ОЙ ОЮ У"))
            .when(_any(w, "СКИЙ", "ЦКИЙ"), _cut(w, 2, "ИЕ ИМ ИХ ОГО ОМ ОМУ"))
            .when(_any(w, "СКАЯ", "ЦКАЯ"), _cut(w, 2, "ОЙ УЮ"))
            .otherwise(F.array(w))
        )

    return forms(c) if ready else let(F.upper(strip(c)), forms)


def word_forms(c: Column, ready: bool = False) -> Column:
    """Case forms of a word, itself first. `ready` text is in upper case and has no blanks around."""

    def forms(w: Column) -> Column:
        return (
            F.when(w == "", F.array().cast("array<string>"))
            .when(_any(w, "А", "Я"), _cut(w, 1, "Е ОЙ ОЮ У Ы"))
            .when(F.right(w, F.lit(1)).isin(*"ЕИОУЫЭЮ"), F.array(w))
            .otherwise(_with(w, "А Е ОМ У"))
        )

    return forms(c) if ready else let(F.upper(strip(c)), forms)


def round_tenth(c: Column) -> Column:
    return F.bround(c, 1)
