"""The operators of `text` on one Python string, for distinct words of a slice. Both agree on words without white space."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .text import LOW, PLAIN_SHORT, WHITE, L, U

INITIAL, WORD, JUNK = 0, 1, 2
KINDS = ("initial", "word", "junk")
_DASHES = str.maketrans("–—−", "---")
_COLON, _DOT = re.compile(f"([{L}]):"), re.compile(rf"\.(?=[{L}])")
_BEFORE, _AFTER = re.compile(f"^([{U}]{{2}})([{U}][{LOW}]+)"), re.compile(f"([{U}][{LOW}]+)([{U}]{{2}})$")
_OTHER, _NUMBER = re.compile(f"[^{L}]"), re.compile(r"^\d+[.)]+")
_PLAIN, _INITIALS = re.compile(rf"[{L}][{LOW}]+"), re.compile(rf"(?:[{L}]\.)+")
_INITIAL, _WORD = re.compile(rf"[{U}]\.?"), re.compile(rf"[{L}]+(?:[-–—−][{L}]+)?")
_SPACES = re.compile(f"[{WHITE}]+")


def is_word(c: str) -> bool:
    return _WORD.fullmatch(c) is not None


def kind(c: str) -> int:
    return INITIAL if _INITIAL.fullmatch(c.upper()) else WORD if is_word(c) else JUNK


def _sign(c: str, but: str) -> bool:
    return c not in but and c != "_" and unicodedata.category(c)[0] not in "LN"


def _rtrim(c: str, but: str) -> str:
    n = len(c)
    while n and _sign(c[n - 1], but):
        n -= 1
    return c[:n]


def trimmed(c: str) -> str:
    """Without numbering and signs at the ends."""
    if _PLAIN.fullmatch(c):
        return c
    c = _COLON.sub(r"\1.", _NUMBER.sub("", c).translate(_DASHES))
    n = 0
    while n < len(c) and _sign(c[n], "-"):
        n += 1
    c = _rtrim(c[n:], ".-")
    return _rtrim(c[:-1], "-") if c.endswith(".") and not _INITIALS.fullmatch(c) else c


def _part(p: str) -> list[str]:
    letters = _OTHER.sub("", p.upper())
    bare = len(letters) in (2, 3) and p.upper() == p and p.lower() != p and letters not in PLAIN_SHORT
    return list(letters) if bare else [p]


@lru_cache(maxsize=1 << 16)
def pieces(word: str) -> tuple[tuple[str, int, bool, str, int, bool, bool], ...]:
    """Fragments of a word: (text, characters before it, whether there are several, upper case of what trimming leaves, kind,
    whether that is a word, whether that without a final hyphen is a word)."""
    clean = _AFTER.sub(r"\1 \2", _BEFORE.sub(r"\1 \2", _COLON.sub(r"\1.", word.translate(_DASHES))))
    clean = _DOT.sub(". ", clean)
    bits = [b for p in _SPACES.split(clean) if p for b in _part(p)]
    several, at, out = len(bits) > 1, 0, []
    for bit in bits if several else [clean]:
        text = trimmed(bit)
        out.append((bit, at, several, text.upper(), kind(text), is_word(text), text.endswith("-") and is_word(text[:-1])))
        at += len(bit) + 1
    return tuple(out)


def _endings(w: str, n: int, endings: str) -> list[str]:
    return [w, *(w[: len(w) - n] + e for e in endings.split())]


def surname_forms(w: str) -> list[str]:
    """Of a word in upper case without blanks around."""
    if not w:
        return []
    if w.endswith(("ОВ", "ЕВ", "ИН")):
        return _endings(w, 0, "А Е ОГО ОМ ОМУ У ЫМ ЫХ")
    if w.endswith(("ОВА", "ЕВА", "ИНА")):
        return _endings(w, 1, "Е ОЙ ОЮ У")
    if w.endswith(("СКИЙ", "ЦКИЙ")):
        return _endings(w, 2, "ИЕ ИМ ИХ ОГО ОМ ОМУ")
    return _endings(w, 2, "ОЙ УЮ") if w.endswith(("СКАЯ", "ЦКАЯ")) else [w]


def word_forms(w: str) -> list[str]:
    """Of a word in upper case without blanks around."""
    if not w:
        return []
    if w.endswith(("А", "Я")):
        return _endings(w, 1, "Е ОЙ ОЮ У Ы")
    return [w] if w[-1] in "ЕИОУЫЭЮ" else _endings(w, 0, "А Е ОМ У")


def _bases(forms: list[str], endings: dict[str, str]) -> set[str]:
    """All words that might have one of `forms`: `endings` of the forms by what they replace."""
    return {*forms, *(f[: len(f) - len(e)] + old for f in forms for old, new in endings.items() for e in new.split() if f.endswith(e))}


def surnames_like(w: str) -> set[str]:
    """All words that share a form of a surname with `w`."""
    forms = surname_forms(w)
    some = _bases(forms, {"": "А Е ОГО ОМ ОМУ У ЫМ ЫХ", "А": "Е ОЙ ОЮ У", "ИЙ": "ИЕ ИМ ИХ ОГО ОМ ОМУ", "АЯ": "ОЙ УЮ"})
    return {x for x in some if not set(forms).isdisjoint(surname_forms(x))}


def words_like(w: str) -> set[str]:
    """The forms of `w`, and all words of which it is a form."""
    some = _bases([w], {"": "А Е ОМ У", "А": "Е ОЙ ОЮ У Ы", "Я": "Е ОЙ ОЮ У Ы"})
    return {*word_forms(w), *(x for x in some if w in word_forms(x))}
