"""DuckDB SQL of the queries: common table expressions from documents to tokens, and what each query selects."""

from __future__ import annotations

L, U, LOW, W = "A-Za-zА-Яа-яЁё", "A-ZА-ЯЁ", "a-zа-яё", r"\p{L}\p{N}_"
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абсдефгхийклмнопкрстуввхыз"
PLAIN = "'ДО','ЗА','ИЗ','ИЛИ','ИП','МП','МЫ','НА','НЕ','НИ','ОН','ОНА','ОНИ','ОТ','ПО','ПРИ','ФИО'"
FORM = "'ДАТА','ДИРЕКТОР','ДОЛЖНОСТЬ','ИМЯ','М.П.','МП','ОТЧЕСТВО','ПОДПИСЬ','РУКОВОДИТЕЛЬ','ФАМИЛИЯ'"
PATR, SURN = "(?:ИЧ|ОВНА|ЕВНА|ИЧНА)$", "(?:ОВА?|ЕВА?|ИНА?|[СЦ]КИЙ|[СЦ]КАЯ)$"

#: Texts that queries look at: as they are, in Russian letters, and with hyphens at some word ends.
PLAIN_TEXT = "text"
RUSSIAN = f"translate(text, '{LATIN}{LATIN.upper()}', '{CYRILLIC}{CYRILLIC.upper()}')"
HYPHENS = "replace(replace(text, 'tion ', '- '), 'the ', 'the- | ')"


def up(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'ss'))"


def sub(x: str, pattern: str, to: str, every: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{every}')"


def fold(x: str) -> str:
    return f"translate({x}, '–—−', '---')"


def colon(x: str) -> str:
    return sub(x, f"([{L}]):", r"\1.")


def unglued(x: str) -> str:
    x = sub(x, f"^([{U}]{{2}})([{U}][{LOW}]+)", r"\1 \2")
    x = sub(x, f"([{U}][{LOW}]+)([{U}]{{2}})$", r"\1 \2")
    return sub(x, rf"\.([{L}])", r". \1")


def letters(x: str) -> str:
    return sub(up(x), f"[^{L}]", "")


def bits(x: str) -> str:
    return (
        f"flatten(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda p: p <> ''), lambda p: CASE WHEN length({letters('p')}) IN (2, 3) "
        f"AND {up('p')} = p AND lower(p) <> p AND {letters('p')} NOT IN ({PLAIN}) THEN string_split({letters('p')}, '') ELSE [p] END))"
    )


def unnumbered(x: str) -> str:
    return sub(x, r"^[0-9]+[.)\s]+", "")


def trimmed(x: str) -> str:
    x = sub(sub(fold(colon(x)), rf"^[^{W}\-]+", ""), rf"[^{W}.\-]+$", "")
    return f"list_transform([{x}], lambda t: CASE WHEN t LIKE '%.' AND NOT regexp_full_match(t, '(?:[{L}]\\.)+') THEN {sub('t[:-2]', rf'[^{W}\-]+$', '')} ELSE t END)[1]"


def is_initial(x: str) -> str:
    return f"regexp_full_match({up(x)}, '[{U}]\\.?')"


def is_word(x: str) -> str:
    return f"regexp_full_match({x}, '[{L}]+(?:[-–—−][{L}]+)?')"


def kind(x: str) -> str:
    return f"CASE WHEN {is_initial(x)} THEN 'initial' WHEN {is_word(x)} THEN 'word' ELSE 'junk' END"


def stripped(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def words(text: str = PLAIN_TEXT, source: str = "SELECT doc_id, {} AS text FROM documents") -> str:
    return f"""
src AS ({source.format(text)}),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM src)),
bl AS (SELECT doc_id, block, (block // 50 + 1)::INTEGER AS page, {stripped('line')} AS text, (12 * (block % 50))::DOUBLE AS y0 FROM ln),
pt AS (SELECT doc_id, block, page, y0, length(text) AS n, unnest(ps) AS word, generate_subscripts(ps, 1) - 1 AS k, len(ps) AS np FROM (SELECT *, string_split_regex(text, '\\s') AS ps FROM bl WHERE text <> '')),
st AS (SELECT *, (sum(length(word) + 1) OVER (PARTITION BY doc_id, block ORDER BY k) - length(word) - 1)::DOUBLE AS start FROM pt),
w AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, k) - 1)::INTEGER AS word_pos, page, word AS text,
  CASE WHEN np > 1 THEN start * 6 ELSE 0::DOUBLE END AS x0, y0, CASE WHEN np > 1 THEN (start + length(word)) * 6 ELSE (6 * n)::DOUBLE END AS x1, y0 + 10 AS y1
  FROM st WHERE word <> '')"""


def tokens(text: str = PLAIN_TEXT, source: str = "SELECT doc_id, {} AS text FROM documents") -> str:
    lead = ", ".join(f"lead({c}, {k}) OVER o AS {c}_{k}" for k in range(1, 5) for c in ("text", "raw", "x0", "y0", "x1", "y1"))
    span = "NULL"
    for k in range(4, 0, -1):
        down, high = f"(y0_{k} - y0)", "greatest(y1 - y0, 8)"
        joins = "true" if k == 1 else f"({down} > 0 AND {down} < 4 * {high} AND abs(x0_{k} - x0) < 150)"
        span = f"CASE WHEN text_{k} IS NULL THEN NULL WHEN NOT {is_word(f'text_{k}')} THEN {span} WHEN NOT {is_word('text[:-2]')} THEN NULL WHEN {joins} THEN {k} WHEN {down} > 4 * {high} THEN NULL ELSE {span} END"
    pick = lambda c: "CASE span " + " ".join(f"WHEN {k} THEN {c}_{k}" for k in range(1, 5)) + " END"
    return f"""{words(text, source)},
cl AS (SELECT *, {unglued(colon(fold(stripped('text'))))} AS clean FROM w),
fr AS (SELECT * EXCLUDE (bs), unnest(bs) AS bit, generate_subscripts(bs, 1) - 1 AS k, len(bs) AS n FROM (SELECT *, {bits('clean')} AS bs FROM cl WHERE clean <> '')),
fx AS (SELECT *, (x1 - x0) / greatest(length(text), 1) AS ch, (sum(length(bit) + 1) OVER (PARTITION BY doc_id, word_pos ORDER BY k) - length(bit) - 1)::DOUBLE AS ofs FROM fr),
ex AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY word_pos, k) - 1)::INTEGER AS idx, page, CASE WHEN n > 1 THEN bit ELSE clean END AS text, CASE WHEN n > 1 THEN bit ELSE text END AS raw,
  CASE WHEN n > 1 THEN x0 + ch * ofs ELSE x0 END AS x0, y0, CASE WHEN n > 1 THEN x0 + ch * ofs + ch * length(bit) ELSE x1 END AS x1, y1 FROM fx),
tr AS (SELECT * REPLACE ({trimmed(unnumbered(stripped('text')))} AS text) FROM ex),
rs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS seq FROM tr WHERE text <> ''),
hy AS (SELECT *, CASE WHEN text LIKE '%-' THEN {span} END AS span FROM (SELECT *, {lead} FROM rs WINDOW o AS (PARTITION BY doc_id ORDER BY idx))),
mm AS (SELECT doc_id, seq, span FROM hy WHERE span IS NOT NULL),
nx AS (SELECT a.doc_id, a.seq, min(b.seq) AS nxt FROM mm a LEFT JOIN mm b ON a.doc_id = b.doc_id AND a.seq + a.span < b.seq GROUP BY a.doc_id, a.seq),
kp AS (SELECT doc_id, min(seq) AS seq FROM mm GROUP BY doc_id UNION ALL SELECT nx.doc_id, nx.nxt FROM kp JOIN nx ON kp.doc_id = nx.doc_id AND kp.seq = nx.seq WHERE nx.nxt IS NOT NULL),
mg AS (SELECT hy.*, kp.seq IS NOT NULL AS merges, max(CASE WHEN kp.seq IS NOT NULL THEN hy.seq + span END) OVER (PARTITION BY hy.doc_id ORDER BY hy.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until
  FROM hy LEFT JOIN kp ON hy.doc_id = kp.doc_id AND hy.seq = kp.seq),
md AS (SELECT doc_id, idx, page, CASE WHEN merges THEN (CASE WHEN span = 1 THEN text ELSE text[:-2] END) || {pick('text')} ELSE text END AS text, CASE WHEN merges THEN raw || {pick('raw')} ELSE raw END AS raw,
  x0, y0, CASE WHEN merges THEN greatest(x1, {pick('x1')}) ELSE x1 END AS x1, CASE WHEN merges THEN greatest(y1, {pick('y1')}) ELSE y1 END AS y1 FROM mg WHERE until IS NULL OR seq > until),
tk AS (SELECT doc_id, idx, page, x0, y0, x1, y1, {kind('text')} AS type, {up('text')} AS text, raw FROM md)"""


def endings(base: str, words_: str) -> str:
    return "[" + ", ".join(f"{base} || '{e}'" for e in words_.split()) + "]"


def surname_forms(w: str) -> str:
    return (
        f"list_distinct(list_concat([{w}], CASE WHEN regexp_matches({w}, '(?:ОВ|ЕВ|ИН)$') THEN {endings(w, 'А Е ОГО ОМ ОМУ У ЫМ ЫХ')} "
        f"WHEN regexp_matches({w}, '(?:ОВА|ЕВА|ИНА)$') THEN {endings(w + '[:-2]', 'Е ОЙ ОЮ У')} WHEN regexp_matches({w}, '[СЦ]КИЙ$') THEN {endings(w + '[:-3]', 'ИЕ ИМ ИХ ОГО ОМ ОМУ')} "
        f"WHEN regexp_matches({w}, '[СЦ]КАЯ$') THEN {endings(w + '[:-3]', 'ОЙ УЮ')} ELSE [] END))"
    )


def word_forms(w: str) -> str:
    return (
        f"list_distinct(list_concat([{w}], CASE WHEN regexp_matches({w}, '[^АЕИОУЫЭЮЯ]$') THEN {endings(w, 'А Е ОМ У')} "
        f"WHEN regexp_matches({w}, '[АЯ]$') THEN {endings(w + '[:-2]', 'Е ОЙ ОЮ У Ы')} ELSE [] END))"
    )


def normal(w: str) -> str:
    x = sub(w, "^(.{3,}[СЦ]К)(?:ОГО|ОМУ|ИМ|ОЙ)$", r"\1ИЙ")
    x = sub(x, "^(.{3,}(?:ОВ|ЕВ))(?:ОГО|ОМУ|ЫМ|ОМ|ЫХ|ОЙ|У|Е|Ы|А)$", r"\1")
    x = sub(x, "^(.{3,}ИН)(?:ОГО|ОМУ|ЫМ|ЫХ|ОЙ|У|Е|Ы|А)$", r"\1")
    return f"CASE WHEN regexp_matches({w}, '(?:ОВ|ЕВ|ИН|[СЦ]КИЙ)$') THEN {w} ELSE {x} END"
