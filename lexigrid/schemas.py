"""Schemas of the tables that operators exchange. Order is data: every table carries its position columns."""

WORD = "doc_id long, word_pos int, page int, text string, x0 double, y0 double, x1 double, y1 double"
BLOCK = "doc_id long, page int, block int, bbox array<struct<x:double,y:double>>, text string, conf double"
TOKEN = "doc_id long, idx int, page int, x0 double, y0 double, x1 double, y1 double, type string, text string, raw string, parts array<struct<x0:double,y0:double,x1:double,y1:double>>"
QUERY = "term_ord int, term string, surname string, name_initial string, name_full string, patronymic_initial string, patronymic_full string"
HIT = "doc_id long, term_ord int, search_term string, found_text string, page int, x0 double, y0 double, x1 double, y1 double, surname_idx int, role_ord int"
ANNOTATION = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, red double, green double, blue double, width double"
