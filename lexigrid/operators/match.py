"""Search for names among tokens: by surname, by surname with given name and patronymic, by initials.

Queries are few and are broadcast after a check of their number (see `few`); tokens stay partitioned by document. No operator
here persists anything: a caller that searches the same tokens by several branches persists them, and releases them after.

In all of them tokens without a document, a page or a text match nothing, and neither do queries without a surname or initials;
repeated queries (of one `term_ord`) are one query; repeated tokens (of one doc_id and idx) are one token, of which any stays;
further columns of either table aren't looked at; without tokens or without queries there are no hits. Ties are
resolved by idx, as the functions say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.names import mode
from lexigrid.functions.text import FORM_WORDS, PATRONYMIC, round_tenth, surname_forms, word_forms

#: So many queries at most are broadcast; more are joined by shuffling both sides.
BROADCAST_TERMS = 50_000
GAP, NEAR_X, NEAR_Y = 6, 400, 80
BOX = ("page", "x0", "y0", "x1", "y1")


def few(queries: DataFrame) -> DataFrame:
    """`queries`, to be broadcast if there are at most BROADCAST_TERMS of them."""
    return F.broadcast(queries) if queries.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else queries


def _dash(c: Column, signs: str = "[-–—−]") -> Column:
    return c.rlike(signs)


def surname_matches(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """Word tokens that share an inflected form with a query's surname (`term_ord`, `term`, query columns `q`).

    A token with a dash doesn't match a query without one. Equal forms are an equi-join on the form, once for each pair.
    """
    asked = queries.where("surname is not null").select("term_ord", F.struct(*queries.columns).alias("q"), _dash(F.col("surname")).alias("dashed"), F.explode(surname_forms(F.col("surname"))).alias("form"))
    named = tokens.where("type = 'word'").withColumn("form", F.explode(surname_forms(F.col("text"), ready=True)))
    both = named.join(few(asked), "form").where(F.col("dashed") | ~_dash(F.col("raw")))
    return both.drop("form", "dashed").dropDuplicates(["doc_id", "idx", "term_ord"])


def by_surname(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of queries that are a surname only: the token is a form of the query's word, or the other way round."""
    asked = queries.where("surname is not null").select("term_ord", "term", F.upper("surname").alias("name"), F.col("surname").contains("-").alias("dashed"), F.explode(word_forms(F.col("surname"))).alias("key"))
    # A form of the query must be the token itself; the query itself may be any form of the token.
    named = tokens.where("type = 'word'").withColumn("key", F.explode(word_forms(F.col("text"), ready=True)))
    both = named.join(few(asked), "key").where((F.col("key") == F.col("text")) | (F.col("key") == F.col("name")))
    both = both.where(F.col("dashed") | ~F.col("raw").contains("-")).dropDuplicates(["doc_id", "idx", "term_ord"])
    return first_hits(both.select("doc_id", "term_ord", F.col("term").alias("search_term"), F.col("raw").alias("found_text"), *BOX, F.col("idx").alias("surname_idx"), F.lit(0).alias("role_ord")))


def name_matches(text: Column, kind: Column, initial: Column, full: Column, patronymic: bool) -> Column:
    """Whether a token may be the given name or the patronymic that is asked for; false where no initial is."""
    asked = F.upper(full)
    long = (F.length(full) > 3) & text.startswith(F.substring(asked, F.lit(1), F.length(full) - 2))
    loose = text.rlike(PATRONYMIC) if patronymic else F.lit(True)
    spelled = F.when(full.isNotNull(), (text == asked) | long).otherwise(loose)
    ok = (F.substring(text, 1, 1) == F.upper(initial)) & ((kind == "initial") | (~text.isin(*FORM_WORDS) & spelled))
    return F.coalesce(ok, F.lit(False))


def distance(a: Column, b: Column) -> Column:
    """Between the centres of two boxes, with vertical shifts counted twice."""
    middle = lambda t, k: (t[f"{k}0"] + t[f"{k}1"]) / 2
    x, y = F.abs(middle(a, "x") - middle(b, "x")), F.abs(middle(a, "y") - middle(b, "y")) * 2
    return F.sqrt(x * x + y * y)


def score(s: Column, n: Column, p: Column | None, high: Column) -> Column:
    """The lower, the better: distances, less for dots and for parts on one line, more for dotted given initials."""
    out = distance(s, n) if p is None else distance(s, n) + distance(n, p)
    out = out - F.when(n["raw"].contains("."), high * 35).otherwise(0.0)
    if p is not None:
        out = out - F.when(p["raw"].contains("."), high * 35).otherwise(0.0)
    out = out - F.when(F.abs(s["y0"] - n["y0"]) < high * 1.2, high * 20).otherwise(0.0)
    if p is not None:
        out = out - F.when(F.abs(n["y0"] - p["y0"]) < high * 1.2, high * 20).otherwise(0.0)
    return out + F.when((n["type"] == "initial") & (F.length(n["text"]) > 1), high * 10).otherwise(0.0)


def candidates(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, term_ord, q, s, t, is_name, is_patronymic): tokens of the page around each surname that fit a part of the
    query. Tokens are on both sides of the join: it pays to persist them before."""
    fields = ("idx", *BOX, "type", "text", "raw")
    found = surname_matches(tokens, queries.where(mode() == "fio")).select("doc_id", "page", "term_ord", "q", F.struct(*fields).alias("s"))
    around = tokens.select("doc_id", "page", F.struct(*fields).alias("t"))
    high = F.greatest(F.col("s.y1") - F.col("s.y0"), F.lit(8.0))
    near = (F.col("s.idx") != F.col("t.idx")) & (F.abs(F.col("t.y0") - F.col("s.y0")) <= high * 4) & (F.abs(F.col("t.x0") - F.col("s.x0")) <= high * 100)
    is_name = name_matches(F.col("t.text"), F.col("t.type"), F.col("q.name_initial"), F.col("q.name_full"), False)
    is_patronymic = name_matches(F.col("t.text"), F.col("t.type"), F.col("q.patronymic_initial"), F.col("q.patronymic_full"), True)
    both = found.join(around, ["doc_id", "page"]).where(near)
    return both.select("doc_id", "term_ord", "q", "s", "t", is_name.alias("is_name"), is_patronymic.alias("is_patronymic")).where("is_name or is_patronymic")


def best_names(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, term_ord, q, s, n, p, score): the best given name and patronymic of each surname; surnames without all parts go.

    Pairs are formed inside a group by arrays, so that a surname's tokens meet without a second join; of equal scores
    the earliest given name wins, then the earliest patronymic.
    """
    near = candidates(tokens, queries)
    part = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("t"))))  # noqa: E731 - idx leads the struct
    sets = near.groupBy("doc_id", "term_ord", F.col("s.idx").alias("at")).agg(F.first("q").alias("q"), F.first("s").alias("s"), part("is_name").alias("names"), part("is_patronymic").alias("patronymics"))
    high = F.greatest(F.col("s.y1") - F.col("s.y0"), F.lit(8.0))
    names = sets.where("q.name_initial is not null and size(names) > 0").withColumn("n", F.explode("names"))
    entry = lambda n, p: F.struct(score(F.col("s"), n, p, high).alias("score"), n["idx"].alias("n_idx"), (p["idx"] if p is not None else F.lit(None).cast("int")).alias("p_idx"), p.alias("p") if p is not None else F.lit(None).cast(near.schema["t"].dataType).alias("p"))
    two = F.array_min(F.transform(F.filter("patronymics", lambda p: p["idx"] != F.col("n.idx")), lambda p: entry(F.col("n"), p)))
    choice = F.when(F.col("q.patronymic_initial").isNotNull(), two).otherwise(entry(F.col("n"), None))
    pairs = names.select("doc_id", "term_ord", "at", "q", "s", "n", choice.alias("best")).where("best is not null")
    alone = sets.where("q.name_initial is null and q.patronymic_initial is not null and size(patronymics) > 0")
    alone = alone.select("doc_id", "term_ord", "at", "q", "s", F.lit(None).cast(near.schema["t"].dataType).alias("n"), F.array_min(F.transform("patronymics", lambda p: entry(p, None).withField("p", p))).alias("best"))
    first = F.row_number().over(Window.partitionBy("doc_id", "term_ord", "at").orderBy("best.score", "best.n_idx", "best.p_idx"))
    best = pairs.unionByName(alone).withColumn("rank", first).where("rank = 1")
    return best.select("doc_id", "term_ord", "q", "s", "n", F.col("best.p").alias("p"), F.col("best.score").alias("score"))


def by_full_name(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of queries of a surname with further parts: up to three rows for each surname."""
    best = best_names(tokens, queries)
    rows = best.select("doc_id", "term_ord", F.col("q.term").alias("search_term"), F.col("s.idx").alias("surname_idx"), F.posexplode(F.array("s", "n", "p")).alias("role_ord", "t")).where("t is not null")
    return first_hits(rows.select("doc_id", "term_ord", "search_term", F.col("t.raw").alias("found_text"), *[F.col(f"t.{k}").alias(k) for k in BOX], "surname_idx", "role_ord"))


def by_initials(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of structured queries without a surname: an initial, then within GAP tokens the second one, nothing but junk between."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    token = F.struct("idx", *BOX, "type", "text", "raw")
    rows = tokens.select("doc_id", token.alias("t"), F.when(F.col("type") == "initial", F.array(*[F.lead(token, k).over(order) for k in range(1, GAP + 1)])).alias("next")).where("t.type = 'initial'")
    letter = lambda t: F.substring(t["text"], 1, 1)
    asked = queries.where(F.col("surname").isNull()).where("name_initial is not null or patronymic_initial is not null").dropDuplicates(["term_ord"])
    asked = asked.select("term_ord", "term", "name_initial", "patronymic_initial", F.coalesce("name_initial", "patronymic_initial").alias("letter"))
    both = rows.withColumn("letter", letter(F.col("t"))).join(few(asked), "letter")
    t = F.col("t")

    def ends(c: Column) -> Column:
        close = (F.abs(t["y0"] - c["y0"]) <= NEAR_Y) & (F.greatest(t["x0"], c["x0"]) - F.least(t["x1"], c["x1"]) <= NEAR_X)
        return c.isNotNull() & (c["type"] != "junk") & ((c["type"] != "initial") | ~close | (letter(c) == F.col("patronymic_initial")))

    last = F.get(F.filter("next", ends), F.lit(0))
    close = (F.abs(t["y0"] - last["y0"]) <= NEAR_Y) & (F.greatest(t["x0"], last["x0"]) - F.least(t["x1"], last["x1"]) <= NEAR_X)
    second = F.when((last["type"] == "initial") & close & (letter(last) == F.col("patronymic_initial")), last)
    found = both.withColumn("p", F.when(F.col("name_initial").isNotNull() & F.col("patronymic_initial").isNotNull(), second))
    found = found.where("name_initial is null or patronymic_initial is null or p is not null")
    rows = found.select("doc_id", "term_ord", F.col("term").alias("search_term"), F.col("t.idx").alias("surname_idx"), F.posexplode(F.array("t", "p")).alias("role_ord", "m")).where("m is not null")
    return first_hits(rows.select("doc_id", "term_ord", "search_term", F.col("m.raw").alias("found_text"), *[F.col(f"m.{k}").alias(k) for k in BOX], "surname_idx", "role_ord"))


def first_hits(hits: DataFrame) -> DataFrame:
    """The first hit of each query at each place of a page (to a tenth of a point)."""
    key = ("doc_id", "term_ord", "page", round_tenth(F.col("x0")), round_tenth(F.col("y0")))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("surname_idx", "role_ord"))
    return hits.withColumn("turn", turn).where("turn = 1").drop("turn")


def search(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (schemas.HIT) of all queries, each dispatched by its parts; hits of different queries are not compared.

    Tokens are used by each branch: it pays to persist them before, and to release them after.
    """
    out = by_full_name(tokens, queries)
    return out.unionByName(by_surname(tokens, queries.where(mode() == "surname"))).unionByName(by_initials(tokens, queries.where(mode() == "initials")))
