"""Tokens of words: ungluing, cleaning, repair of hyphenated line breaks, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.text import colon_to_dot, fold_dashes, fragments, is_word, let, nearly_plain, plain, strip, strip_numbering, token_type, trim_punctuation, unglue, without_signs

AHEAD = 4


def _pieces(words: DataFrame) -> DataFrame:
    """Fragments of words before they are numbered: (doc_id, word_pos, k, page, text, raw, box)."""
    some = words.where((strip(F.col("text")) != "") & F.col("doc_id").isNotNull()).withColumn("plain", nearly_plain(F.col("text")))

    def split(clean: Column) -> Column:
        return let(fragments(clean), lambda bits: F.when(F.size(bits) > 1, F.transform(bits, lambda b, i: F.struct(b.alias("bit"), before(bits, i).alias("at")))).otherwise(F.array(F.struct(clean.alias("bit"), F.lit(0).alias("at")))))

    def before(bits: Column, i: Column) -> Column:
        return F.aggregate(F.slice(bits, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1)

    # Most words are plain, and pass by the cleaning.
    whole = F.array(F.struct(F.col("text").alias("bit"), F.lit(0).alias("at")))
    bits = F.when(F.col("plain"), whole).otherwise(let(unglue(colon_to_dot(fold_dashes(strip(F.col("text"))))), split))
    box = ("x0", "y0", "x1", "y1")
    rows = some.select("doc_id", "word_pos", "page", "text", "plain", *box, bits.alias("bits")).select("doc_id", "word_pos", "page", "text", "plain", *box, F.size("bits").alias("n"), F.posexplode("bits").alias("k", "piece"))
    several, bit = F.col("n") > 1, F.col("piece.bit")
    char = (F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1))
    left = F.col("x0") + char * F.col("piece.at")
    return rows.select(
        "doc_id", "word_pos", "k", "page", bit.alias("text"), F.when(several, bit).otherwise(F.col("text")).alias("raw"), "plain",
        F.when(several, left).otherwise(F.col("x0")).alias("x0"), "y0", F.when(several, left + char * F.length(bit)).otherwise(F.col("x1")).alias("x1"), "y1",
    )


def _numbered(pieces: DataFrame) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("word_pos", "k")) - 1
    return pieces.withColumn("idx", idx.cast("int"))


def _trimmed(c: Column) -> Column:
    return F.when(plain(c), c).otherwise(trim_punctuation(strip_numbering(strip(c))))


def expand(words: DataFrame) -> DataFrame:
    """Fragments of words with their share of the box, `raw`, and `idx`, the place in the document.

    Words without a document or a text, and blank ones, go. Words of one place in one document, as of repeated rows, are
    kept and numbered in any order. Other columns aren't looked at, and an empty table gives an empty table.
    """
    return _numbered(_pieces(words)).select("doc_id", "idx", "page", "text", "raw", "x0", "y0", "x1", "y1")


def clean(expanded: DataFrame) -> DataFrame:
    """Without numbering and signs at the ends; what is then empty, or null, goes, which leaves gaps in idx."""
    return expanded.withColumn("text", F.explode(F.array(_trimmed(F.col("text"))))).where("text <> ''")


def merge_hyphens(raw: DataFrame, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Words broken by a hyphen joined with their continuation among the next AHEAD tokens; tokens between are swallowed.

    Where it ends is a local matter of each hyphen; only a hyphen that another merge has swallowed may not merge. Hyphens
    whose reaches overlap form a group, in which a fold decides; groups are short, whatever the length of the document.
    `by` are the columns that order a document. A hyphen at the end of a document stays; an empty table is allowed.
    """
    order = Window.partitionBy("doc_id").orderBy(*by)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = raw.withColumn("dash", F.col("text").endswith("-"))
    near = F.lit(False)
    for k in range(1, AHEAD + 1):
        near = near | F.coalesce(F.lag("dash", k).over(order), F.lit(False))
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("near", near)
    token = F.when(F.col("near"), F.struct("text", "raw", "x0", "y0", "x1", "y1"))  # few tokens follow a hyphen
    rows = rows.withColumn("next", F.when(F.col("dash"), F.array(*[F.lead(token, k).over(order) for k in range(1, AHEAD + 1)])))
    stem = F.substring(F.col("text"), F.lit(1), F.length("text") - 1)
    high = F.greatest(F.col("y1") - F.col("y0"), F.lit(8.0))

    def outcome(to: Column, k: Column) -> Column:
        """What the token k + 1 ahead decides: it is skipped (0), ends the search (1) or is the continuation (2)."""
        down = to["y0"] - F.col("y0")
        joins = (k == 0) | ((down > 0) & (down < high * 4) & (F.abs(to["x0"] - F.col("x0")) < 150))
        return F.when(to.isNull(), 1).when(~is_word(to["text"]), 0).when(~is_word(stem), 1).when(joins, 2).when(down > high * 4, 1).otherwise(0)

    decided = F.transform("next", lambda to, k: F.struct(outcome(to, k).alias("is"), (k + 1).alias("span")))
    first = let(F.get(F.filter(decided, lambda d: d["is"] > 0), F.lit(0)), lambda d: F.when(d["is"] == 2, d["span"]))
    rows = rows.withColumn("span", F.when(F.col("dash"), first))
    reach = F.col("seq") + F.col("span")
    rows = rows.withColumn("ahead", F.max(reach).over(earlier))
    inside = F.coalesce(F.col("seq") <= F.col("ahead"), F.lit(False))
    opens = F.max(F.when(F.col("span").isNotNull() & ~inside, F.col("seq"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("group", F.when(inside | F.col("span").isNotNull(), opens))
    before = F.collect_list(F.when(F.col("span").isNotNull(), F.struct(F.col("seq").alias("seq"), reach.alias("reach")))).over(Window.partitionBy("doc_id", "group").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    end = F.when(F.col("group").isNotNull(), F.aggregate("before", F.lit(0), lambda a, m: F.when(m["seq"] > a, m["reach"]).otherwise(a)))
    rows = rows.withColumn("end", F.coalesce(end, F.lit(0))).where(F.col("seq") > F.col("end")).withColumn("merges", F.col("span").isNotNull())
    to = F.get("next", F.col("span") - 1)
    pick = lambda new, old: F.when(F.col("merges"), new).otherwise(F.col(old)).alias(old)
    box = lambda c: F.struct(*[(c[k] if c is not None else F.col(k)).alias(k) for k in ("x0", "y0", "x1", "y1")])
    return rows.select(
        "doc_id", "idx", "page", pick(F.concat(F.when(F.col("span") == 1, F.col("text")).otherwise(stem), to["text"]), "text"), pick(F.concat("raw", to["raw"]), "raw"),
        "x0", "y0", pick(F.greatest("x1", to["x1"]), "x1"), pick(F.greatest("y1", to["y1"]), "y1"), F.when(F.col("merges"), F.array(box(None), box(to))).alias("parts"),
    )


def tokens(words: DataFrame) -> DataFrame:
    """Tokens (schemas.TOKEN) of words, which `expand`, `clean` and `merge_hyphens` describe.

    All steps keep the partitioning by doc_id. Texts are cleaned before they are numbered, so that the filter on what is
    left of them doesn't clean them twice, and the order by word and fragment, which the numbering needs, serves the merge.
    """
    pieces = _pieces(words).withColumn("trimmed", F.when(F.col("plain"), without_signs(F.col("text"))).otherwise(_trimmed(F.col("text"))))
    rows = _numbered(pieces).where("trimmed <> ''").withColumn("text", F.col("trimmed")).drop("trimmed", "plain")
    rows = merge_hyphens(rows, ("word_pos", "k"))
    return rows.select("doc_id", "idx", "page", "x0", "y0", "x1", "y1", F.when(plain(F.col("text")), "word").otherwise(token_type(F.col("text"))).alias("type"), F.upper("text").alias("text"), "raw", "parts")
