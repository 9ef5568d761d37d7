"""What a search leaves behind: texts, annotations, flags, previews.

Null documents are one document here (but match no hit), repeated words, hits and documents are as many words and
annotations and one flag, further columns aren't looked at, and empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def texts(words: DataFrame) -> DataFrame:
    """(doc_id, text): all words in order, with blanks between."""
    parts = F.sort_array(F.collect_list(F.struct("word_pos", "text")))
    return words.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def annotations(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Red boxes (schemas.ANNOTATION) of hits on pages that exist; `pages` is (doc_id, page)."""
    here = hits.join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    return here.select("doc_id", "page", "x0", "y0", "x1", "y1", *[F.lit(v).alias(k) for k, v in (("red", 1.0), ("green", 0.0), ("blue", 0.0), ("width", 2.0))])


def highlighted(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, highlighted): whether a document has any hit."""
    some = hits.groupBy("doc_id").agg(F.lit(True).alias("some"))
    return documents.select("doc_id").distinct().join(some, "doc_id", "left").select("doc_id", F.coalesce("some", F.lit(False)).alias("highlighted"))


def preview(words: DataFrame, n: int = 20) -> DataFrame:
    """The first words of each document."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("word_pos"))
    return words.withColumn("turn", turn).where(F.col("turn") <= n).drop("turn")


def write_text(words: DataFrame, path: str, files: bool = False) -> None:
    """Texts of documents below `path`: a Parquet table (doc_id, text) in as many files as there are partitions or, with `files`,
    a text file for each document in a folder `doc_id=...`, which suits thousands of documents and not billions."""
    if files:
        texts(words).repartition("doc_id").write.partitionBy("doc_id").text(path)
    else:
        texts(words).write.parquet(path)
