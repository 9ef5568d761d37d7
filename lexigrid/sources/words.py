"""Words with boxes: laid out from text tables, split from recognised blocks, or from PDF plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.text import split_white, strip

#: Layout of plain text: characters and lines in points, lines on a page.
CHAR, LINE, HEIGHT, PAGE_LINES = 6.0, 12.0, 10.0, 50
CONFIDENCE, PAD = 0.3, 40.0
READABLE = 50


def lay_out(table: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """Blocks (doc_id, block, page, text, x0..y1), a line of text each; blank lines take room but give no block.

    Rows without a key or a text, and blank texts, give nothing. Rows of one key are one document: their lines follow each
    other in the order of their texts, so that repeated rows come one after another. Other columns, whatever their names,
    aren't looked at. Texts are shuffled to their document here, once and before they are cut up: all later steps keep
    that partitioning, and one document is the work of one task.
    """
    rows = table.select(F.col(key).cast("long").alias("doc_id"), (F.col("text") if text is None else text).alias("text")).where("doc_id is not null and text is not null")
    # A given number isn't coalesced by bytes: a text becomes rows of dozens of times its size.
    rows = rows.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    earlier = Window.partitionBy("doc_id").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.size(F.split("text", "\n"))).over(earlier), F.lit(0))
    lines = rows.select("doc_id", before.cast("int").alias("before"), "text").select("doc_id", "before", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("doc_id", (F.col("before") + F.col("at")).alias("block"), strip(F.col("line")).alias("text")).where("text <> ''")
    top = F.lit(LINE) * (F.col("block") % PAGE_LINES)
    return lines.select(
        "doc_id", "block", (F.floor(F.col("block") / PAGE_LINES) + 1).cast("int").alias("page"), "text",
        F.lit(0.0).alias("x0"), top.alias("y0"), (F.lit(CHAR) * F.length("text")).alias("x1"), (top + HEIGHT).alias("y1"),
    )


def from_recognised(blocks: DataFrame, scale_x: Column | float, scale_y: Column | float) -> DataFrame:
    """Blocks of (doc_id, page, block, bbox, text, conf): those of enough confidence, with padding taken off and pixels scaled to points.

    Blocks without text, confidence or document go; a block without a box keeps its text and has null coordinates. Repeated
    blocks are kept, and other columns aren't looked at.
    """
    good = blocks.where((F.col("conf") >= CONFIDENCE) & F.col("doc_id").isNotNull()).withColumn("text", strip(F.col("text"))).where("text <> ''").repartition("doc_id")
    scale = {"x": F.lit(scale_x) if isinstance(scale_x, float) else scale_x, "y": F.lit(scale_y) if isinstance(scale_y, float) else scale_y}
    side = lambda f, k: ((f(F.transform("bbox", lambda p: p[k])) - PAD) * scale[k]).alias(f"{k}{0 if f is F.array_min else 1}")
    return good.select("doc_id", "block", "page", "text", side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y"))


def split_blocks(blocks: DataFrame) -> DataFrame:
    """Words (schemas.WORD) of blocks: a block of one word keeps its box, others are cut in proportion to characters.

    Words are numbered by block and place in it; blocks of one number, as repeated ones, by their place on the page and text.
    Null texts and documents give nothing, an empty table gives an empty table.
    """
    box = ("x0", "y0", "x1", "y1")
    some = blocks.where("doc_id is not null and text is not null").select("doc_id", "block", "page", *box, "text", F.greatest(F.length("text"), F.lit(1)).alias("n"), split_white(F.col("text")).alias("parts"))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "page", "y0", "x0", "text"))
    rows = some.withColumn("turn", turn).select("doc_id", "turn", "page", *box, "n", (F.size("parts") > 1).alias("several"), F.posexplode("parts").alias("k", "word"))
    line = Window.partitionBy("doc_id", "turn").orderBy("k")
    start = F.sum(F.length("word") + 1).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.length("word") - 1
    placed = rows.withColumn("start", start).where("word <> ''")
    char = (F.col("x1") - F.col("x0")) / F.col("n")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "k")) - 1
    return placed.select(
        "doc_id", order.cast("int").alias("word_pos"), "page", F.col("word").alias("text"),
        F.when(F.col("several"), F.col("x0") + F.col("start") * char).otherwise(F.col("x0")).alias("x0"), "y0",
        F.when(F.col("several"), F.col("x0") + (F.col("start") + F.length("word")) * char).otherwise(F.col("x1")).alias("x1"), "y1",
    )


def words(table: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """Words (schemas.WORD) of a table of texts, laid out by `lay_out`, which says what becomes of nulls and repeated keys."""
    return split_blocks(lay_out(table, key, text))


def readability(pages: DataFrame, threshold: int = READABLE) -> DataFrame:
    """(doc_id, mean_chars, readable) of pages (doc_id, page, text): whether the mean stripped length is at least `threshold`.

    A null page counts as an empty one, repeated pages count each, and a document without pages has no row. Pages without a
    document are one document of null.
    """
    mean = F.coalesce(F.avg(F.length(strip(F.coalesce("text", F.lit(""))))), F.lit(0.0))
    return pages.groupBy("doc_id").agg(mean.alias("mean_chars")).withColumn("readable", F.col("mean_chars") >= threshold)


Extract = Callable[[bytes], Iterator[tuple[int, str, float, float, float, float]]]


def scan_pdf(spark: SparkSession, path: str, extract: Extract) -> DataFrame:
    """Words of PDF files by a plug-in `extract`: content -> (page, text, x0, y0, x1, y1), for text layers or recognition.

    A file that the plug-in can't read gives one row with `error` and no word. Files are read by `binaryFile`, one row each.
    """
    import pandas as pd

    columns = ["path", "word_pos", "page", "text", "x0", "y0", "x1", "y1", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    found = [w for w in extract(bytes(content)) if w[1].strip()]
                    out += [(name, i, w[0], w[1].strip(), *w[2:], None) for i, w in enumerate(found)]
                except Exception as error:  # noqa: BLE001 - a plug-in's failure is data here
                    out.append((name, None, None, None, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, word_pos int, page int, text string, x0 double, y0 double, x1 double, y1 double, error string")
