"""Mixing sources to target weights that change over training.

A schedule gives every source weights at knots between the start (0) and the end (1) of training, linear in between and
normalised at the knots. Its integral is the source's cumulative token demand; a document's place among the tokens of its
source, in an order by hash, is turned into a training position by inverting that demand. A source that has fewer tokens
than its demand is repeated; what lies beyond a source's demand isn't used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import stage

#: Training tokens by default, as a multiple of the tokens there are.
BUDGET = 1.0
#: Documents of a hash range, about, by which a source's running sum is split, so that no task has a whole source.
RANGE_ROWS = 100_000
#: Bytes of text of a range of positions, about, which a task sorts, and the most such ranges.
PART_BYTES, MOST_PARTS = 16 << 20, 50_000


def tokens(text: Column) -> Column:
    """White-space separated words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def shuffled(doc: Column) -> Column:
    """The hash, uniform in [0, 2**32), by which documents of a source are ordered."""
    return F.conv(F.substring(F.md5(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def default_schedule(supply: DataFrame) -> DataFrame:
    """(source, knot, weight): from each source's share of the tokens at the start to the share of their square root at the end."""
    root = F.floor(F.sqrt(F.col("supply").cast("double"))).cast("double")
    ends = F.array(F.struct(F.lit(0.0).alias("knot"), F.col("supply").cast("double").alias("weight")), F.struct(F.lit(1.0).alias("knot"), root.alias("weight")))
    return supply.select("source", F.inline(ends))


def demand(schedule: DataFrame) -> DataFrame:
    """(source, t0, t1, a, b, before, upto): pieces between knots; at t in a piece the demand of the source, as a share of
    all tokens, is before + a (t - t0) + b (t - t0)**2. A knot that a source lacks counts as weight 0 there."""
    knots = schedule.select("knot").distinct()
    filled = schedule.select("source").distinct().crossJoin(knots).join(schedule.groupBy("source", "knot").agg(F.sum("weight").alias("weight")), ["source", "knot"], "left")
    total = F.sum(F.coalesce("weight", F.lit(0.0))).over(Window.partitionBy("knot"))
    share = filled.select("source", "knot", F.when(total > 0, F.coalesce("weight", F.lit(0.0)) / total).otherwise(F.lit(0.0)).alias("share"))
    order = Window.partitionBy("source").orderBy("knot")
    piece = share.select("source", F.col("knot").alias("t0"), F.lead("knot").over(order).alias("t1"), F.col("share").alias("a"), F.lead("share").over(order).alias("next")).where("t1 is not null")
    piece = piece.withColumn("b", (F.col("next") - F.col("a")) / (F.lit(2.0) * (F.col("t1") - F.col("t0"))))
    area = (F.col("a") + F.col("next")) / F.lit(2.0) * (F.col("t1") - F.col("t0"))
    upto = F.sum(area).over(Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0))
    return piece.withColumn("upto", upto).withColumn("before", F.col("upto") - area).select("source", "t0", "t1", "a", "b", "before", "upto")


def uses(docs: DataFrame, schedule: DataFrame | None = None, budget: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(ids, used): the documents that have tokens without their texts, as a written table (see `_identity`), and for each use in
    training (key, size, copy, n_tokens, epoch, position)."""
    ids = docs.select(*_identity(docs), F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tie"), tokens(F.col("text")).alias("n_tokens"))
    ids = stage(ids.where(F.col("size") > 0), "ids")
    spans = 1 << max(6, (ids.count() // RANGE_ROWS).bit_length())
    rows = ids.where("n_tokens > 0").withColumn("turn", shuffled(F.col("doc"))).withColumn("range", F.floor(F.col("turn") / F.lit((1 << 32) / spans)))
    sums = stage(rows.groupBy("source", "range").agg(F.sum("n_tokens").alias("n")), "sums")
    start = sums.select("source", "range", (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("source")).alias("supply"))
    supply = sums.groupBy("source").agg(F.sum("n").alias("supply"))
    pieces = demand(default_schedule(supply) if schedule is None else schedule.withColumn("source", F.coalesce("source", F.lit(""))))
    total = supply.agg(F.sum("supply").alias("total"))
    plan = pieces.crossJoin(total).groupBy("source").agg(F.max("total").alias("total"), F.max("upto").alias("share"), F.sort_array(F.collect_list(F.struct("upto", "t0", "t1", "a", "b", "before"))).alias("pieces"))
    info = start.join(plan, "source").select("source", "range", "start", "supply", "share", "pieces", (F.col("total") * F.lit(float(budget))).alias("budget"))
    order = Window.partitionBy("source", "range").orderBy("turn", F.col("doc").asc_nulls_first(), "tie")
    ranked = rows.withColumn("local", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    ranked = ranked.withColumn("copy", F.row_number().over(Window.partitionBy("source", "range", "key", "size").orderBy("local")))
    ranked = ranked.join(info, ["source", "range"]).withColumn("first", F.col("start") + F.col("local"))
    need = F.col("share") * F.col("budget")
    ranked = ranked.where(F.col("first") < need).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((need - F.col("first")) / F.col("supply")) - 1))))
    due = (F.col("first") + F.col("epoch") * F.col("supply")) / F.col("budget")
    piece = F.filter("pieces", lambda p: p["upto"] > F.col("due")).getItem(0)
    used = ranked.withColumn("due", due).withColumn("p", piece).where("p is not null")
    gap = F.col("due") - F.col("p.before")
    inside = F.sqrt(F.greatest(F.col("p.a") * F.col("p.a") + F.lit(4.0) * F.col("p.b") * gap, F.lit(0.0)))
    position = F.col("p.t0") + F.when(gap <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * gap / (F.col("p.a") + inside))
    return ids, used.select("key", "size", "copy", "n_tokens", "epoch", F.least(position, F.lit(1.0)).alias("position"))


def _identity(docs: DataFrame) -> list[Column]:
    """What a row is found again by: a hash of doc_id, source and text, and the text's length. Rows that agree in them are numbered."""
    return [F.xxhash64("doc_id", F.coalesce("source", F.lit("")), "text").alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")]


def positioned(docs: DataFrame, schedule: DataFrame | None = None, budget: float = BUDGET) -> DataFrame:
    """(row, source, n_tokens, epoch, position): all columns of `docs` in the struct `row`, once for each use in training, sorted
    by position, doc_id (nulls first) and a hash of the row.

    `position` in [0, 1] is when the document's first token is due. A null source is a source of its own. Documents without
    tokens, or null texts, are not used. Repeated rows are used as often as they occur. Documents equal in hash are
    ordered by doc_id (nulls first) and a hash of the text. Texts of any length count whole. An empty table, or a schedule
    without any of the sources, gives an empty table.

    Only identities are ranked; texts are shuffled once to meet their positions, and once to be sorted. Demand makes positions
    even in tokens, so that ranges of equal width hold about as much text and need no sample.
    """
    ids, used = uses(docs, schedule, budget)
    total = ids.agg(F.sum("size")).first()[0] or 0
    parts = min(MOST_PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, int(total * budget) // PART_BYTES + 1))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_identity(docs)).where("size > 0").repartition("key", "size")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("key", "size").orderBy(F.lit(0))))
    # The number of the copy is no key of the join, which would shuffle texts once more: it says which of equal rows meet.
    both = rows.join(used.withColumnRenamed("copy", "its").repartition("key", "size").hint("merge"), ["key", "size"]).where((F.col("copy") - F.col("its")) == 0)
    out = both.select("row", "n_tokens", "epoch", "position", "key").repartitionById(parts, F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int"))
    out = out.sortWithinPartitions("position", F.col("row.doc_id").asc_nulls_first(), "key", "epoch")
    return out.select("row", F.col("row.source").alias("source"), "n_tokens", "epoch", "position")


def mix_sources(docs: DataFrame, schedule: DataFrame | None = None, budget: float = BUDGET) -> DataFrame:
    """`docs` as often as training uses them, range-sorted by position; columns stay as they are, also of clashing names."""
    return positioned(docs, schedule, budget).select("row.*")


def op4_curriculum(spark, sf_dir: str) -> DataFrame:
    """Documents in training order, with their positions (to nine digits) under the default schedule."""
    rows = positioned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("row.doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), F.round("position", 9).alias("position"), "row.text")
