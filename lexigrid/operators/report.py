"""Coverage of queries and summaries of runs.

Rows without a document aren't counted, repeated documents and queries (of one `term_ord`) count once, and further columns
aren't looked at. Without documents or queries coverage is empty, and a summary of no results has one row of zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import split_words
from lexigrid.operators.match import few


def coverage(documents: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, term_ord, term, found_count, possible_tokens, found_tokens): all words of a term count as found if it has a hit.

    Every document has a row for every query, as the report lists them; queries beyond the number that `few` broadcasts are
    paired with documents by a shuffled cartesian product, whose rows are the result's.
    """
    counts = hits.groupBy("doc_id", "term_ord").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.dropDuplicates(["term_ord"]).select("term_ord", "term", F.size(split_words(F.col("term"))).cast("long").alias("possible_tokens"))
    every = documents.select("doc_id").where("doc_id is not null").distinct().crossJoin(few(asked))
    rows = every.join(counts, ["doc_id", "term_ord"], "left")
    found = F.coalesce("n", F.lit(0).cast("long"))
    return rows.select("doc_id", "term_ord", "term", found.alias("found_count"), "possible_tokens", F.when(found > 0, F.col("possible_tokens")).otherwise(F.lit(0).cast("long")).alias("found_tokens"))


def percent(part: str, whole: str) -> F.Column:
    return F.when(F.col(whole) > 0, F.col(part) * 100.0 / F.col(whole)).otherwise(F.lit(0.0))


def run_results(covered: DataFrame, errors: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """(doc_id, total_found, found_tokens, possible_tokens, error, extract_time, total_time) of coverage rows; documents that failed
    have an error, no counts, and a total time of 0.

    `times` is (doc_id, extract_time, total_time) in seconds, as the caller has measured them; without it they are null. Of
    several rows of a document the times are summed.
    """
    rows = covered.groupBy("doc_id").agg(F.sum("found_count").alias("total_found"), F.sum("found_tokens").alias("found_tokens"), F.sum("possible_tokens").alias("possible_tokens")).withColumn("error", F.lit(None).cast("string"))
    if errors is not None:
        rows = rows.unionByName(errors.select("doc_id", "error"), allowMissingColumns=True)
    spent = ("extract_time", "total_time")
    if times is None:
        return rows.withColumns({k: F.lit(None).cast("double") for k in spent})
    both = rows.join(times.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in spent]), "doc_id", "left")
    return both.withColumn("total_time", F.when(F.col("error").isNotNull(), F.lit(0.0)).otherwise(F.col("total_time"))).withColumn("extract_time", F.when(F.col("error").isNull(), F.col("extract_time")))


def _good(c: str) -> F.Column:
    return F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c))), F.lit(0)).cast("long").alias(c)


def global_summary(results: DataFrame) -> DataFrame:
    """One row: tests, errors, hits, tokens found and possible (errors left out), percentage, and seconds of all tests."""
    seconds = F.coalesce(F.sum("total_time"), F.lit(0.0)) if "total_time" in results.columns else F.lit(0.0)
    out = results.agg(F.count(F.lit(1)).alias("tests"), F.count("error").alias("errors"), _good("total_found"), _good("found_tokens"), _good("possible_tokens"), seconds.alias("total_time"))
    return out.withColumn("percent", percent("found_tokens", "possible_tokens"))


def file_summary(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each file: tests, tokens, a percentage unless its first result is an error or nothing was possible, and `first`,
    the least `test_num`, by which files are listed in the order in which they appear. Of results of one number that of
    the least error is first, and one without an error before those."""
    first = F.min(F.struct(F.col("test_num"), F.col("error")))
    out = results.groupBy(key).agg(F.count(F.lit(1)).alias("tests"), _good("found_tokens"), _good("possible_tokens"), first.alias("lead"))
    share = F.when(F.col("lead.error").isNull() & (F.col("possible_tokens") > 0), F.col("found_tokens") * 100.0 / F.col("possible_tokens"))
    return out.select(key, F.col("lead.test_num").alias("first"), "tests", "found_tokens", "possible_tokens", share.alias("percent"))


def totals(summary: DataFrame) -> DataFrame:
    """(passed, total_time) of a global summary: whether no test failed, and the seconds of all."""
    return summary.select((F.col("errors") == 0).alias("passed"), "total_time")


def report_lines(covered: DataFrame) -> DataFrame:
    """(doc_id, line_ord, line): the text report, a line for each term after a heading for each document."""
    whole = covered.groupBy("doc_id").agg(F.sum("found_tokens").alias("f"), F.sum("possible_tokens").alias("p"), F.sort_array(F.collect_list(F.struct("term_ord", "term", "found_count"))).alias("terms"))
    line = lambda order, text: F.struct(order.cast("int").alias("line_ord"), text.alias("line"))
    head = F.array(line(F.lit(-1), F.format_string("Document %d: %d of %d", "doc_id", "f", "p")))
    body = F.transform("terms", lambda t: line(t["term_ord"], F.format_string("  %s: %d", t["term"], t["found_count"])))
    return whole.select("doc_id", F.inline(F.concat(head, body)))
