"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, compiled into Spark columns.

Shallow boosted trees over the statistics of labelled documents propose rules: every path from the root to a node is a
conjunction of threshold tests. A lasso logistic regression over the rules' truth values weights them and leaves most
out. What remains is one Column expression, so that scoring stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows, chosen by a hash of doc_id, are fitted on.
FIT_ROWS = 10_000
TREES, DEPTH, BINS, SHRINK = 40, 3, 48, 0.2
PENALTY = 0.002
CUTOFF = 0.5
STATISTICS = ("log_chars", "log_words", "mean_word", "distinct_words", "root_distinct", "distinct_lines", "line_words", "upper", "symbols", "digits", "bars", "bangs", "spread")
Rule = tuple[tuple[str, float, bool], ...]


def statistics(docs: DataFrame, text: Column, name: str = "stat") -> DataFrame:
    """`docs` with a struct column `name` of STATISTICS of `text` (doubles, never null; null counts as empty)."""
    one = lambda c: F.greatest(c, F.lit(1))
    raw = docs.withColumn(name, F.coalesce(text, F.lit("")))
    t = F.col(name)
    parts = F.struct(
        F.length(t).alias("n"),
        F.array_remove(F.split(t, r"[ \t\r\n]+"), "").alias("words"),
        F.split(t, "\n").alias("lines"),
        F.length(F.regexp_replace(t, r"\p{Lu}+", "")).alias("not_upper"),
        F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]+", "")).alias("not_symbol"),
        F.length(F.regexp_replace(t, r"\p{N}+", "")).alias("not_digit"),
        F.length(F.replace(t, F.lit("|"), F.lit(""))).alias("not_bar"),
        F.length(F.replace(t, F.lit("!"), F.lit(""))).alias("not_bang"),
    )
    p = raw.withColumn(name, parts)
    c = lambda k: F.col(f"{name}.{k}")
    counted = p.withColumn(name, F.struct(*[c(k).alias(k) for k in ("n", "not_upper", "not_symbol", "not_digit", "not_bar", "not_bang")], F.size(c("words")).alias("nw"), F.size(F.array_distinct(c("words"))).alias("dw"), F.size(c("lines")).alias("nl"), F.size(F.array_distinct(c("lines"))).alias("dl")))
    n, nw = one(c("n")), one(c("nw"))
    values = {
        "log_chars": F.log1p(c("n")),
        "log_words": F.log1p(c("nw")),
        "mean_word": c("n") / nw,
        "distinct_words": c("dw") / nw,
        "root_distinct": c("dw") / F.sqrt(nw),
        "distinct_lines": c("dl") / one(c("nl")),
        "line_words": F.log1p(c("nw") / one(c("nl"))),
        "upper": (c("n") - c("not_upper")) / n,
        "symbols": (c("n") - c("not_symbol")) / n,
        "digits": (c("n") - c("not_digit")) / n,
        "bars": (c("n") - c("not_bar")) / nw,
        "bangs": (c("n") - c("not_bang")) / nw,
        "spread": F.log1p(c("dw")) / F.greatest(F.log1p(c("nw")), F.lit(1.0)),
    }
    return counted.withColumn(name, F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS]))


@dataclass(frozen=True)
class RuleModel:
    """`bias` and weighted rules; a rule is a conjunction of (statistic, threshold, whether above it)."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stat: str = "stat") -> Column:
        """The probability of good quality as a Column over the struct `stat`."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            test = F.lit(True)
            for name, cut, above in rule:
                at = F.col(f"{stat}.{name}")
                test = test & ((at > cut) if above else (at <= cut))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same of a matrix of STATISTICS."""
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for name, cut, above in rule:
        at = x[:, STATISTICS.index(name)]
        ok &= (at > cut) if above else (at <= cut)
    return ok


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The distinct paths of boosted regression trees (logistic loss; each tree sees a random half of the rows)."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    raw, found = np.zeros(len(y)), {}

    def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
        if depth < DEPTH and len(rows) >= 20:
            g, best = residual[rows], (1e-9, -1, -1)
            for j, cut in enumerate(cuts):
                if len(cut):
                    b = binned[rows, j]
                    n, s = np.bincount(b, minlength=len(cut) + 1).cumsum()[:-1], np.bincount(b, g, minlength=len(cut) + 1).cumsum()[:-1]
                    m, total = len(rows), g.sum()
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where((n >= 5) & (m - n >= 5), s**2 / n + (total - s) ** 2 / (m - n) - total**2 / m, -1.0)
                    if gain.max() > best[0]:
                        best = float(gain.max()), j, int(gain.argmax())
            gain, j, k = best
            if j >= 0:
                low = binned[rows, j] <= k
                for part, above in ((rows[low], False), (rows[~low], True)):
                    grow(part, (*path, (STATISTICS[j], float(cuts[j][k]), above)), depth + 1)
                found.setdefault(tuple(sorted(path)), None) if path else None
                return
        if path:
            found.setdefault(tuple(sorted(path)), None)
        p = 1 / (1 + np.exp(-raw[rows]))
        leaves.append((path, residual[rows].sum() / max((p * (1 - p)).sum(), 1e-3)))

    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-raw))
        leaves: list[tuple[Rule, float]] = []
        grow(np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)]), (), 0)
        for path, value in leaves:
            raw += SHRINK * np.clip(value, -4, 4) * holds(path, x)
    return list(found)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and sparse weights that minimise mean logistic loss + penalty * |weights|_1, by accelerated proximal steps."""
    n, k = z.shape
    full = np.hstack([np.ones((n, 1), np.float32), z.astype(np.float32)])
    size = np.linalg.norm(full, 2) if k else np.sqrt(n)
    rate = 4 * n / max(size**2, 1e-9)
    w = v = np.zeros(k + 1, np.float32)
    t = 1.0
    for _ in range(steps):
        g = full.T @ (1 / (1 + np.exp(-(full @ v))) - y).astype(np.float32) / n
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:].astype(np.float64)


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
    """The rule ensemble of statistics `x` and labels `y` (0 or 1).

    Without labels every document scores 0.5, and with labels of one class as that class.
    """
    if not len(y):
        return RuleModel(0.0, ())
    if y.min() == y.max():
        return RuleModel(4.0 if y[0] else -4.0, ())
    rules = tree_rules(x, y)
    truth = np.stack([holds(r, x) for r in rules], axis=1) if rules else np.zeros((len(y), 0))
    bias, weight = lasso_logistic(truth, y, penalty)
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(rules, weight) if abs(w) > 1e-6))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most `rows` labelled documents, those of the least hash of doc_id.

    A document has one row: of several labels the greatest counts, of several texts of one doc_id the least. Null labels,
    doc_ids and texts are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(some), "doc_id")  # no larger than `rows`
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleModel:
    """The rule ensemble of a bounded sample of labelled documents, which `labelled` chooses."""
    known = statistics(labelled(docs, labels, "quality", rows), F.col("text")).select("label", "stat.*")
    table = known.orderBy(*known.columns).toPandas().to_numpy(np.float64)
    return fit_rules(table[:, 1:], (table[:, 0] > 0.5).astype(np.float64))


def scored(docs: DataFrame, model: RuleModel, cutoff: float = CUTOFF) -> DataFrame:
    """(row, score, keep): the struct `row` has all columns of `docs`.

    A null or blank text scores 0 and isn't kept; repeated rows score alike; texts of any length are looked at as a whole. An
    empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    blank = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"\S")
    rows = statistics(rows, F.col("row.text"))
    score = F.when(blank, F.lit(0.0)).otherwise(model.column())
    # A generator keeps a later filter on the score from being moved below it, with all statistics once more for each rule.
    rows = rows.select("row", F.explode(F.array(score)).alias("score"))
    return rows.select("row", "score", (F.col("score") >= cutoff).alias("keep"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that the classifier rejects; columns stay as they are, also any of clashing names."""
    return scored(docs, fit(docs, labels)).where("keep").select("row.*")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its quality score and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("row.doc_id", "score", "keep")
