"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on statistics of labelled texts; every path from a root to a node is a
conjunctive rule. A logistic model over all rules is fitted with a lasso penalty, which leaves a few rules
with weights, and these are compiled into one Spark column expression. Fitting takes at most ``SAMPLE``
labelled rows, those with the smallest hash of the id, and happens on the driver with arrays of that size;
everything else is columns over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold

SAMPLE = 8_000
CUT = 0.7
TREES, DEPTH, BINS, LEAST = 24, 3, 32, 10
#: Lasso penalties that are tried; the one with the best likelihood on a fifth of the sample is used.
PENALTIES = (0.01, 0.003, 0.001)
STATISTICS = (
    "log_chars", "word_chars", "distinct_words", "upper", "digit", "symbol", "mark", "bar", "lines", "distinct_lines", "line_chars", "short_words", "sentence_words", "commonest",
)


def commonest(words: Column) -> Column:
    """How often the commonest word of an array stands in it: the longest run after sorting, in one fold."""

    def step(state: Column, w: Column) -> Column:
        run = F.when(w == state["word"], state["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    zero = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.aggregate(F.sort_array(words), zero, step, lambda s: s["most"])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of the text as columns ``__<name>``; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars, words = F.length("__text"), F.size("__words")

    def share(sign: str) -> Column:
        return F.regexp_count("__text", F.lit(sign)) / (chars + 1)

    df = docs.withColumn("__text", text).withColumn("__words", F.filter(F.split("__text", r"\s+"), lambda w: w != "")).withColumn("__split", F.split("__text", "\n"))
    few = F.size(F.array_distinct("__words"))
    stats = {
        "log_chars": F.log1p(chars.cast("double")),
        "word_chars": chars / (words + 1),
        "distinct_words": few / (words + 1),
        "upper": share(r"\p{Lu}"),
        "digit": share("[0-9]"),
        "symbol": share(r"[^\p{L}\p{N}\s.,]"),
        "mark": share("[!?]"),
        "bar": share("[|]"),
        "lines": F.size("__split") / (words + 1),
        "distinct_lines": F.size(F.array_distinct("__split")) / F.size("__split"),
        "line_chars": F.log1p(chars / F.size("__split")),
        "short_words": F.size(F.filter("__words", lambda w: F.length(w) <= 3)) / (words + 1),
        "sentence_words": words / (F.regexp_count("__text", F.lit("[.!?]")) + 1),
        "commonest": commonest(F.col("__words")) / (words + 1),
    }
    return df.withColumns({f"__{k}": v.cast("double") for k, v in stats.items()}).drop("__text", "__words", "__split")


@dataclass(frozen=True)
class Model:
    """``rules``: (weight, ((statistic, is_greater, threshold), ...))."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]

    def score(self) -> Column:
        """Probability of label 1, from the statistics columns."""
        total = F.lit(float(self.bias))
        for weight, path in self.rules:
            test = F.lit(True)
            for k, greater, at in path:
                column = F.col(f"__{STATISTICS[k]}")
                test &= (column > at) if greater else (column <= at)
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: set, leaf: np.ndarray) -> None:
    """Grows a least-squares tree on ``gradient`` over ``rows``; adds paths and sets the rows' leaf values."""
    g = gradient[rows]
    leaf[rows] = g.mean()
    if depth == 0 or len(rows) < 2 * LEAST:
        return
    best = (1e-9, None, None)
    whole = g.sum() ** 2 / len(g)
    for k, cut in enumerate(edges):
        if not len(cut):
            continue
        b = binned[rows, k]
        n = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
        s = np.cumsum(np.bincount(b, weights=g, minlength=len(cut) + 1))[:-1]
        m = len(g) - n
        ok = (n >= LEAST) & (m >= LEAST)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (g.sum() - s) ** 2 / np.maximum(m, 1) - whole, -1)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], k, j)
    if best[1] is None:
        return
    _, k, j = best
    low = binned[rows, k] <= j
    for side, greater in ((low, False), (~low, True)):
        deeper = (*path, (k, greater, float(edges[k][j])))
        paths.add(deeper)
        _tree(binned, edges, gradient, rows[side], depth - 1, deeper, paths, leaf)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple]:
    """Paths of boosted trees, each fitted to the logistic residuals on half of the rows."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
    rng, margin, paths = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), set()
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        leaf = np.zeros(len(y))
        _tree(binned, edges, residual, rows, DEPTH, (), paths, leaf)
        margin += 2.0 * leaf
    return sorted(paths)


def _holds(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float64)
    for r, path in enumerate(rules):
        for k, greater, at in path:
            out[:, r] *= (x[:, k] > at) if greater else (x[:, k] <= at)
    return out


def _norm(a: np.ndarray, steps: int = 15) -> float:
    """The largest singular value, by power iteration, a little enlarged."""
    v = np.ones(a.shape[1]) / np.sqrt(a.shape[1])
    for _ in range(steps):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) or 1.0
    return 1.05 * float(np.linalg.norm(a @ v))


def lasso(h: np.ndarray, y: np.ndarray, penalty: float, steps: int = 150) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    a = np.hstack([np.ones((len(h), 1)), h])
    rate = 4 * len(y) / _norm(a) ** 2
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        gradient = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / len(y)
        new = v - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / following * (new - w)
        w, t = new, following
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of (statistics, 0/1 labels); with one class or no rows, the constant that fits."""
    if len(y) == 0:
        return Model(0.0, ())
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0, ())
    rules = extract_rules(x, y)
    h = _holds(x, rules)
    # Of rules that hold for the same rows the first stays.
    _, first = np.unique(np.packbits(h.astype(bool), axis=0), axis=1, return_index=True)
    rules, h = [rules[r] for r in np.sort(first)], h[:, np.sort(first)]
    test = np.arange(len(y)) % 5 == 0

    def loss(penalty: float) -> float:
        bias, w = lasso(h[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(bias + h[test] @ w))), 1e-9, 1 - 1e-9)
        return -float(np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)))

    bias, w = lasso(h, y, min(PENALTIES, key=loss))
    return Model(bias, tuple((float(w[r]), rules[r]) for r in np.flatnonzero(np.abs(w) > 1e-6)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows whose fold (crc32 of the id, 4 folds) is not 2.

    Several labels of one id count by majority; null labels are left out.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 4) != 2))
    marks = marks.groupBy(id_col).agg(F.avg("quality").alias("__quality"))
    marks = marks.orderBy(F.xxhash64(id_col), F.col(id_col)).limit(sample)
    rows = with_statistics(docs.select(id_col, text_col).join(F.broadcast(marks), id_col), text_col)
    names = [f"__{k}" for k in STATISTICS]
    # Rows that share an id count as one, with the means of their statistics, so there are ``sample`` at most.
    rows = rows.groupBy(id_col).agg(*[F.avg(c).alias(c) for c in (*names, "__quality")])
    data = rows.toPandas().sort_values([id_col])
    return fit(data[names].to_numpy(float), (data["__quality"].to_numpy(float) >= 0.5).astype(float))


def with_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least ``CUT``).

    Null and empty texts get the score of the statistics of the empty text; ties and repeated rows get
    equal scores; columns named like the two new ones are replaced.
    """
    scored = with_statistics(docs, text_col).withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int")).drop(*[f"__{k}" for k in STATISTICS])


def only_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that the model does not reject (scores of at least ``CUT``).

    Null and empty texts get the score of the statistics of the empty text; repeated rows all stay or all go;
    columns may have any names; an empty table gives an empty result.

    The score passes through a generator, which keeps the condition above it: pushed down to the scan, it
    would work out the statistics anew for each rule that uses them.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    scored = with_statistics(whole).select("row", model.score().alias("score"))
    kept = scored.select("row", F.explode(F.array("score")).alias("score")).where(F.col("score") >= CUT)
    return kept.select("row.*")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. Empty tables give an empty result."""
    model = train(docs, labels, id_col, text_col)
    scored = with_quality(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, (fold(id_col, 4) == 2).alias("held_out"), "score", "predicted")
