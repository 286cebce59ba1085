"""A quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on statistics of labelled texts (each on the errors of
those before it); every path from a root is a conjunctive rule. A lasso
logistic regression weighs the rules and drops most of them, and the rest is
compiled into one Spark column expression over the statistics, so scoring needs
no model on the executors.

Fitting takes a bounded sample of labelled rows (``sample``, drawn by a hash of
the id); scoring takes every whole text. Statistics come from the text alone.

Defined results: null and empty texts have all statistics 0 and are scored like
any other; null labels and labels of unknown ids are not learned from; an id
that several rows carry is learned from each; without labelled rows, or with labels of one kind
only, every score is the smoothed share of label 1 (0.5 if there is none); repeated
rows are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textvec import row_reduce, slices, word_hashes, words

SAMPLE = 20_000
TREES = 40
DEPTH = 3
BINS = 32
PENALTY = 0.002

_GROUPS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "stop": [33, 44, 46, 58, 59, 63],
    "shout": [33],
    "sign": [*range(35, 39), 42, 43, 47, 60, 61, 62, 64, *range(91, 97), *range(123, 127)],
    "bar": [124],
    "wide": range(128, 256),
    "line": [10],
}
STATISTICS = (*(f"{g}_share" for g in _GROUPS), "log_bytes", "log_words", "word_length", "word_spread", "distinct_share", "top_share", "repeat_share", "short_share", "long_share", "line_repeat_share")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATISTICS)))
    size = np.diff(offsets)
    some = np.maximum(1, size)
    for i, codes in enumerate(_GROUPS.values()):
        member = np.zeros(256, dtype=np.int32)
        member[list(codes)] = 1
        out[:, i] = row_reduce(np.add, member[data], offsets, 0) / some
    at = len(_GROUPS)
    _, length, bounds = words(data, offsets)
    hashes, _ = word_hashes(data, offsets)
    n = np.diff(bounds)
    any_n = np.maximum(1, n)
    mean = row_reduce(np.add, length, bounds, 0) / any_n
    out[:, at] = np.log1p(size)
    out[:, at + 1] = np.log1p(n)
    out[:, at + 2] = mean
    out[:, at + 3] = np.sqrt(np.maximum(0, row_reduce(np.add, length * length, bounds, 0) / any_n - mean**2))
    same = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes):
        same[1:] = hashes[1:] == hashes[:-1]
        same[bounds[:-1][n > 0]] = 0
    out[:, at + 6] = row_reduce(np.add, same, bounds, 0) / any_n
    out[:, at + 7] = row_reduce(np.add, (length <= 3).astype(np.int64), bounds, 0) / any_n
    out[:, at + 8] = row_reduce(np.add, (length > 16).astype(np.int64), bounds, 0) / any_n
    raw = data.tobytes()
    for i in range(rows):
        if n[i]:
            _, counts = np.unique(hashes[bounds[i] : bounds[i + 1]], return_counts=True)
            out[i, at + 4] = len(counts) / n[i]
            out[i, at + 5] = counts.max() / n[i]
            lines = raw[offsets[i] : offsets[i + 1]].split(b"\n")
            out[i, at + 9] = 1 - len(set(lines)) / len(lines)
    return out


def _measured(extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(0), 1 << 20):
                found = statistics(data, offsets)
                kept = [batch.column(i + 1).slice(first, end - first) for i in range(len(extra))]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[:, i]) for i in range(found.shape[1])]], names=[*extra, *STATISTICS])

    return run


def with_statistics(docs: DataFrame, text_col: str, carried: dict[str, Column]) -> DataFrame:
    """``carried`` columns and STATISTICS of every row's text."""
    rows = docs.select(F.col(text_col).alias("_text"), *[c.alias(k) for k, c in carried.items()])
    types = dict(rows.dtypes)
    return small_batches(rows).mapInArrow(_measured(list(carried)), ", ".join([*(f"{k} {types[k]}" for k in carried), *(f"{s} double" for s in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, above, cut in self.terms:
            out &= (x[:, i] > cut) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for i, above, cut in self.terms:
            out = out & ((F.col(STATISTICS[i]) > F.lit(cut)) if above else (F.col(STATISTICS[i]) <= F.lit(cut)))
        return out


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-total))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, path: tuple, found: list[tuple[tuple, np.ndarray, float]]) -> None:
    mean = float(target[rows].mean()) if len(rows) else 0.0
    if path:
        found.append((path, rows, mean))
    if depth == 0 or len(rows) < 20:
        return
    best, gain = None, 1e-9
    for f in features:
        n = np.bincount(binned[rows, f], minlength=BINS)
        s = np.bincount(binned[rows, f], weights=target[rows], minlength=BINS)
        left_n, left_s = n.cumsum()[:-1], s.cumsum()[:-1]
        right_n, right_s = len(rows) - left_n, s.sum() - left_s
        usable = (left_n >= 5) & (right_n >= 5)
        if usable.any():
            value = np.where(usable, left_s**2 / np.maximum(1, left_n) + right_s**2 / np.maximum(1, right_n), -1.0) - s.sum() ** 2 / len(rows)
            at = int(value.argmax())
            if at < len(cuts[f]) and value[at] > gain:
                best, gain = (int(f), at), float(value[at])
    if best:
        f, at = best
        low = binned[rows, f] <= at
        for above, part in ((False, rows[low]), (True, rows[~low])):
            _grow(binned, cuts, target, part, features, depth - 1, (*path, (f, above, float(cuts[f][at]))), found)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[Rule]:
    """Distinct paths of boosted trees, each on half the rows and two thirds of the statistics."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    raw = np.full(len(x), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        rows = np.sort(random.permutation(len(x))[: max(1, len(x) // 2)])
        features = np.sort(random.permutation(x.shape[1])[: max(1, 2 * x.shape[1] // 3)])
        found: list = []
        _grow(binned, cuts, y - p, rows, features, depth, (), found)
        for path, _, mean in found:
            rules[Rule(tuple(sorted(path)))] = None
            if len(path) == depth:
                raw += 2.0 * mean * Rule(path).holds(x)
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient steps."""
    n, k = z.shape
    step = 4.0 / (np.linalg.norm(z.T @ z / n, 2) + 1)
    w, b = np.zeros(k), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - step * (z.T @ g) / n
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        new_b = vb - step * g.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return float(b), w


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(math.log(share / (1 - share)))
    rules = tree_rules(x, y)
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    if not rules:
        return RuleModel(math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    bias, weights = lasso_logistic(z, y, penalty)
    return RuleModel(bias, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> RuleModel:
    """A model of at most ``sample`` labelled rows of ``docs``."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).where("_id is not null and _label is not null")
    n = known.count()
    drawn = known
    if n > sample:
        drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(min(1.0, 1.5 * sample / n) * (1 << 30)))
    # at most `sample` rows of two numbers: a bounded broadcast
    drawn = F.broadcast(drawn.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_raw")).join(drawn, F.col("_doc") == F.col("_id"), "inner")
    # repeated ids can make more rows than labels; which of them are taken depends on their values alone
    found = with_statistics(rows, "_raw", {"label": F.col("_label")})
    found = found.orderBy(F.xxhash64(*STATISTICS), *STATISTICS, "label").limit(sample).toArrow()
    x = np.stack([found[s].to_numpy() for s in STATISTICS], axis=1) if found.num_rows else np.zeros((0, len(STATISTICS)))
    y = found["label"].to_numpy()
    order = np.lexsort([*x.T, y])
    return fit_rules(x[order], y[order])


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted, and the statistics."""
    rows = with_statistics(docs, text_col, {"doc_id": F.col(id_col)})
    return rows.withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "score", "predicted", *STATISTICS)
