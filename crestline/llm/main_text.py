"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks in order; each has features of its ancestors'
elements and attribute hints, of its own element and of its text. The field
(two labels, weights for features, neighbours, first and last block) is trained
on labelled pages by its exact gradient and decoded by Viterbi; blocks labelled
main text are joined by one space.

Defined results: null and empty pages, and pages without main text, give an
empty text; broken markup never fails (an unclosed comment, script,
style, title or textarea runs to the end; other elements lose no text); repeated rows and null ids or addresses are passed through;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .page_blocks import Block, blocks
from .page_training import labelled_pages

TRAINING_PAGES = 400
STEPS = 150
PENALTY = 1e-3


def _level(value: float, cuts: tuple[float, ...]) -> int:
    return sum(value >= c for c in cuts)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for i, b in enumerate(page):
        n = len(b.text)
        names = ["bias", f"tag:{b.tag}", f"length:{_level(n, (10, 25, 60, 150, 400))}", f"links:{_level(b.links, (0.01, 0.3, 0.7))}", *b.around]
        names.append(f"ends:{b.text[-1] in '.!?…。'}")
        if b.text[0] in "©®":
            names.append("mark")
        inside = "in" if "in:article" in b.around or "in:main" in b.around else "out"
        names.append(f"{inside}:{b.tag}")
        names.append(f"{inside}:links:{_level(b.links, (0.01, 0.3, 0.7))}")
        if i == 0:
            names.append("first")
        out.append(names)
    return out


@dataclass
class Field:
    """Weights: of each feature for both labels, of label pairs, of the first and last label."""

    weights: dict[str, tuple[float, float]]
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        none = (0.0, 0.0)
        (p00, p01), (p10, p11) = self.pairs.tolist()
        back: list[tuple[int, int]] = []
        s0, s1 = self.first.tolist()
        for i, names in enumerate(features(page)):
            e0 = e1 = 0.0
            for f in names:
                a, b = self.weights.get(f, none)
                e0 += a
                e1 += b
            if i:
                b0, b1 = int(s1 + p10 > s0 + p00), int(s1 + p11 > s0 + p01)
                s0, s1 = (s1 + p10 if b0 else s0 + p00), (s1 + p11 if b1 else s0 + p01)
                back.append((b0, b1))
            s0 += e0
            s1 += e1
        at = int(s1 + self.last[1] > s0 + self.last[0])
        labels = [at]
        for step in reversed(back):
            at = step[at]
            labels.append(at)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam on the exact gradient (forward and backward sums over all pages at once)."""
    names: dict[str, int] = {}
    longest = max(len(p) for p, _ in pages)
    rows, columns = [], []
    y = np.zeros((len(pages), longest), dtype=np.int64)
    size = np.array([len(p) for p, _ in pages])
    for i, (page, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
        for j, held in enumerate(features(page)):
            for f in dict.fromkeys(held):
                rows.append(i * longest + j)
                columns.append(names.setdefault(f, len(names)))
    rows, columns = np.array(rows), np.array(columns)
    k = len(names)
    real = np.arange(longest)[None, :] < size[:, None]
    theta = np.zeros(2 * k + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = real[:, 1:]
    ends = (np.arange(len(pages)), size - 1)
    for step in range(1, steps + 1):
        w, pairs, first, last = theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 : 2 * k + 6], theta[2 * k + 6 :]
        e = np.stack([np.bincount(rows, weights=w[columns, c], minlength=y.size) for c in (0, 1)], axis=1).reshape(len(pages), longest, 2)
        e[:, 0] += first
        e[ends] += last
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = e[:, t] + np.logaddexp(alpha[:, t - 1, :1] + pairs[0], alpha[:, t - 1, 1:] + pairs[1])
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            right = e[:, t + 1] + beta[:, t + 1]
            new = np.stack([np.logaddexp(pairs[c, 0] + right[:, 0], pairs[c, 1] + right[:, 1]) for c in (0, 1)], axis=1)
            beta[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        q = np.exp(alpha[:, :-1, :, None] + pairs[None, None] + (e + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        error = p.copy()
        error[np.arange(len(pages))[:, None], np.arange(longest)[None, :], y] -= real
        flat = error.reshape(-1, 2)
        grad = np.zeros_like(theta)
        grad[: 2 * k] = np.stack([np.bincount(columns, weights=flat[rows, c], minlength=k) for c in (0, 1)], axis=1).ravel()
        seen = np.bincount((y[:, :-1] * 2 + y[:, 1:])[both], minlength=4)
        grad[2 * k : 2 * k + 4] = q.sum(axis=(0, 1)).ravel() - seen
        grad[2 * k + 4 : 2 * k + 6] = error[:, 0].sum(axis=0)
        grad[2 * k + 6 :] = error[ends].sum(axis=0)
        grad = grad / real.sum() + penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = theta[: 2 * k].reshape(k, 2)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 : 2 * k + 6], theta[2 * k + 6 :])


def trained(pages: int = TRAINING_PAGES, seed: int = 1) -> Field:
    """The field of the seeded training pages."""
    return train(labelled_pages(pages, seed))


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, y in zip(found, model.decode(found), strict=True) if y)


def _extractor(model: Field, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x.as_py(), model) for x in batch.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    types = dict(rows.dtypes)
    return small_batches(rows).mapInArrow(_extractor(model or trained(), ["page_id", "url"]), f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
