"""Language-model scoring with Brown classes: class transitions times word emissions.

Training, all counts over all training texts:

1. Texts are dealt to blocks of about ``block_bytes`` as they come, and written.
   Every block lists its words, and these are summed up: every word's count.
2. Exchange clustering moves the ``core`` most frequent words between classes as
   long as the likelihood of the class bigrams rises.
3. Every other word makes one exchange step by its neighbours in the whole
   corpus: what stands before and after it, by class, is summed up by word, and
   the word takes the class that suits these sums best.
4. Every block meets the counts and classes of just its own words, once; what is
   written of a text are the class and the count of each token.
5. The class bigrams of all training tokens are summed up from these, and the
   texts are scored.

Counts are whole numbers and likelihoods of classes are summed in fixed point,
so neither the partitions of the table nor the size of the blocks changes a score.

P(word | class before) = mix * P(class | class before) * count / count of class
+ (1 - mix) * (count + 1) / (N + V + 1), which sums to 1 over the known words
and one unknown; an unknown word counts as a class of its own before others.
Unless given, ``mix`` is what words seen once leave (the Good-Turing estimate of
known words).

The vocabulary is never broadcast or collected: what a task holds is the
vocabulary of a block. Words are known by 64-bit hashes.

Defined results: null and empty texts are one token, the end; with nothing to
learn from, every word is unknown; repeated rows are scored one by one and
count as often in training as they occur; a null id counts as the empty text
when rows are dealt to the folds; words that tie for a place among the core go
by their hash, and classes that suit a word equally by their number; a very long
text is a block of its own; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, small_batches, stored
from .textvec import slices, word_hashes

CORE = 1024
CLASSES = 32
SWEEPS = 6
BLOCK_BYTES = 20 << 20
#: Occurrences that are summed up before they leave a task.
_HELD = 1 << 21
#: Steps of the fixed point in which likelihoods are summed.
_UNIT = 1 << 20


def _dealt(block_bytes: int):
    """(doc_id, text, learn) with a block in front: a task's rows in turn, as many as make ``block_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = seen + np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[seen], ends[:-1]]) if len(ends) else ends
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([pa.array((task << 24) + starts // block_bytes), *batch.columns], names=["block", "doc_id", "text", "learn"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, text, learn) to (block, word, n): a block's words with their training counts; a block that lies in several tasks is listed in parts."""

    def out(block: int, lots: list[np.ndarray], others: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(lots) if lots else np.zeros(0, np.uint64), return_counts=True)
        rest = np.setdiff1d(np.concatenate(others), words) if others else words[:0]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(words) + len(rest), block, dtype=np.int64)), pa.array(np.concatenate([words, rest]).view(np.int64)), pa.array(np.concatenate([n.astype(np.int64), np.zeros(len(rest), np.int64)]))], names=["block", "word", "n"]
        )

    at, held, lots, others = None, 0, [], []
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        learn = batch.column(2).to_numpy(zero_copy_only=False)
        for first, end, data, offsets in slices(batch.column(1)):
            hashes, bounds = word_hashes(data, offsets)
            edges = [first, *(first + 1 + np.flatnonzero(np.diff(blocks[first:end]))).tolist(), end]
            for a, b in zip(edges, edges[1:], strict=False):
                if blocks[a] != at or held >= _HELD:
                    if held:
                        yield out(at, lots, others)
                    at, held, lots, others = int(blocks[a]), 0, [], []
                part = hashes[bounds[a - first] : bounds[b - first]]
                use = np.repeat(learn[a:b], np.diff(bounds[a - first : b - first + 1]))
                lots.append(part[use])
                others.append(np.unique(part[~use]))
                held += len(part)
    if held:
        yield out(at, lots, others)


class Lookup:
    """Number of a hash in a sorted list, or a default."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def __call__(self, hashes: np.ndarray, default: int) -> np.ndarray:
        if len(self.sorted) == 0:
            return np.full(len(hashes), default, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], default)


def _bounded(symbols: np.ndarray, bounds: np.ndarray, edge: int) -> np.ndarray:
    """Each text's symbols with ``edge`` before the first text and after every text: neighbours are adjacent."""
    n = len(bounds) - 1
    out = np.full(len(symbols) + n + 1, edge, dtype=symbols.dtype)
    out[1 + np.arange(len(symbols)) + np.repeat(np.arange(n), np.diff(bounds))] = symbols
    return out


def _neighbours(core: np.ndarray):
    """Counts of adjacent symbols: core words, others (``len(core)``), the edge of a text (``len(core) + 1``)."""
    size = len(core) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Lookup(core)
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes, bounds = word_hashes(data, offsets)
                s = _bounded(number(hashes, size - 2), bounds, size - 1)
                total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(table: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol; the last two symbols (others, edge) keep classes of their own, ``classes`` and ``classes + 1``.

    ``table[v, w]`` counts v before w; words come most frequent first. Each
    word moves to the class that raises the likelihood of the class bigrams
    most, in turn, until a sweep moves none.
    """
    words = len(table) - 2
    of = np.concatenate([np.arange(words) % classes, [classes, classes + 1]])
    k = classes + 2
    member = np.zeros((len(table), k))
    member[np.arange(len(table)), of] = 1
    b = member.T @ table @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own = table[w, w]
            after = table[w] @ member
            before = member.T @ table[:, w]
            a = of[w]
            after[a] -= own
            before[a] -= own
            b[a] -= after
            b[:, a] -= before
            b[a, a] -= own
            rows, columns = b.sum(axis=1), b.sum(axis=0)
            gain = (_xlogx(b + after[None, :]) - _xlogx(b)).sum(axis=1) + (_xlogx(b + before[:, None]) - _xlogx(b)).sum(axis=0)
            d = np.diagonal(b)
            gain += _xlogx(d + after + before + own) - _xlogx(d + after) - _xlogx(d + before) + _xlogx(d)
            gain -= _xlogx(rows + after.sum() + own) - _xlogx(rows) + _xlogx(columns + before.sum() + own) - _xlogx(columns)
            to = int(gain[:classes].argmax())
            if gain[to] <= gain[a] + 1e-9:
                to = a
            moved += to != a
            member[w, a], member[w, to] = 0, 1
            of[w] = to
            b[to] += after
            b[:, to] += before
            b[to, to] += own
        if not moved:
            break
    return of


@dataclass
class Core:
    """Core words, their classes, and what a word's neighbours say for each class."""

    words: np.ndarray
    classes: np.ndarray  # of each core word, then of others and the edge
    left: np.ndarray  # log P(class | class before), a row for each class before
    right: np.ndarray  # log P(class after | class), a row for each class after
    n_classes: int


def fit_core(training: DataFrame, words: np.ndarray, classes: int) -> Core:
    """Classes of the core ``words`` (most frequent first) by their neighbours in ``training`` (one column of text)."""
    size = len(words) + 2
    pairs = small_batches(training).mapInArrow(_neighbours(words), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    table = table.reshape(size, size)
    of = exchange(table, classes)
    member = np.zeros((size, classes + 2))
    member[np.arange(size), of] = 1
    b = member.T @ table @ member + 0.5
    left = np.log(b[:, :classes] / b[:, :classes].sum(axis=1, keepdims=True))
    right = np.log(b[:classes] / b[:classes].sum(axis=1, keepdims=True)).T
    return Core(words, of, np.round(left * _UNIT).astype(np.int64), np.round(right * _UNIT).astype(np.int64), classes)


def _around(core: Core):
    """Training texts to (word, place, n): how often a word that isn't in the core stands between two classes (place: both in one number)."""
    k = core.n_classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Lookup(core.words)
        class_of = core.classes.astype(np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> pa.RecordBatch:
            words, places = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.lexsort([places, words])
            words, places = words[order], places[order]
            starts = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (places[1:] != places[:-1])]))
            counts = np.diff(np.append(starts, len(words)))
            return pa.RecordBatch.from_arrays([pa.array(words[starts].view(np.int64)), pa.array(places[starts]), pa.array(counts.astype(np.int32))], names=["word", "place", "n"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes, bounds = word_hashes(data, offsets)
                which = number(hashes, len(core.words))
                s = _bounded(class_of[which], bounds, k - 1)
                at = 1 + np.arange(len(hashes)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                rare = which == len(core.words)
                held.append((hashes[rare], (s[at - 1] * k + s[at + 1])[rare].astype(np.int32)))
                n += int(rare.sum())
                if n >= _HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def _suited(core: Core):
    """(word, place, n) in the order of words to (word, class): the class that a word's neighbours suit best."""
    k = core.n_classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None  # a word may go on in the next batch
        for batch in batches:
            words, places, n = (batch.column(i).to_numpy() for i in range(3))
            for a in range(0, len(words), 100_000):
                w, p, c = words[a : a + 100_000], places[a : a + 100_000], n[a : a + 100_000].astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                sums = np.add.reduceat((core.left[p // k] + core.right[p % k]) * c[:, None], starts, axis=0)
                found = w[starts]
                if last is not None:
                    if found[0] == last:
                        sums[0] += total
                    else:
                        found, sums = np.concatenate([[last], found]), np.concatenate([total[None], sums])
                last, total = int(found[-1]), sums[-1]
                if len(found) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(found[:-1]), pa.array(sums[:-1].argmax(axis=1).astype(np.int32))], names=["word", "class"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([int(total.argmax())], pa.int32())], names=["word", "class"])

    return run


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each text's part of an array of numbers as a binary value."""
    ends = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, counts, bounds) of a batch of encoded texts."""
    classes = np.frombuffer(b"".join(batch["classes"].to_pylist()), dtype=np.uint8)
    counts = np.frombuffer(b"".join(batch["counts"].to_pylist()), dtype=np.int64)
    lengths = pa.compute.binary_length(batch["classes"]).to_numpy(zero_copy_only=False)
    return classes, counts, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _encoded(k: int):
    """A block's texts and its words to (doc_id, learn, classes, counts): each token's class, ``k`` for an unknown word, and training count."""

    def run(key: tuple, rows: pa.Table, words: pa.Table) -> pa.Table:
        known = words["word"].to_numpy().view(np.uint64)
        number = Lookup(known)
        # one more word at the end: unknown
        of = np.concatenate([words["class"].to_numpy(), [k]]).astype(np.uint8)
        count = np.concatenate([words["n"].to_numpy(), [0]]).astype(np.int64)
        out = {"classes": [], "counts": []}
        for _, _, data, offsets in slices(rows["text"]):
            hashes, bounds = word_hashes(data, offsets)
            w = number(hashes, len(known))
            out["classes"].append(_packed(of[w], bounds))
            out["counts"].append(_packed(count[w], bounds))
        return pa.table({"doc_id": rows["doc_id"], "learn": rows["learn"], **{c: pa.chunked_array(v, pa.binary()) for c, v in out.items()}})

    return run


def _class_bigrams(k: int):
    """Encoded training texts to (pair, n): counts of class bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 2) ** 2, dtype=np.int64)
        for batch in batches:
            classes, _, bounds = _unpacked(batch)
            s = _bounded(classes.astype(np.int32), bounds, k + 1)
            total += np.bincount(s[:-1] * np.int32(k + 2) + s[1:], minlength=(k + 2) ** 2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return run


@dataclass
class ClassModel:
    n_tokens: int
    n_words: int
    n_texts: int
    transitions: np.ndarray  # P(class | class before), edge last; others' row is the mean
    class_counts: np.ndarray
    mix: float


def _scorer(model: ClassModel):
    k = len(model.class_counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uniform = model.n_tokens + model.n_words + 1
        end = (model.n_texts + 1) / uniform
        of_class = np.concatenate([np.maximum(1, model.class_counts), [1.0]])
        for batch in batches:
            classes, counts, bounds = _unpacked(batch)
            n = np.diff(bounds)
            base = (counts + 1) / uniform
            seen = np.concatenate([[0], np.cumsum(counts > 0)])
            s = _bounded(classes.astype(np.int64), bounds, k + 1)
            emission = np.ones(len(s))
            floor = np.full(len(s), end)
            place = 1 + np.arange(len(classes)) + np.repeat(np.arange(len(n)), n)
            emission[place] = counts / of_class[classes]
            floor[place] = base
            p = np.log10(model.mix * model.transitions[s[:-1], s[1:]] * emission[1:] + (1 - model.mix) * floor[1:])
            ends = np.cumsum(n + 1)
            base_score = np.add.reduceat(np.append(np.log10(base), 0.0), np.minimum(bounds[:-1], len(classes))) * (n > 0) + np.log10(end)
            score = np.add.reduceat(p, np.concatenate([[0], ends[:-1]])) if len(n) else p
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n + 1), pa.array(seen[bounds[1:]] - seen[bounds[:-1]] + (model.n_texts > 0)), pa.array(base_score), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    return run


def score_texts(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", *, core: int = CORE, classes: int = CLASSES, mix: float | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score; the model learns where ``learn`` holds."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    types = dict(named.dtypes)
    # written, so that a row's block is the same in every pass
    blocked = stored(small_batches(named).mapInArrow(_dealt(block_bytes), f"block long, doc_id {types['doc_id']}, text string, learn boolean"), "lm-texts")
    in_blocks = stored(small_batches(blocked.select("block", "text", "learn")).mapInArrow(_listed, "block long, word long, n long"), "lm-lists")
    counts = stored(in_blocks.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    n_texts = blocked.where("learn").count()
    n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.orderBy(F.desc("n"), "word").limit(core).toArrow()
    training = blocked.where("learn").select("text")
    fitted = fit_core(training, frequent["word"].to_numpy().view(np.uint64), classes)

    around = training.mapInArrow(_around(fitted), "word long, place int, n int")
    suited = around.repartition("word").sortWithinPartitions("word", "place").mapInArrow(_suited(fitted), "word long, class int")
    # at most ``core`` rows
    known = docs.sparkSession.createDataFrame(pa.table({"word": frequent["word"], "class": pa.array(fitted.classes[: frequent.num_rows].astype(np.int32))}), "word long, class int")
    words = stored(counts.join(suited.unionByName(known), "word"), "lm-classes")
    here = stored(joined_hot(in_blocks.select("block", "word"), words, ["word"], "inner"), "lm-words")
    summed = words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    class_counts = np.zeros(classes)
    pairs = np.zeros((classes + 2, classes + 2))
    distinct, once = 0, 0
    for r in summed:
        class_counts[r["class"]] = r["n"]
        distinct += r["distinct"]
        once += r["once"]
    # texts meet their words once; classes and counts of their tokens serve both passes that follow
    met = blocked.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(_encoded(classes), f"doc_id {types['doc_id']}, learn boolean, classes binary, counts binary")
    encoded = stored(met, "lm-encoded")
    bigrams = small_batches(encoded.where("learn").select("classes", "counts")).mapInArrow(_class_bigrams(classes), "pair long, n long")
    for r in bigrams.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[divmod(r["pair"], classes + 2)] = r["n"]
    pairs[classes] = pairs.sum(axis=0)
    pairs[:, [*np.flatnonzero(class_counts > 0), classes + 1]] += 0.1
    pairs[:, classes] = 0
    if mix is None:  # words seen once tell how often a new one comes
        mix = min(0.99, max(0.5, 1 - once / max(1, n_words)))
    model = ClassModel(n_words + n_texts, distinct + (n_texts > 0), n_texts, pairs / pairs.sum(axis=1, keepdims=True), class_counts, mix)
    scored = encoded.select("doc_id", "classes", "counts").mapInArrow(_scorer(model), f"doc_id {types['doc_id']}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
