"""Language identification with error-correcting output codes.

Every learned language has a codeword; each bit of it is predicted by a binary
classifier over hashed byte trigrams (ASCII lower-cased, runs of other signs as
separators). A classifier is a smoothed log-odds table of the two sides that
the bit splits the languages into, each language counting alike, learned from
all training rows in one counting pass. Decoding takes the language with the
least loss, where each bit's loss is weighted by how well its classifier does
on that language (measured on about ``sample`` training rows), and flags a
text as ambiguous if the runner-up is close.

The counts that reach the driver are ``2 ** BUCKET_BITS`` numbers for each
learned language, whatever the size of the corpus.

Defined results: null texts and texts without a letter are ``und`` with score
0, and so is every text if nothing could be learned; a null label is not
learned from; with one language everything with a letter is that language;
rows that repeat are predicted one by one; a null id counts as the empty text
when rows are dealt to the folds; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .textvec import slices

BUCKET_BITS = 13
SAMPLE = 2000
CLOSE = 0.1
UNKNOWN = "und"
_SLICE = 1 << 19

# 0: a separator; 1-26: a letter; from 27: the low six bits of a byte above ASCII
_CODE = np.zeros(256, dtype=np.uint32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27 + (np.arange(128, 256) & 63)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that ends at each byte (texts begin after two separators); the last bucket if all three are separators."""
    here = _CODE[data]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    one = np.concatenate([[0], here[:-1]]).astype(np.uint32) if len(here) else here
    one[starts] = 0
    two = np.concatenate([[0], one[:-1]]).astype(np.uint32) if len(here) else here
    two[starts] = 0
    gram = (two * np.uint32(91) + one) * np.uint32(91) + here
    with np.errstate(over="ignore"):
        bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    bucket[gram == 0] = 1 << BUCKET_BITS
    return bucket


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits for up to six, else the seeded random code with the widest least distance."""
    if languages < 2:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=languages) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=np.int8).T
    bits = int(np.ceil(10 * np.log2(languages)))
    random = np.random.default_rng(seed)
    tried = []
    for _ in range(200):
        code = random.choice(np.array([1, -1], dtype=np.int8), size=(languages, bits))
        usable = (code.min(axis=0) == -1).all() and (code.max(axis=0) == 1).all()
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(languages, dtype=int)
        tried.append((apart.min() if usable else -1, code))
    return max(tried, key=lambda t: t[0])[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit
    tables: np.ndarray  # bucket x bit; the last row is 0
    scale: np.ndarray  # of each bit's mean log-odds
    trust: np.ndarray  # language x bit

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-odds of each text for each bit, 0 for texts without trigrams."""
        out = np.zeros((len(offsets) - 1, self.code.shape[1]))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            buckets = trigrams(data, offsets)
            found = np.add.reduceat((buckets < 1 << BUCKET_BITS).astype(np.int64), offsets[:-1][full])
            for bit in range(out.shape[1]):
                out[full, bit] = np.add.reduceat(self.tables[buckets, bit], offsets[:-1][full], dtype=np.float64) / np.maximum(1, found)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, runner-up's score) by weighted logistic loss."""
        scaled = margins / self.scale
        loss = np.zeros((len(margins), len(self.languages)))
        for i in range(len(self.languages)):
            loss[:, i] = (np.logaddexp(0, -4 * self.code[i] * scaled) * self.trust[i]).sum(axis=1)
        odds = np.exp(loss.min(axis=1, keepdims=True) - loss)
        odds /= odds.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        top = odds[np.arange(len(best)), best]
        odds[np.arange(len(best)), best] = -1
        return best, top, np.maximum(0, odds.max(axis=1)) if odds.shape[1] > 1 else np.zeros(len(best))


def _counter(languages: list[str]):
    """(text, lang) to (language number, bucket, trigrams, rows): one row for each pair and task; the extra bucket counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BUCKET_BITS) + 1
        total = np.zeros((len(languages), size), dtype=np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            which = np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for first, end, data, offsets in slices(batch.column(0), _SLICE):
                own = np.repeat(which[first:end], np.diff(offsets))
                total += np.bincount(own * size + trigrams(data, offsets), minlength=total.size).reshape(total.shape)
        total[:, -1] = 0
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["language", "bucket", "n"])

    return run


def _scorer(model: LanguageModel, text_at: int, carried: dict[int, str]):
    """Rows with a text and, last, whether it has a letter, to the ``carried`` columns, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            for first, end, data, offsets in slices(batch.column(text_at), _SLICE):
                best, top, second = model.decode(model.margins(data, offsets))
                has = letters[first:end]
                found = [pa.array(np.where(has, names[best], UNKNOWN), pa.string()), pa.array(np.where(has, top, 0.0)), pa.array(np.where(has, top - second < CLOSE, True))]
                kept = [batch.column(i).slice(first, end - first) for i in carried]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=[*carried.values(), "lang_pred", "score", "ambiguous"])

    return run


def _margin_rows(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(0), _SLICE):
                m = model.margins(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first), pa.array(list(m), pa.list_(pa.float64()))], names=["lang", "margins"])

    return run


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """A model of all rows of ``training`` with a label, or None without any."""
    rows = training.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull())
    listed = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(listed)
    if not languages:
        return None
    counted = small_batches(rows).mapInArrow(_counter(languages), "language long, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    counts[counted["language"].to_numpy(), counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    tables = np.zeros(((1 << BUCKET_BITS) + 1, code.shape[1]))
    for bit in range(code.shape[1]):
        if (code[:, bit] == -1).any():
            tables[:-1, bit] = np.log(shares[code[:, bit] == 1].mean(axis=0)) - np.log(shares[code[:, bit] == -1].mean(axis=0))
    model = LanguageModel(languages, code, tables, np.ones(code.shape[1]), np.full(code.shape, 1.0))
    part = min(1.0, sample / sum(listed.values()))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).mapInArrow(_margin_rows(model), "lang string, margins array<double>")
    # where one text is repeated often, what is taken depends on the values alone
    drawn = drawn.orderBy(F.xxhash64("lang", "margins"), "lang").limit(2 * sample).toArrow()
    if drawn.num_rows:
        number = {x: i for i, x in enumerate(languages)}
        which = np.array([number[x] for x in drawn["lang"].to_pylist()])
        margins = np.array(drawn["margins"].to_pylist())
        model.scale = np.maximum(1e-6, np.abs(margins).mean(axis=0))
        for i in range(len(languages)):
            if (which == i).any():
                model.trust[i] = 0.01 + ((margins[which == i] * code[i]) > 0).mean(axis=0)
    model.trust /= model.trust.mean(axis=1, keepdims=True)
    return model


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, ambiguous (and ``extra``)."""
    extra = extra or {}
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in extra.items()], F.col(text_col).alias("_text"), _has_letter(F.col(text_col)).alias("_letters"))
    if model is None:
        return rows.select("doc_id", *extra, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    carried, types = ["doc_id", *extra], dict(rows.dtypes)
    schema = "".join(f"{k} {types[k]}, " for k in carried) + "lang_pred string, score double, ambiguous boolean"
    return small_batches(rows).mapInArrow(_scorer(model, len(carried), dict(enumerate(carried))), schema)


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The documents with a letter whose language isn't ambiguous, with all their columns."""
    if model is None:
        return docs.where("false")
    names = {i: f"c{i}" for i in range(len(docs.columns))}
    wide = docs.select(*[F.col(f"`{c}`").alias(names[i]) for i, c in enumerate(docs.columns)], _has_letter(F.col(text_col)).alias("letters"))
    schema = "".join(f"{k} {t}, " for k, t in wide.dtypes[:-1]) + "lang_pred string, score double, ambiguous boolean"
    marked = small_batches(wide).mapInArrow(_scorer(model, docs.columns.index(text_col), names), schema)
    return marked.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*[F.col(names[i]).alias(c) for i, c in enumerate(docs.columns)])
