"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two interpolated Kneser-Ney models of six bytes, one counted on toxic and one on ordinary training rows,
give each word two log-likelihoods; a white-space or punctuation mark ends a word. Orders three to six are the class's own; below, both
share one backoff model counted on all training rows, so an expression too rare to be known to a class
gets nearly the same probability from both. A document is described by the length-normalised
difference of its two log-likelihoods, by the word of the largest difference and by the largest
difference per letter; a logistic curve, fitted on training rows that the models have not seen, makes a score of them.

Learning uses a bounded sample: at most ``sample_rows`` labelled rows of each class for the models and as many
for the curve, chosen by a hash of the id. Scoring reads every whole text, in pieces of bounded size.

Defined cases. Null, empty and letterless texts have all differences zero and get the score of that. A row whose id is null
is not held out and teaches nothing. Of repeated labels of an id the toxic one counts. Without training rows
of both classes every score is the toxic share of the training rows, or 0 without any. Rows that repeat are
scored each. Only ``doc_id`` and ``text`` of the documents are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.llm.common import LETTERS, arrow_map, fold, hashed_sample, keep_rows, text_pieces

ORDER = 6
OWN_FROM = 3
SAMPLE_ROWS = 4000
FOLDS = 5
CALIBRATION_FOLD = 4
CACHED_WORDS = 200_000
CACHED_WINDOWS = 1_500_000
_WORDS = re.compile(LETTERS + "+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def windows(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The six bytes that end at each byte of each word as one number, and how many each word has.

    Zero bytes stand before a word and one byte of value 1 ends it.
    """
    pad = b"\0" * (ORDER - 1)
    coded = [w.encode() for w in words]
    sizes = np.fromiter((len(b) + 1 for b in coded), dtype=np.int64, count=len(coded))
    stream = np.frombuffer(b"".join(pad + b + b"\1" for b in coded) or b"", dtype=np.uint8).astype(np.uint64)
    if not len(stream):
        return np.empty(0, np.uint64), sizes
    codes = np.zeros(len(stream) - ORDER + 1, dtype=np.uint64)
    for i in range(ORDER):
        codes = (codes << np.uint64(8)) | stream[i : len(stream) - ORDER + 1 + i]
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    keep = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return codes[keep], sizes


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values[...] of the wanted keys, 0 where a key is absent; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class KneserNey:
    """Interpolated Kneser-Ney over byte windows, with counts frozen at construction; only the orders that are asked for stay."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, orders: range = range(1, ORDER + 1)):
        self.level = {}
        for k in range(ORDER, 0, -1):
            heads, at = np.unique(codes >> np.uint64(8), return_inverse=True)
            totals = np.bincount(at, weights=counts, minlength=len(heads))
            kinds = np.bincount(at, minlength=len(heads)).astype(float)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            if k in orders:
                self.level[k] = (codes, counts, heads, totals, kinds, discount)
            if k == orders.start:
                break
            # A window at the start of a word has one left neighbour only: it keeps its count.
            first = (codes >> np.uint64(8 * (k - 2))) & np.uint64(255) if k > 1 else codes
            left = np.where(first == 0, counts, 1.0)
            codes, at = np.unique(codes & np.uint64((1 << 8 * (k - 1)) - 1), return_inverse=True)
            counts = np.bincount(at, weights=left, minlength=len(codes))

    def refine(self, wanted: np.ndarray, k: int, low: np.ndarray) -> np.ndarray:
        """Probability at order k, given that of the order below."""
        codes, counts, heads, totals, kinds, discount = self.level[k]
        wanted = wanted & np.uint64((1 << 8 * k) - 1)
        total, kind = (_lookup(heads, x, wanted >> np.uint64(8)) for x in (totals, kinds))
        seen = np.maximum(_lookup(codes, counts, wanted) - discount, 0)
        return np.where(total > 0, (seen + discount * kind * low) / np.maximum(total, 1), low)


class WordDifferences:
    """Toxic minus ordinary log-likelihood of words, remembered up to a bound."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        both = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
        pooled = np.bincount(both[1], weights=np.concatenate([n for _, n in counts]))
        self.shared = KneserNey(both[0], pooled, range(1, OWN_FROM))
        self.own = [KneserNey(c, n.astype(float), range(OWN_FROM, ORDER + 1)) for c, n in counts]
        self.known: dict[str, float] = {}
        self.codes, self.values = np.empty(0, np.uint64), np.empty(0)

    def _window(self, codes: np.ndarray) -> np.ndarray:
        low = np.full(len(codes), 1 / 256)
        for k in range(1, OWN_FROM):
            low = self.shared.refine(codes, k, low)
        each = []
        for model in self.own:
            p = low
            for k in range(OWN_FROM, ORDER + 1):
                p = model.refine(codes, k, p)
            each.append(np.log(p))
        return each[1] - each[0]

    def _learn(self, words: list[str]) -> None:
        codes, sizes = windows(words)
        kinds, at = np.unique(codes, return_inverse=True)
        new = kinds[~np.isin(kinds, self.codes, assume_unique=True)]
        if len(new):
            if len(self.codes) > CACHED_WINDOWS:
                self.codes, self.values, new = np.empty(0, np.uint64), np.empty(0), kinds
            merged = np.concatenate([self.codes, new])
            order = np.argsort(merged, kind="stable")
            self.codes, self.values = merged[order], np.concatenate([self.values, self._window(new)])[order]
        values = self.values[np.searchsorted(self.codes, kinds)][at]
        sums = np.add.reduceat(values, np.cumsum(sizes) - sizes)
        self.known.update(zip(words, sums.tolist()))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if new := list(set(words).difference(self.known)):
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, words), dtype=float, count=len(words))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Three numbers for each text: mean difference per letter, largest of a word, largest per letter."""
        out = np.zeros((len(texts), 3))
        letters = np.zeros(len(texts))
        for rows, pieces in text_pieces(texts):
            words, owners = [], []
            for row, piece in zip(rows, pieces):
                found = words_of(piece)
                words += found
                owners.append((row, len(found)))
            if not words:
                continue
            gain = self.of(words)
            size = np.fromiter(map(len, words), dtype=float, count=len(words)) + 1
            at = 0
            for row, n in owners:
                if n:
                    g, s = gain[at : at + n], size[at : at + n]
                    out[row, 0] += g.sum()
                    letters[row] += s.sum()
                    out[row, 1:] = np.maximum(out[row, 1:], ((g / 10).max(), (g / s).max()))
                    at += n
        out[:, 0] /= np.maximum(letters, 1)
        return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic curve by Newton's method; the last is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), penalty * np.diag([*[0.01] * (x.shape[1] - 1), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    counts: list[tuple[np.ndarray, np.ndarray]] | None
    weights: np.ndarray | None
    share: float

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "differences"}

    @cached_property
    def differences(self) -> WordDifferences:
        """Built once in a worker process, which keeps a broadcast model over its tasks."""
        return WordDifferences(self.counts)

    def scorer(self):
        if self.counts is None:
            return lambda texts: np.full(len(texts), self.share)
        differences = self.differences
        return lambda texts: 1 / (1 + np.exp(-np.clip(np.c_[differences.features(texts), np.ones(len(texts))] @ self.weights, -30, 30)))


def _count(rows: DataFrame) -> DataFrame:
    """toxic, code, n: how often each window stands in the rows of a class."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds = [[np.empty(0, np.int32)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]]
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            texts = batch["text"].to_pylist()
            for group, pieces in text_pieces(texts):
                for y in (0, 1):
                    codes, _ = windows(w for row, piece in zip(group, pieces) if toxic[row] == y for w in words_of(piece))
                    code, n = np.unique(codes, return_counts=True)
                    for list_, values in zip(kinds, (np.full(len(code), y, np.int32), code, n)):
                        list_.append(values)
            y, code, n = (np.concatenate(k) for k in kinds)
            return pa.RecordBatch.from_arrays([pa.array(y), pa.array(code.astype(np.int64)), pa.array(n)], ["toxic", "code", "n"])

        return work

    return arrow_map(rows, make, "toxic int, code long, n long").groupBy("toxic", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Count both models and fit the curve on rows whose id is not in fold 0.

    What comes to the driver is bounded by ``sample_rows``: window counts of the sampled texts, and three numbers a row.
    """
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold(F.col("doc_id"), FOLDS))
        .filter("fold <> 0")
        .withColumn("part", (F.col("fold") == CALIBRATION_FOLD).cast("int"))
    )
    sample = hashed_sample(labelled.select("doc_id", "toxic", "part"), ["toxic", "part"], sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    counted = _count(texts.filter("part = 0").select("toxic", "text")).toPandas()
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    counts = []
    for y in (0, 1):
        own = counted[counted.toxic == y]
        code = own.code.to_numpy().astype(np.uint64)
        order = np.argsort(code)
        counts.append((code[order], own.n.to_numpy()[order]))
    if not all(len(c) for c, _ in counts):
        return Model(None, None, share)

    def make():
        differences = WordDifferences(counts)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            f = differences.features(batch["text"].to_pylist())
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], *(pa.array(f[:, i]) for i in range(3))], ["doc_id", "toxic", "a", "b", "c"])

        return work

    rows = arrow_map(texts.filter("part = 1").select("doc_id", "toxic", "text"), make, "doc_id long, toxic int, a double, b double, c double")
    # Rows that repeat an id are one, so that no more than the sample comes to the driver.
    seen = rows.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("toxic", "a", "b", "c"))).toPandas().sort_values("doc_id")
    y = seen.toxic.to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(None, None, share)
    return Model(counts, _logistic(seen[["a", "b", "c"]].to_numpy(), y), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = held.value.scorer()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scorer(batch["text"].to_pylist()))], ["doc_id", "held_out", "score"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, make, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, sample_rows))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic; every column is kept."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    return keep_rows(docs, lambda: (lambda scorer: lambda texts: scorer(texts) < 0.5)(held.value.scorer()))
