"""Language identification by prediction by partial matching.

For each language a byte context tree of variable depth (three bytes at most) is counted on training
texts and then frozen. A byte costs minus log2 of its probability in the deepest context the tree knows; a byte new to that
context first pays the escape (method C: kinds / (total + kinds)) and is then predicted by the next
shorter context, among the bytes not excluded by the longer one. The code lengths of a text under
all languages are summed exactly over the whole text; the shortest wins, and the score is its share among the two to the
minus code lengths.

As the statistics are frozen, the cost of each byte after each context of any tree is a table, filled once for each task. A text is
then coded by three vector operations: context number, table row, sum.

Learning uses a bounded sample: ``sample_texts`` texts of each language at most, chosen by a hash of the id,
of which each gives its first ``sample_chars`` characters. Prediction reads whole texts, in pieces of bounded size, and only
the text.

Defined cases. A text that is null or has no letter is ``und`` with score 0, as is every text when there is nothing to learn
from. A row whose id is null is not held out and teaches nothing. Ties go to the language that sorts first. Rows that repeat are predicted
each. Only ``doc_id``, ``text`` and (for learning) ``lang`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.llm.common import LETTERS, arrow_map, fold, hashed_sample, keep_rows, text_pieces

DEPTH = 3
SAMPLE_TEXTS = 1500
SAMPLE_CHARS = 20_000
COUNTED_BYTES = 1 << 20
FOLDS = 5
UNKNOWN = "und"
_LETTER = re.compile(LETTERS)


def _coded(text: str) -> bytes:
    return text.lower().encode()


def _grams(stream: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each place as one number."""
    n = len(stream) - DEPTH
    out = np.zeros(max(n, 0), dtype=np.uint32)
    for i in range(DEPTH + 1):
        out = (out << 8) | stream[i : n + i]
    return out


@dataclass
class Model:
    """Frozen statistics: how often each DEPTH + 1 bytes stand in the training texts of a language."""

    langs: list[str]
    lang: np.ndarray
    gram: np.ndarray
    count: np.ndarray


class Coder:
    """Table of code lengths, and the sums over texts.

    Bytes are numbered by the alphabet of the training texts, with one number for all others.
    """

    def __init__(self, model: Model):
        self.langs = model.langs
        alphabet = np.unique((model.gram[:, None] >> (8 * np.arange(DEPTH + 1))) & 255)
        self.number = np.zeros(256, dtype=np.uint8)
        self.number[alphabet] = np.arange(1, len(alphabet) + 1)
        self.a = a = len(alphabet) + 1
        letters = [self.number[(model.gram >> (8 * i)) & 255].astype(np.int64) for i in range(DEPTH, -1, -1)]
        n = len(self.langs)
        # The rows of one order after the other: the longest known end of each context, and where the rows of the order below are.
        orders, rows_of, deeper = [], 1, np.zeros(1, dtype=np.int64)
        for depth in range(DEPTH + 1):
            context = np.zeros(len(model.gram), dtype=np.int64)
            for x in letters[DEPTH - depth : DEPTH]:
                context = context * a + x
            seen = np.unique(context)
            parent = deeper[seen % a ** (depth - 1)] if depth > 1 else np.zeros(len(seen), dtype=np.int64)
            orders.append((np.searchsorted(seen, context), parent))
            # A context that no tree knows keeps the row of its longest known end.
            if depth:
                deeper = deeper[np.arange(a**depth) % a ** (depth - 1)]
                deeper[seen] = rows_of + np.arange(len(seen))
                rows_of += len(seen)
        self.row_of = deeper.astype(np.int32)
        # One language at a time: a worker stands beside others, and the tables in double precision take many times the result.
        self.bits = np.empty((rows_of * a, n), dtype=np.float32)
        for i in range(n):
            own = model.lang == i
            costs = np.empty((rows_of, a))
            # The uniform order stands below order 0.
            filled, low = 0, np.full((1, a), 1.0 / 256)
            for at, parent in orders:
                counts = np.zeros((len(parent), a))
                np.add.at(counts, (at[own], letters[DEPTH][own]), model.count[own])
                table = self._mixed(counts, (costs if filled else low)[parent])
                costs[filled : filled + len(parent)] = table
                filled += len(parent)
            self.bits[:, i] = -np.log2(costs).reshape(-1)

    @staticmethod
    def _mixed(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """PPM with method C and full exclusion: counts and lower probabilities are [context, byte]."""
        total = counts.sum(axis=1, keepdims=True)
        kinds = (counts > 0).sum(axis=1, keepdims=True)
        left = np.where(counts > 0, 0.0, low)
        left /= np.maximum(left.sum(axis=1, keepdims=True), 1e-12)
        known = total > 0
        scale = np.where(known, total + kinds, 1)
        mixed = np.where(counts > 0, counts / scale, kinds / scale * left)
        return np.where(known, np.maximum(mixed, 1e-9), low)

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each whole text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        before: dict[int, bytes] = {}
        pad = b"\0" * DEPTH
        for rows, pieces in text_pieces(texts):
            coded = [_coded(p) for p in pieces]
            # A piece is coded after the bytes that end the piece before it.
            parts = [x for row, c in zip(rows, coded) for x in (before.get(row, pad), c)]
            before = {rows[-1]: (pad + coded[-1])[-DEPTH:]} if rows else {}
            s = self.number[np.frombuffer(b"".join(parts), dtype=np.uint8)].astype(np.int32)
            context = s[:-DEPTH]
            for i in range(1, DEPTH):
                context = context * self.a + s[i : len(s) - DEPTH + i]
            # One row more than bytes, as the last sum ends there.
            bits = np.zeros((len(context) + 1, len(self.langs)), dtype=np.float32)
            np.take(self.bits, self.row_of[context] * self.a + s[DEPTH:], axis=0, out=bits[:-1], mode="clip")
            sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
            starts = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
            sums = np.add.reduceat(bits, np.c_[starts, starts + sizes].ravel(), axis=0, dtype=np.float64)[::2]
            np.add.at(out, rows, sums)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        known = np.fromiter((bool(t) and _LETTER.search(t) is not None for t in texts), dtype=bool, count=len(texts))
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, share, 0.0)


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model | None:
    """Count the trees on rows with a language whose id is not in fold 0.

    What comes to the driver is bounded by the sample: one number for each language and four bytes found in it.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").filter("lang is not null and doc_id is not null")
    sample = hashed_sample(known.filter(fold(F.col("doc_id"), FOLDS) != 0), ["lang"], sample_texts)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts = own.join(F.broadcast(sample), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            streams: dict[str, list[bytes]] = {}
            held: dict[str, int] = {}
            langs, grams, counts = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

            def count(lang: str) -> None:
                gram, n = np.unique(_grams(np.frombuffer(b"".join(streams.pop(lang)), dtype=np.uint8).astype(np.uint32)), return_counts=True)
                gram, n = gram[gram & 255 != 0].astype(np.int64), n[gram & 255 != 0]
                langs.extend([lang] * len(gram))
                grams.append(gram)
                counts.append(n)

            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if text:
                    streams.setdefault(lang, []).append(b"\0" * DEPTH + _coded(text))
                    held[lang] = held.get(lang, 0) + len(streams[lang][-1])
                    # Long texts are counted as they come, so that a slice of them takes no more than some short ones.
                    if held[lang] >= COUNTED_BYTES:
                        count(lang)
                        held[lang] = 0
            for lang in list(streams):
                count(lang)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

        return work

    counted = arrow_map(texts, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return None
    langs = sorted(counted.lang.unique())
    at = counted.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()
    return Model(langs, at, counted.gram.to_numpy(), counted.n.to_numpy())


def _predictor(held):
    coder = Coder(held.value) if held.value else None
    return coder.predict if coder else lambda texts: ([UNKNOWN] * len(texts), np.zeros(len(texts)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predictor = _predictor(held)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = predictor(batch["text"].to_pylist())
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    return predict(docs, train(docs, sample_texts))


def keep_known(docs: DataFrame, least: float = 0.5, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows, with at least this score; every column is kept."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, sample_texts))

    def make():
        predictor = _predictor(held)

        def keeps(texts):
            lang, score = predictor(texts)
            return (np.array(lang, dtype=object) != UNKNOWN) & (score >= least)

        return keeps

    return keep_rows(docs, make)
