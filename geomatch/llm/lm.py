"""Language-model scores from an interpolated modified Kneser-Ney model of word pairs.

Counting. Tasks hash the words of the training texts (XXH64), count pairs of neighbours in memory up to a bound and send
them, sorted and packed as arrays, to shards: by the hash of the first word, or, for words that a bounded sample
finds frequent, by the hash of the second, so that no word's followers meet in one task. Each shard merges its
pairs, writes them as sorted hash arrays, and sends how often and after how many different words each second word stands to
the shards of the second words, which write those as sorted hash arrays too. One read of the corpus counts all.

Scoring. Workers map the arrays of the shared folder into memory and look up the pairs, first words and second words of about a million
tokens at a time, sorted, so each array is swept in order and a page is read once in a sweep. A shared folder that is no mounted file system is
read instead of mapped.

The model folder belongs to the application and goes with it. Files are written under another name and moved when whole,
so a task that runs again, after its executor was lost, leaves the same files. The driver gets sums and at most ``1 / HOT_SHARE`` frequent words.

Order. The model is of order two: counting the pairs of a corpus takes nearly three times the disk of its compressed texts here. Triples, half as many
again and mostly unique, would come to more than four times by estimate.

Defined cases. A null or empty text is one token, the end of a text. A row whose id is null is scored, is not held out and teaches nothing. Rows that
repeat count and are scored each. With nothing to learn from, every token has probability 1 (score 0), and so base_score is log10(0.1 / 0.1) = 0 for each.
Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.llm.common import arrow_map, file_system, fold, hashed_sample, new_folder, text_bytes, word_runs

FOLDS = 10
SHARD_BYTES = 16 << 20
FLUSH_TOKENS = 2_000_000
SCORE_TOKENS = 1_000_000
HOT_SHARE = 1 / 2000
HOT_SAMPLE = 2000
END = xxhash.xxh64_intdigest(b"\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def token_runs(data: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and second hash of each pair of neighbours, in runs; the end stands before and after the words."""
    last = END
    for words in word_runs(data):
        h = _hashes(words)
        if len(h):
            yield np.concatenate([np.array([last], np.uint64), h[:-1]]), h
            last = int(h[-1])
    yield np.array([last], np.uint64), np.array([END], np.uint64)


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _shards(first: np.ndarray, second: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    return np.where(np.isin(first, hot), _top(second, bits), _top(first, bits))


def _pair_keys(first: np.ndarray, second: np.ndarray, shard: np.ndarray, bits: int) -> np.ndarray:
    """One number for a pair, ordered by its shard."""
    mixed = (first * _MIX) ^ second
    mixed = (mixed ^ (mixed >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> _U(32)
    return (shard.astype(np.uint64) << _U(64 - bits)) | (mixed >> _U(bits)) if bits else mixed


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _grouped(keys: tuple[np.ndarray, ...], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sort by keys (the first counts most) and add the values of equal keys."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    change = np.ones(len(order), dtype=bool)
    if len(order):
        change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(change)
    return [k[starts] for k in keys], [np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


class _Store:
    """Arrays of the model in the shared folder."""

    def __init__(self, uri: str):
        self.files, self.path = file_system(uri)
        self.open: dict[str, np.ndarray] = {}

    def write(self, name: str, array: np.ndarray) -> None:
        out = io.BytesIO()
        np.save(out, array)
        part = f"{self.path}/_{name}-{id(out):x}-{np.random.default_rng().integers(1 << 62):x}"
        with self.files.open_output_stream(part) as stream:
            stream.write(out.getbuffer())
        self.files.move(part, f"{self.path}/{name}.npy")

    def read(self, name: str) -> np.ndarray:
        if name not in self.open:
            path = f"{self.path}/{name}.npy"
            if isinstance(self.files, pafs.LocalFileSystem):
                self.open[name] = np.load(path, mmap_mode="r")
            else:
                with self.files.open_input_stream(path) as stream:
                    self.open[name] = np.load(io.BytesIO(stream.read()))
        return self.open[name]


@dataclass
class Model:
    uri: str
    bits: int
    tokens: int = 0
    kinds: int = 0
    pairs: int = 0
    pair_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    word_kinds: np.ndarray = field(default_factory=lambda: np.zeros(4))
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    hot_stats: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many keys have count 1 to 4."""
    plain = np.array([0.0, 0.5, 1.0, 1.5])
    if not n[0] or not n[1]:
        return plain
    y = n[0] / (n[0] + 2 * n[1])
    for k in range(1, 4):
        if n[k - 1] and n[k]:
            plain[k] = np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05)
    return plain


def _kinds_of(counts: np.ndarray, upto: int) -> list[int]:
    return [int((counts == k).sum()) for k in range(1, upto)] + [int((counts >= upto).sum())]


def _count_pairs(train: DataFrame, hot: np.ndarray, bits: int, flush: int) -> DataFrame:
    names = ["shard", "firsts", "sizes", "seconds", "counts"]

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        first, second = (np.concatenate(x) for x in zip(*held))
        held.clear()
        shard = _shards(first, second, hot, bits).astype(np.int32)
        (shard, first, second), (n,) = _grouped((shard, first, second), [np.ones(len(first), np.int32)])
        heads = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (shard[1:] != shard[:-1])])
        sizes = np.diff(np.r_[heads, len(first)])
        rows = []
        for s, at, end in _runs(shard):
            own = slice(np.searchsorted(heads, at), np.searchsorted(heads, end))
            rows.append((s, first[heads[own]].tobytes(), sizes[own].astype("u4").tobytes(), second[at:end].tobytes(), n[at:end].astype("u4").tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tokens = 0
        for batch in batches:
            for text in batch["text"]:
                for pair in token_runs(text.as_py()):
                    held.append(pair)
                    tokens += len(pair[0])
                    if tokens >= flush:
                        yield packed(held)
                        tokens = 0
        if held:
            yield packed(held)

    return train.mapInArrow(run, "shard int, firsts binary, sizes binary, seconds binary, counts binary")


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else []
    for s, e in zip(starts, [*starts[1:], len(sorted_values)]):
        yield int(sorted_values[s]), int(s), int(e)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


#: Rows of numbers that no shard merges: they pass to the driver.
_SUMS = -1
_MERGED = "shard int, words binary, kinds binary, counts binary"


def _merge_pairs(uri: str, hot: np.ndarray, bits: int):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        first = np.repeat(_joined(table["firsts"], "u8"), _joined(table["sizes"], "u4"))
        (first, second), (n,) = _grouped((first, _joined(table["seconds"], "u8")), [_joined(table["counts"], "u4").astype(np.int64)])
        store = _Store(uri)
        keys = _pair_keys(first, second, np.full(len(first), shard), bits)
        order = np.argsort(keys)
        store.write(f"pairs-{shard}", keys[order])
        store.write(f"pair_counts-{shard}", _small(n[order]))
        each = [n, *((n == k).astype(np.int64) for k in (1, 2)), (n > 2).astype(np.int64)]
        (context,), stats = _grouped((first,), each)
        frequent = np.isin(context, hot)
        store.write(f"firsts-{shard}", context[~frequent])
        for name, x in zip(("total", "ones", "twos", "more"), stats):
            store.write(f"first_{name}-{shard}", _small(x[~frequent]))
        (word,), (kinds, counts) = _grouped((second,), [np.ones(len(second), np.int64), n])
        rows = [(s, word[a:e].tobytes(), kinds[a:e].astype("u4").tobytes(), counts[a:e].astype("u8").tobytes()) for s, a, e in _runs(_top(word, bits))]
        part = np.stack([x[frequent] for x in stats], axis=1) if frequent.any() else np.empty((0, 4), np.int64)
        rows.append((_SUMS, context[frequent].tobytes(), part.astype("i8").tobytes(), np.array(_kinds_of(n, 5), "i8").tobytes()))
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("shard", "words", "kinds", "counts"), zip(*rows), (pa.int32(), *[pa.binary()] * 3))})

    return merge


def _merge_words(uri: str, bits: int):
    """Writes the arrays of second words; gives sums: kinds of pairs, of words, and the frequent first words."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        none = np.empty(0, np.int64)
        if shard == _SUMS:
            word, part = _joined(table["words"], "i8"), _joined(table["kinds"], "i8").reshape(-1, 4)
            pair_kinds = _joined(table["counts"], "i8").reshape(-1, 5).sum(axis=0)
            (word,), sums = _grouped((word,), [part[:, i] for i in range(4)])
            hot_part, row = np.stack(sums, axis=1) if len(word) else none.reshape(0, 4), [*pair_kinds, *[0] * 8]
        else:
            (word,), (kinds, counts) = _grouped((_joined(table["words"], "u8"),), [_joined(table["kinds"], "u4").astype(np.int64), _joined(table["counts"], "u8").astype(np.int64)])
            store = _Store(uri)
            store.write(f"words-{shard}", word)
            store.write(f"word_kinds-{shard}", _small(kinds))
            store.write(f"word_counts-{shard}", _small(counts))
            row = [*[0] * 5, *_kinds_of(kinds, 5), int(counts.sum()), len(word), int(kinds.sum())]
            word, hot_part = none, none.reshape(0, 4)
        return pa.table({"sums": pa.array([[int(x) for x in row]], pa.list_(pa.int64())), "hot": pa.array([word.astype(np.int64)], pa.list_(pa.int64())), "stats": pa.array([hot_part.ravel().astype(np.int64)], pa.list_(pa.int64()))})

    return merge


def _frequent(train: DataFrame, sample_rows: int) -> np.ndarray:
    """Hashes of the words that make up ``HOT_SHARE`` of the tokens of a bounded sample, or more."""
    ids = hashed_sample(train.select("doc_id"), [], sample_rows).distinct()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = np.concatenate([second for text in batch["text"] for _, second in token_runs(text.as_py())])
            word, n = np.unique(h, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        return work

    counted = arrow_map(train.join(F.broadcast(ids), "doc_id", "left_semi").select("text"), make, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") > HOT_SHARE * total).select("word").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES, flush: int = FLUSH_TOKENS, hot_sample: int = HOT_SAMPLE) -> Model:
    """Count the model on the rows whose id is not in fold 0."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text")).filter(fold(F.col("doc_id"), FOLDS) != 0)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / shard_bytes)))))
    uri = new_folder(spark, "language-model")
    files, path = file_system(uri)
    files.create_dir(path, recursive=True)
    hot = _frequent(own, hot_sample)
    pairs = _count_pairs(own.select("text"), hot, bits, flush)
    merged = pairs.groupBy("shard").applyInArrow(_merge_pairs(uri, hot, bits), _MERGED)
    words = merged.groupBy("shard").applyInArrow(_merge_words(uri, bits), "sums array<long>, hot array<long>, stats array<long>").persist()
    total = words.select(*(F.sum(F.col("sums")[i]) for i in range(13))).first()
    frequent = [(h, s) for row in words.filter(F.size("hot") > 0).collect() for h, s in zip(row.hot, np.array(row.stats).reshape(-1, 4))]
    words.unpersist()
    sums = [int(x or 0) for x in total]
    frequent.sort(key=lambda x: x[0] % (1 << 64))
    return Model(
        uri, bits, tokens=sums[10], kinds=sums[11], pairs=sums[12], pair_discounts=_discounts(sums[:4]), word_discounts=_discounts(sums[5:9]),
        word_kinds=np.array([sums[5], sums[6], sum(sums[7:10])], dtype=float),
        hot=np.array([h for h, _ in frequent], dtype=np.int64).view(np.uint64), hot_stats=np.array([s for _, s in frequent], dtype=float).reshape(-1, 4),
    )


class Scorer:
    """Log probabilities of token pairs, from mapped arrays."""

    def __init__(self, model: Model):
        self.model, self.store = model, _Store(model.uri)

    def _find(self, wanted: np.ndarray, shard: np.ndarray, keys: str, values: list[str]) -> list[np.ndarray]:
        """Values of sorted keys, whose shards are sorted too; 0 where a key is absent."""
        out = [np.zeros(len(wanted), np.int64) for _ in values]
        for s, a, e in _runs(shard):
            known = self._array(f"{keys}-{s}")
            if known is None or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, wanted[a:e]), len(known) - 1)
            hit = np.flatnonzero(known[at] == wanted[a:e])
            for o, name in zip(out, values):
                o[a + hit] = self.store.read(f"{name}-{s}")[at[hit]]
        return out

    def _array(self, name: str) -> np.ndarray | None:
        try:
            return self.store.read(name)
        except FileNotFoundError:  # no word of the training texts falls in this shard
            return None

    def of(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability, base log10 probability and whether the word is known, of each pair."""
        m = self.model
        if not m.tokens:
            return np.zeros(len(first)), np.zeros(len(first)), np.zeros(len(first), bool)
        word, at_word = np.unique(second, return_inverse=True)
        kinds, counts = self._find(word, _top(word, m.bits), "words", ["word_kinds", "word_counts"])
        d = m.word_discounts
        uniform = (d[1:4] @ m.word_kinds) / (m.kinds + 1)
        low = (np.maximum(kinds - d[np.minimum(kinds, 3)], 0) + uniform) / m.pairs
        context, at_context = np.unique(first, return_inverse=True)
        total, *each = (x.astype(float) for x in self._find(context, _top(context, m.bits), "firsts", ["first_total", "first_ones", "first_twos", "first_more"]))
        if len(m.hot):
            place = np.minimum(np.searchsorted(m.hot, context), len(m.hot) - 1)
            is_hot = m.hot[place] == context
            total[is_hot] = m.hot_stats[place[is_hot], 0]
            for i, x in enumerate(each):
                x[is_hot] = m.hot_stats[place[is_hot], i + 1]
        d = m.pair_discounts
        backoff = d[1] * each[0] + d[2] * each[1] + d[3] * each[2]
        key, at = np.unique(_pair_keys(first, second, _shards(first, second, m.hot, m.bits), m.bits), return_inverse=True)
        (n,) = self._find(key, _top(key, m.bits), "pairs", ["pair_counts"])
        seen = np.maximum(n - d[np.minimum(n, 3)], 0)[at]
        total, backoff, low = total[at_context], backoff[at_context], low[at_word]
        p = np.where(total > 0, (seen + backoff * low) / np.maximum(total, 1), low)
        base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.kinds + 1)))
        return np.log10(p), base[at_word], counts[at_word] > 0


def score(docs: DataFrame, model: Model, tokens: int = SCORE_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def make():
        scorer = Scorer(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = np.zeros((4, batch.num_rows))
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def settle() -> None:
                if held:
                    rows = np.repeat([r for r, _, _ in held], [len(f) for _, f, _ in held])
                    p, base, known = scorer.of(np.concatenate([f for _, f, _ in held]), np.concatenate([s for _, _, s in held]))
                    for line, values in zip(out, (np.ones(len(rows)), known, base, p)):
                        line += np.bincount(rows, weights=values, minlength=batch.num_rows)
                    held.clear()

            waiting = 0
            for row, text in enumerate(batch["text"]):
                for first, second in token_runs(text.as_py()):
                    held.append((row, first, second))
                    waiting += len(first)
                    if waiting >= tokens:
                        settle()
                        waiting = 0
            settle()
            whole = [pa.array(x.round().astype(np.int64)) for x in out[:2]]
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *whole, pa.array(np.full(batch.num_rows, model.tokens)), pa.array(out[2]), pa.array(out[3])], names)

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), text_bytes(F.col("text")).alias("text"))
    return arrow_map(rows, make, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity_scores(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
