"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

The index is one row for each shard of documents: their ids and lengths, and for each term the documents that hold it with its
counts. A shard ends at a bounded number of postings, so it fits a task at any corpus size; terms that no item asks for are left out while
the documents are read. Collection statistics (documents, their length, document frequencies) are sums over the shards.

Search evaluates every item in every shard. Lists that hold a small share of the shard's documents are short: they are added term at a time
into accumulators, and the sums are from then on one sorted list with one bound. That list and the long lists are walked document at a time, in
windows of document numbers: a window whose bounds together stay below the item's threshold is skipped whole; in the others the lists that can lift a
document over the threshold name the candidates, and the rest is looked up, highest bound first, only for candidates that can still pass. The threshold is the
``k``-th score so far, carried from shard to shard within a task; it starts at the ``k``-th accumulator, which is a score that some document reaches. Only what is strictly
below a threshold is left out, so equal scores all reach the last ranking by score and id. A task returns ``k`` rows for an item, however many shards it reads.

Items go to the tasks in blocks of bounded size, so their number is free.

Defined cases. A null or termless text is no document of the collection, and a null or termless item finds nothing. Each row of documents
is one document: rows that repeat a doc_id are ranked each. Rows of one item_id are one item, their terms taken together; null is an item_id too. Null
doc_ids come first among equal scores. Empty tables give an empty table. Only ``doc_id``, ``item_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomatch.llm.common import PIECE_CHARS, SLICE_ROWS
from geomatch.storage import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 20
SHARD_POSTINGS = 500_000
#: Up to these many bytes of distinct terms go to the tasks that index; beyond, every term is indexed.
VOCABULARY_BYTES = 32 << 20
BLOCK_BYTES = 8 << 20
#: A list is short with at most one in so many of the shard's documents.
SHORT_SHARE = 64
WINDOW = 512

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms in lower case; all others are breaks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SHARD = "doc_ids array<bigint>, lengths array<int>, terms array<string>, ends array<int>, docs array<int>, counts array<int>"
FOUND = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def term_runs(data: bytes | None, size: int = PIECE_CHARS) -> Iterator[list[bytes]]:
    """The terms of a whole text in lists of about ``size`` bytes of it each; no term is cut."""
    data, at = (data or b"").translate(_TERMS), 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Shard:
    """Postings of some documents, in columns until the shard is full."""

    def __init__(self, vocabulary: dict[bytes, int] | None) -> None:
        self.fixed = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, int] = {} if self.fixed is None else self.fixed
        self.term_of: list[int] = []
        self.sizes: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, data: bytes | None) -> None:
        n, count = 0, Counter()
        for terms in term_runs(data):
            n += len(terms)
            count.update(terms)
        if not n:
            return
        if self.fixed is None:
            known = self.terms
            self.term_of += [known.setdefault(t, len(known)) for t in count]
            self.counts += count.values()
            held = len(count)
        else:
            asked = [t for t in count if t in self.terms]
            self.term_of += [self.terms[t] for t in asked]
            self.counts += [count[t] for t in asked]
            held = len(asked)
        self.sizes.append(held)
        self.ids.append(doc_id)
        self.lengths.append(n)

    def row(self, names: list[str] | None) -> pa.RecordBatch:
        term_of = np.array(self.term_of, np.int32)
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        order = np.argsort(term_of, kind="stable")
        used, starts = np.unique(term_of[order], return_index=True)
        names = [t.decode("utf-8", "replace") for t in self.terms] if names is None else names
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [one(self.ids, pa.int64()), one(self.lengths, pa.int32()), one([names[i] for i in used], pa.string()), one(np.append(starts[1:], len(docs))[: len(used)].tolist(), pa.int32()),
             whole(docs[order]), whole(np.array(self.counts, np.int32)[order])],
            ["doc_ids", "lengths", "terms", "ends", "docs", "counts"],
        )


def build_index(docs: DataFrame, terms: list[str] | None = None, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The shards of all documents, of every term or of the terms given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(None if terms is None else {t.encode(): i for i, t in enumerate(terms)})
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for doc_id, data in zip(part["doc_id"].to_pylist(), part["data"]):
                    shard.add(doc_id, data.as_py())
                    if len(shard.term_of) + len(shard.ids) >= shard_postings:
                        yield shard.row(terms)
                        shard.clear()
        if shard.ids:
            yield shard.row(terms)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data"))
    return rows.mapInArrow(run, SHARD)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, n``: how often an item asks for a term."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    terms = items.select(F.col("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def _vocabulary(asked: DataFrame) -> list[str] | None:
    """The distinct terms of all items, if they are few enough to go to every task."""
    terms = asked.select("term").distinct()
    if (terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) > VOCABULARY_BYTES:
        return None
    return sorted(r.term for r in terms.collect())


class _Lists:
    """The lists of one shard as the items of a block need them."""

    def __init__(self, shard: dict, share: int, mean: tuple[int, int]) -> None:
        documents, total = mean
        lengths = np.array(shard["lengths"], np.int64)
        self.norm = 12 * (75 + (25 * lengths * documents) // total)
        self.ids = shard["doc_ids"]
        self.size = len(self.ids)
        self.place = {t: i for i, t in enumerate(shard["terms"])}
        self.ends, self.docs, self.counts = shard["ends"], shard["docs"], shard["counts"]
        self.short = self.size // share
        self.windows = np.arange(0, self.size + WINDOW, WINDOW)
        self.known: dict[str, tuple] = {}

    def get(self, term: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None] | None:
        """Documents, what one occurrence of weight one adds to each, and for long lists where windows begin and their greatest values."""
        if term in self.known:
            return self.known[term]
        found = None
        if (i := self.place.get(term)) is not None:
            here = slice(self.ends[i - 1] if i else 0, self.ends[i])
            docs, counts = self.docs[here], self.counts[here].astype(np.int64)
            value = (1_000_000_000 * counts) // (1000 * counts + self.norm[docs])
            found = docs, value, None, None
            if len(docs) > self.short:
                found = docs, value, *_windowed(docs, value, self.windows)
        self.known[term] = found
        return found


def _windowed(docs: np.ndarray, value: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(docs, windows)
    most = np.zeros(len(windows) - 1, np.int64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        most[full] = np.maximum.reduceat(value, at[full])
    return at, most


def search_shard(lists: _Lists, terms: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard, with their scores, among which are all of its best ``k`` that reach ``least``."""
    sums = np.zeros(lists.size, np.int64)
    long: list[tuple] = []
    for term, weight in terms:
        if weight and (found := lists.get(term)) is not None:
            docs, value, at, most = found
            if at is None:
                sums[docs] += weight * value
            else:
                long.append((docs, value, at, most, weight))
    # The accumulators become one more list: sorted by document, with the bounds of its windows.
    held = np.flatnonzero(sums).astype(np.int32)
    if len(held) >= k:
        least = max(least, int(np.partition(sums[held], len(held) - k)[len(held) - k]))
    if len(held):
        long.append((held, sums[held], *_windowed(held, sums[held], lists.windows), 1))
    if not long:
        return held, sums[held]
    bounds = np.array([weight * most for _, _, _, most, weight in long])
    whole = bounds.sum(axis=0)
    found_docs: list[np.ndarray] = []
    found_scores: list[np.ndarray] = []
    pool = np.zeros(0, np.int64)
    slot = np.zeros(WINDOW, np.int64)
    named = np.zeros(WINDOW, bool)
    for window in np.flatnonzero(whole >= max(least, 1)):
        if whole[window] < least:
            continue
        first = int(lists.windows[window])
        order = np.argsort(bounds[:, window], kind="stable")[::-1]
        rest = whole[window] - np.cumsum(bounds[order, window])
        # Lists in falling order of their bounds: those that follow the last one with a rest of at least the threshold cannot name a candidate.
        essential = int(np.searchsorted(-rest, -least, side="right")) + 1 if least > 0 else len(order)
        named[:] = False
        for i in order[:essential]:
            docs, _, at, _, _ = long[i]
            named[docs[at[window] : at[window + 1]] - first] = True
        candidates = np.flatnonzero(named)
        score = np.zeros(len(candidates), np.int64)
        for step, i in enumerate(order):
            docs, value, at, _, weight = long[i]
            here = slice(at[window], at[window + 1])
            own = docs[here] - first
            slot[own] = weight * value[here]
            score += slot[candidates]
            slot[own] = 0
            stay = score + rest[step] >= max(least, 1)
            if not stay.all():
                candidates, score = candidates[stay], score[stay]
            if not len(candidates):
                break
        if len(candidates):
            found_docs.append(candidates + first)
            found_scores.append(score)
            pool = np.concatenate([pool, score])
            if len(pool) >= k:
                pool = np.partition(pool, len(pool) - k)[len(pool) - k :]
                least = max(least, int(pool[0]))
    if not found_docs:
        return np.zeros(0, np.int64), pool
    docs, scores = np.concatenate(found_docs), np.concatenate(found_scores)
    stay = scores >= max(least, 1)
    return docs[stay], scores[stay]


def _best(kept: list[tuple[int, bool, int | None]], k: int) -> list[tuple]:
    """The first ``k`` by falling score, then null ids, then ascending id."""
    return sorted(kept, key=lambda r: (-r[0], r[1], r[2] or 0))[:k]


def _search_block(index: DataFrame, block: list[list[tuple[str, int]]], mean: tuple[int, int], k: int, share: int) -> DataFrame:
    """``item`` (place in the block), ``doc_id, score``: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block]
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch[name][row].values for name in batch.schema.names}
                for name in ("ends", "docs", "counts", "lengths"):
                    one[name] = one[name].to_numpy(zero_copy_only=False)
                one["terms"] = one["terms"].to_pylist()
                lists = _Lists(one, share, mean)
                for item, terms in enumerate(block):
                    least = best[item][-1][0] if len(best[item]) >= k else 0
                    docs, scores = search_shard(lists, terms, k, least)
                    if len(docs):
                        ids = lists.ids.take(pa.array(docs)).to_pylist()
                        best[item] = _best([*best[item], *((s, i is not None, i) for s, i in zip(scores.tolist(), ids))], k)
        rows = [(item, doc_id, score) for item, kept in enumerate(best) for score, _, doc_id in kept]
        for start in range(0, len(rows), 10_000):
            columns = zip(*rows[start : start + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], FOUND.names)

    return index.mapInArrow(run, FOUND)


def _weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2.0 * df + 1))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = K, share: int = SHORT_SHARE, shard_postings: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for every item."""
    spark = docs.sparkSession
    asked = stored(item_terms(items))
    index = stored(build_index(docs, _vocabulary(asked), shard_postings))
    sizes = index.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"))
    documents, total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    # Lists lie one behind the other, so a list's length is the difference of two ends.
    lists = index.select(F.explode(F.arrays_zip("terms", F.transform("ends", lambda e, i: e - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("own"))).alias("l"))
    df = lists.groupBy(F.col("l.terms").alias("term")).agg(F.sum("l.own").alias("df"))
    size = F.octet_length("term") + 32
    per_item = asked.join(df, "term").select("item_id", F.struct("term", (F.col("n") * _weight(F.col("df"), documents)).alias("weight")).alias("t"), size.alias("size"))
    weighted = per_item.groupBy("item_id").agg(F.collect_list("t").alias("terms"), F.sum("size").alias("size"))
    blocks = max(1, math.ceil((weighted.agg(F.sum("size")).first()[0] or 0) / block_bytes))
    weighted = stored(weighted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))))
    found = None
    for block in range(blocks):
        own = weighted.where(F.col("block") == block).collect()
        rows = _search_block(index, [[(t.term, t.weight) for t in r.terms] for r in own], (documents, total), k, share)
        named = spark.createDataFrame([(at, r.item_id) for at, r in enumerate(own)], T.StructType([T.StructField("item", T.IntegerType()), weighted.schema["item_id"]]))
        rows = rows.join(F.broadcast(named), "item").drop("item")
        found = rows if found is None else found.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
