"""Removal of repeated passages: runs of words that a document with a smaller id has too, found by FM-indexes over shards of passages.

A passage is a run of windows (13 words each) whose smallest hash of six neighbouring words, their anchor, is one and the same. Equal windows have equal
anchors, so a shard that gets all passages of an anchor sees every occurrence of their windows, and each passage is looked for in one shard.

1. Documents are packed into chunks of bounded size, stored once.
2. Each chunk sends its distinct anchors, packed by hash range. An anchor of one document only cannot be in a repeated window; the chunks hear which of theirs others have too.
3. Chunks cut the passages of those anchors, each distinct text once with its smallest and greatest doc_id, and send them to the shard of the anchor. Anchors
   with many different passages are spread: their windows go one by one, by their own hash.
4. A shard sorts the words of its distinct passages by what follows and keeps the Burrows-Wheeler transform as a bit-packed wavelet matrix. Passages stream through it:
   backward search takes the words of each window from the last to the first and narrows the rows that match; a search ends early when only the passage itself is
   left. The length reached is the matching statistic of the window's end; a window that keeps 13 matching words is reported with the smallest doc_id of its interval.
5. Each chunk gets the reports on its passages and removes what documents with greater ids repeat.

Size and skew. A hot passage, however often it occurs, is one entry of each chunk, and one passage of the index; a hot anchor is one entry of each chunk. All groups are sized by the
text they stand for. Hashes only choose where a passage goes and find it again in its own chunk; whether windows are equal is decided on words.

Defined cases. A null or empty text has no words: counts of zero and the hash of the empty string. Texts shorter than a window keep all words. Rows with one doc_id repeat each other
without loss, as neither id is smaller. A row with a null doc_id is no source and loses nothing. An empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomatch.llm.common import SLICE_ROWS
from geomatch.storage import stored

WINDOW = 13
ANCHOR = 6
CHUNK_BYTES = 8 << 20
#: Text that one hash range of anchors and one shard of passages stand for.
SHARE_BYTES = 8 << 20
#: Chunks are dealt to at most this many tasks.
TASKS = 20_000
#: An anchor with more different passages than this is spread over the shards.
HOT_PASSAGES = 5000
#: A passage has at most this many windows.
RUN_WINDOWS = 4096

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_CHUNK = "chunk string, ids array<bigint>, sizes array<bigint>, texts binary"
_ANCHORS = "share int, chunk string, anchors binary, many binary, passages binary"
_SHARED = "chunk string, anchors binary, hot binary"
_PASSAGES = "share int, chunk string, texts binary, keys binary, firsts binary, lasts binary"
_REPORTS = "chunk string, keys binary, sizes binary, firsts binary"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
DIGESTS = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
SPANS = "doc_id bigint, start bigint, words bigint"


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            columns = ([f"{part}-{made}"], [ids], [[len(t) for t in texts]], [_pack(b"".join(texts))])
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "ids", "sizes", "texts"])

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part_of = batch.slice(start, SLICE_ROWS)
                for doc_id, data in zip(part_of["doc_id"].to_pylist(), part_of["data"]):
                    ids.append(doc_id)
                    texts.append(data.as_py() or b"")
                    held += len(texts[-1])
                    if held >= size or len(ids) >= 100_000:
                        yield row()
                        made, ids, texts, held = made + 1, [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data"))
    return rows.mapInArrow(run, _CHUNK)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Words:
    """The words of a chunk, with hashes of any run of them."""

    def __init__(self, row: dict) -> None:
        self.ids = row["ids"]
        data, at = _unpack(row["texts"]), 0
        self.words: list[bytes] = []
        ends = []
        for size in row["sizes"]:
            self.words += data[at : at + size].split()
            at += size
            ends.append(len(self.words))
        self.ends = np.array(ends, np.int64)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        n = len(self.words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n)
        power = np.full(n + 1, _BASE)
        power[:1] = 1
        power = np.multiply.accumulate(power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self.sums[1:])
        inverse = np.full(n + 1, _BASE_INVERSE)
        inverse[:1] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.doc = np.repeat(np.arange(len(self.ids)), self.ends - self.starts)

    def hashes(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of the ``n`` words from each place on."""
        return _mixed((self.sums[at + n] - self.sums[at]) * self.inverse[at] + np.asarray(n).astype(np.uint64))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin (documents without id have none), and their anchors."""
        n = len(self.words)
        if n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low = self.hashes(np.arange(n - ANCHOR + 1), ANCHOR)
        wide, have = WINDOW - ANCHOR + 1, 1
        while have < wide:
            step = min(have, wide - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        at = np.arange(n - WINDOW + 1)
        known = np.array([i is not None for i in self.ids], bool)
        inside = (self.doc[at] == self.doc[at + WINDOW - 1]) & known[self.doc[at]]
        return at[inside], low[inside]

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one anchor: first window, number of windows, anchor."""
        at, anchor = self.windows()
        if not len(at):
            return at, at, anchor
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (self.doc[at[1:]] != self.doc[at[:-1]])]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.r_[heads, len(at)])
        if sizes.max() > RUN_WINDOWS:
            pieces = -(-sizes // RUN_WINDOWS)
            place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            heads = np.repeat(heads, pieces) + place * RUN_WINDOWS
            sizes = np.minimum(np.repeat(sizes, pieces) - place * RUN_WINDOWS, RUN_WINDOWS)
        return at[heads], sizes, anchor[heads]


def _shares(h: np.ndarray, shares: int) -> np.ndarray:
    """Anchors are smallest hashes, so they are mixed again before they are dealt out."""
    h = _mixed(h + _BASE)
    return ((h >> _U(32)) * _U(shares) >> _U(32)).astype(np.int32)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [field.split() for field in schema.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, names)], [name for name, _ in names])


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _anchors(chunks: DataFrame, shares: int) -> DataFrame:
    """The distinct anchors of each chunk by hash range: whether several of its documents have them, and how many different passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                words = _Words(row)
                at, n, anchor = words.passages()
                if not len(at):
                    continue
                key = words.hashes(at, n + WINDOW - 1)
                order = np.lexsort((key, anchor))
                anchor, key, doc = anchor[order], key[order], words.doc[at][order]
                heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                many = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
                other = np.r_[True, (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1])]
                passages = np.add.reduceat(other.astype(np.uint32), heads)
                anchor = anchor[heads]
                share = _shares(anchor, shares)
                order = np.argsort(share, kind="stable")
                share, anchor, many, passages = share[order], anchor[order], many[order], passages[order]
                cuts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
                yield _batch(
                    [(int(share[a]), row["chunk"], anchor[a:b].tobytes(), many[a:b].tobytes(), _pack(passages[a:b].astype("u4").tobytes())) for a, b in zip(cuts, np.r_[cuts[1:], len(share)])],
                    _ANCHORS,
                )

    return chunks.mapInArrow(run, _ANCHORS)


def _shared(anchors: DataFrame, shares: int, hot_passages: int) -> DataFrame:
    """The anchors of each chunk that several documents have, and which of them have many passages."""

    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        own = [np.frombuffer(r["anchors"], np.uint64) for r in rows]
        anchor = np.concatenate(own)
        many = np.concatenate([np.frombuffer(r["many"], bool) for r in rows])
        passages = np.concatenate([np.frombuffer(_unpack(r["passages"]), "u4") for r in rows]).astype(np.int64)
        order = np.argsort(anchor)
        heads = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
        size = np.diff(np.r_[heads, len(order)])
        shared = np.zeros(len(anchor), bool)
        shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], heads), size)
        hot = np.zeros(len(anchor), bool)
        hot[order] = np.repeat(np.add.reduceat(passages[order], heads) > hot_passages, size)
        out, at = [], 0
        for r, a in zip(rows, own):
            here = slice(at, at + len(a))
            at += len(a)
            if shared[here].any():
                out.append((r["chunk"], a[shared[here]].tobytes(), hot[here][shared[here]].tobytes()))
        return pa.Table.from_batches([_batch(out, _SHARED)])

    return anchors.repartition(shares, "share").groupBy("share").applyInArrow(run, _SHARED)


def _with_chunks(chunks: DataFrame, told: DataFrame, tasks: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each chunk with the rows that it is told. The number of tasks is given, as packed bytes say little of their work."""
    sides = [side.repartition(tasks, "chunk").groupBy("chunk") for side in (chunks, told)]
    return sides[0].cogroup(sides[1]).applyInArrow(work, schema)


def _cut(chunks: DataFrame, shared: DataFrame, shares: int, tasks: int) -> DataFrame:
    """The different passages of each chunk whose anchors are shared, for their shards."""

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if chunk.num_rows and told.num_rows:
            row = _rows(chunk)[0]
            words = _Words(row)
            at, n, anchor = words.passages()
            known = np.concatenate([np.frombuffer(r["anchors"], np.uint64) for r in _rows(told)])
            hot = np.concatenate([np.frombuffer(r["hot"], bool) for r in _rows(told)])
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            place = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            asked = known[place] == anchor
            at, n, anchor, hot = at[asked], n[asked], anchor[asked], hot[place[asked]]
            single = np.repeat(at[hot], n[hot]) + np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            at, n, route = np.r_[at[~hot], single], np.r_[n[~hot], np.ones(len(single), np.int64)], np.r_[anchor[~hot], words.hashes(single, WINDOW)]
            key = words.hashes(at, n + WINDOW - 1)
            ids = np.array([0 if i is None else i for i in words.ids], np.int64)[words.doc[at]]
            share = _shares(route, shares)
            order = np.lexsort((ids, key, share))
            heads = np.flatnonzero(np.r_[True, (key[order][1:] != key[order][:-1]) | (share[order][1:] != share[order][:-1])]) if len(order) else order
            first, last = ids[order][heads], ids[order][np.r_[heads[1:], len(order)] - 1] if len(order) else ids
            one = order[heads]
            cuts = np.flatnonzero(np.r_[True, share[one][1:] != share[one][:-1]]) if len(one) else one
            for a, b in zip(cuts, np.r_[cuts[1:], len(one)]):
                mine = one[a:b]
                text = b"\n".join(b" ".join(words.words[s : s + k + WINDOW - 1]) for s, k in zip(at[mine].tolist(), n[mine].tolist()))
                out.append((int(share[mine[0]]), row["chunk"], _pack(text), key[mine].tobytes(), _pack(first[a:b].tobytes()), _pack(last[a:b].tobytes())))
        return pa.Table.from_batches([_batch(out, _PASSAGES)])

    return _with_chunks(chunks, shared, tasks, run, _PASSAGES)


class WaveletMatrix:
    """Counts of a symbol before a place, from one bit vector for each bit of the symbols. Each word of 64 bits has the number of ones before it."""

    def __init__(self, symbols: np.ndarray, kinds: int) -> None:
        self.levels = max(1, int(kinds - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(kinds)
        self.start = self._down(every, np.zeros(kinds, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word = at >> 6
            below = (_U(1) << (at & 63).astype(np.uint64)) - _U(1)
            ones = self.ones[i][word] + np.bitwise_count(self.bits[i][word] & below)
            bit = (symbol >> (self.levels - 1 - i)) & 1
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Backward search over numbers; 0 separates passages. Rows are sorted by at least ``depth`` symbols, which is exact for patterns up to that length."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.symbols, n = symbols, len(symbols)
        kinds = int(symbols.max()) + 1 if n else 1
        width = max(1, (kinds - 1).bit_length())
        have = min(62 // width, depth)
        key = np.zeros(n, np.int64)
        for i in range(have):
            key <<= width
            key[: n - i] |= symbols[i:]
        while True:
            self.rows = np.argsort(key).astype(np.int32)
            sorted_key = key[self.rows]
            if have >= depth:
                break
            rank = np.empty(n, np.int64)
            rank[self.rows] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]][:n])
            key = rank << 32
            key[: n - have] |= rank[have:]
            del rank, sorted_key
            have *= 2
        del key, sorted_key
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=kinds))]
        self.tree = WaveletMatrix(symbols[self.rows - 1], kinds)

    def statistics(self, ends: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For patterns that end at these places of the indexed text: how many symbols, up to ``upto``, match before only the place itself is left, and the
        interval of rows that match."""
        length = np.ones(len(ends), np.int64)
        symbol = self.symbols[ends]
        low, high = self.before[symbol], self.before[symbol + 1]
        live = np.flatnonzero(high - low > 1)
        for step in range(1, upto):
            symbol = self.symbols[ends[live] - step]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            length[live] += 1
            live = live[high[live] - low[live] > 1]
            if not len(live):
                break
        return np.where(high - low > 1, length, np.minimum(length, upto - 1)), low, high


def _firsts(passages: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """For each passage the smallest doc_id that has each of its windows."""
    sizes = np.array([len(p) for p in passages], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    symbols = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int32)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    symbols[np.delete(np.arange(1, len(owner) + 1), starts + sizes - 1)] = np.concatenate(passages)
    index = FMIndex(symbols, WINDOW)
    windows = sizes - WINDOW + 1
    offset = np.cumsum(windows) - windows
    place = np.arange(int(windows.sum())) - np.repeat(offset, windows)
    ends = np.repeat(starts, windows) + place + WINDOW - 1
    length, low, high = index.statistics(ends, WINDOW)
    least = np.repeat(first, windows)
    found = np.flatnonzero(length >= WINDOW)
    if len(found):
        # Intervals of equal length are equal or apart, so the smallest id of each is one reduction.
        lows, back = np.unique(low[found], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[back] = high[found]
        ids = np.r_[first[np.r_[0, owner][index.rows]], 0]
        least[found] = np.minimum.reduceat(ids, np.stack([lows, highs], 1).ravel())[::2][back]
    return np.split(least, offset[1:])


def _report(passages: DataFrame, shares: int) -> DataFrame:
    """What the index of each shard says about the passages of each chunk that sent them: those of which some window is in a smaller document than the chunk's greatest one."""

    def run(table: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        known: dict[bytes, int] = {}
        split: list[np.ndarray] = []
        first: list[int] = []
        told: list[tuple] = []
        for batch in table.to_batches(max_chunksize=1):
            row = batch.to_pylist()[0]
            mine = []
            for text, least in zip(_unpack(row["texts"]).split(b"\n"), np.frombuffer(_unpack(row["firsts"]), np.int64).tolist()):
                i = place.setdefault(text, len(place))
                if i == len(first):
                    first.append(least)
                    split.append(np.array([known.setdefault(w, len(known) + 1) for w in text.split(b" ")], np.int32))
                elif least < first[i]:
                    first[i] = least
                mine.append(i)
            told.append((row["chunk"], np.frombuffer(row["keys"], np.uint64), np.array(mine), np.frombuffer(_unpack(row["lasts"]), np.int64)))
        place.clear(), known.clear()
        least = _firsts(split, np.array(first, np.int64))
        smallest = np.array([x.min() for x in least])
        out = []
        for chunk, key, mine, last in told:
            hit = np.flatnonzero(smallest[mine] < last)
            if len(hit):
                values = [least[i] for i in mine[hit]]
                out.append((chunk, key[hit].tobytes(), np.array([len(v) for v in values], "u4").tobytes(), _pack(np.concatenate(values).tobytes())))
        return pa.Table.from_batches([_batch(out, _REPORTS)])

    return passages.repartition(shares, "share").groupBy("share").applyInArrow(run, _REPORTS)


def _covered(words: _Words, told: list[dict]) -> np.ndarray:
    """Which words of a chunk are in a window that a smaller document has."""
    cover = np.zeros(len(words.words) + 1, np.int64)
    if told:
        key = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in told])
        size = np.concatenate([np.frombuffer(r["sizes"], "u4") for r in told]).astype(np.int64)
        least = np.concatenate([np.frombuffer(_unpack(r["firsts"]), np.int64) for r in told])
        order = np.argsort(key)
        key, size, offset = key[order], size[order], (np.cumsum(size) - size)[order]
        at, n, _ = words.passages()
        # Passages that were sent window by window are found by their windows.
        single, _ = words.windows()
        for starts, counts in ((at[n > 1], n[n > 1]), (single, np.ones(len(single), np.int64))):
            mine = words.hashes(starts, counts + WINDOW - 1)
            place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            hit = np.flatnonzero((key[place] == mine) & (size[place] == counts))
            many = counts[hit]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window = np.repeat(starts[hit], many) + step
            own = np.array([0 if i is None else i for i in words.ids], np.int64)[words.doc[window]]
            window = window[least[np.repeat(offset[place[hit]], many) + step] < own]
            np.add.at(cover, window, 1)
            np.add.at(cover, window + WINDOW, -1)
    return np.cumsum(cover[:-1]) > 0


def _applied(chunks: DataFrame, reports: DataFrame, tasks: int, schema: str, make: Callable[[int | None, list[bytes], np.ndarray], list[tuple]]) -> DataFrame:
    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if chunk.num_rows:
            words = _Words(_rows(chunk)[0])
            gone = _covered(words, _rows(told))
            for doc_id, start, end in zip(words.ids, words.starts.tolist(), words.ends.tolist()):
                out += make(doc_id, words.words[start:end], gone[start:end])
        return pa.Table.from_batches([_batch(out, schema)])

    return _with_chunks(chunks, reports, tasks, run, schema)


def _kept(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join(words if not gone.any() else [words[i] for i in np.flatnonzero(~gone)])


def _digest(doc_id: int | None, words: list[bytes], gone: np.ndarray) -> list[tuple]:
    return [(doc_id, len(words), int(gone.sum()), hashlib.sha256(_kept(words, gone)).hexdigest())]


def _text(doc_id: int | None, words: list[bytes], gone: np.ndarray) -> list[tuple]:
    return [(doc_id, len(words), int(gone.sum()), _kept(words, gone).decode("utf-8", "replace"))]


def _spans(doc_id: int | None, words: list[bytes], gone: np.ndarray) -> list[tuple]:
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return [(doc_id, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


def _reported(docs: DataFrame, chunk_bytes: int, share_bytes: int, hot_passages: int) -> tuple[DataFrame, DataFrame, int]:
    chunks = stored(_chunks(docs, chunk_bytes))
    text = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    n_chunks, size = chunks.select(text.alias("n")).agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shares, tasks = max(1, math.ceil(size / share_bytes)), max(1, min(n_chunks, TASKS))
    shared = _shared(_anchors(chunks, shares), shares, hot_passages)
    return chunks, _report(_cut(chunks, shared, shares, tasks), shares), tasks


def repeated_spans(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, share_bytes: int = SHARE_BYTES, hot_passages: int = HOT_PASSAGES) -> DataFrame:
    """``doc_id, start, words``: the runs of words that windows of documents with smaller ids cover."""
    return _applied(*_reported(docs, chunk_bytes, share_bytes, hot_passages), SPANS, _spans)


def without_repeats(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, share_bytes: int = SHARE_BYTES, hot_passages: int = HOT_PASSAGES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: every document without the words of repeated windows, one space between words."""
    return _applied(*_reported(docs, chunk_bytes, share_bytes, hot_passages), KEPT, _text)


def digests(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, share_bytes: int = SHARE_BYTES, hot_passages: int = HOT_PASSAGES) -> DataFrame:
    """:func:`without_repeats` with the SHA-256 of what is kept instead of the text."""
    return _applied(*_reported(docs, chunk_bytes, share_bytes, hot_passages), DIGESTS, _digest)
