"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, verified links, connected components.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints
that differ in at most three bits agree on at least three of six blocks, so rows meet on each of the
20 choices of three blocks and are verified by their Hamming distance.

Size and skew. Copies collapse to one row per fingerprint before anything is joined, so a hot text
costs one row. Rows of one block key are read as a sorted run: short runs are compared at all offsets,
longer ones become a spanning forest, so that a task returns a bounded number of links for each row. Runs above
``run_rows`` are not gathered: their rows pass on, one by one, to ``_meeting_points``, which links them
exactly with work linear in the rows. Components are joined by alternating large and small stars.

Defined cases. A null or empty text, or one of white space, has fingerprint zero and links like any other.
A text of fewer words than a shingle is one shingle. Rows that repeat a doc_id are kept, each with its
own fingerprint. A null doc_id is kept; it takes the component of its fingerprint, which is null if no
row there has an id. An empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomatch.llm.common import arrow_map, text_bytes, text_of, word_runs
from geomatch.storage import stored

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
RUN_ROWS = 2048
TASK_LINKS = 100_000

_WIDTHS = (11, 11, 11, 11, 10, 10)
_BLOCKS = [((1 << w) - 1) << sum(_WIDTHS[:i]) for i, w in enumerate(_WIDTHS)]
#: One mask per choice of three blocks that stay equal.
MASKS = [a | b | c for a, b, c in combinations(_BLOCKS, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits."""
    lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    # Eight counters of eight bits in a word, so at most 255 rows are added at a time.
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: bytes | None, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, in runs; none if it has no words."""
    some = False
    before: list[bytes] = []
    for words in word_runs(text):
        words = before + words
        if len(words) >= n:
            shingles = zip(*(words[i:] for i in range(n)))
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), dtype=np.uint64)
            some = True
        before = words[max(0, len(words) - n + 1) :]
    if before and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], dtype=np.uint64)


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text; zero if it has no words."""
    return majority(shingle_hashes(text, n))


def majority(runs: Iterable[np.ndarray]) -> int:
    """The fingerprint of a text whose shingles have the hashes in ``runs``."""
    votes, total = np.zeros(64, dtype=np.int64), 0
    for hashes in runs:
        votes += _votes(hashes)
        total += len(hashes)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.fromiter((fingerprint(t, n) for t in batch["text"].to_pylist()), dtype=np.uint64, count=batch.num_rows)
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], ["doc_id", "fp"])

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text")).alias("text")), make, "doc_id long, fp long")


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links of one run do, one for each row at most."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    open_rows = np.ones(len(prints), dtype=bool)
    out = []
    for start in range(len(prints)):
        if not open_rows[start]:
            continue
        open_rows[start] = False
        front = np.array([start])
        while len(front):
            reached = near[front].any(axis=0) & open_rows
            open_rows &= ~reached
            front = np.flatnonzero(reached)
            out += [(start, int(j)) for j in front]
    return out


def _run_links(prints: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole runs; ends[i] is where the run of row i ends."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rows = np.arange(len(prints))
    starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(prints) else rows
    long_runs = [(s, e) for s, e in zip(starts, ends[starts]) if e - s > 8]
    rows = rows[np.repeat(ends[starts] - starts <= 8, ends[starts] - starts)] if len(starts) else rows
    for step in range(1, 8):
        rows = rows[rows + step < ends[rows]]
        near = rows[np.bitwise_count(prints[rows] ^ prints[rows + step]) <= radius]
        left.append(near)
        right.append(near + step)
    for s, e in long_runs:
        if pairs := _forest(prints[s:e], radius):
            both = np.array(pairs) + s
            left.append(both[:, 0])
            right.append(both[:, 1])
    return np.concatenate(left), np.concatenate(right)


def _link_runs(radius: int, run_rows: int):
    """Reads rows sorted by (k, part); gives links with k null, and rows of longer runs with their k."""

    def table(k, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["k", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), dtype=np.int64)
        hot: tuple[int, int] | None = None
        for batch in batches:
            new = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "part", "fp")], axis=1)
            if hot is not None:
                same = (new[:, 0] == hot[0]) & (new[:, 1] == hot[1])
                if same.any():
                    yield table(new[same, 0], new[same, 2], new[same, 2])
                    new = new[~same]
            held = np.concatenate([held, new])
            if not len(held):
                continue
            change = np.flatnonzero((held[1:, 0] != held[:-1, 0]) | (held[1:, 1] != held[:-1, 1])) + 1
            last = int(change[-1]) if len(change) else 0
            yield from solved(held[:last], table)
            held = held[last:]
            if len(held) > run_rows:
                hot = (int(held[0, 0]), int(held[0, 1]))
                yield table(held[:, 0], held[:, 2], held[:, 2])
                held = held[:0]
        yield from solved(held, table)

    def solved(rows: np.ndarray, table) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        starts = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
        sizes = np.diff(np.r_[starts, len(rows)])
        large = np.repeat(sizes > run_rows, sizes)
        if large.any():
            yield table(rows[large, 0], rows[large, 2], rows[large, 2])
            rows, sizes = rows[~large], sizes[sizes <= run_rows]
        ends = np.repeat(np.cumsum(sizes), sizes)
        prints = rows[:, 2].astype(np.uint64)
        i, j = _run_links(prints, ends, radius)
        if len(i):
            yield table(pa.nulls(len(i), pa.int32()), rows[i, 2], rows[j, 2])

    return run


def _meeting_points(hot: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links among rows (k, fp) that share the blocks of mask k, without comparing them in pairs.

    Two fingerprints differ in three bits or fewer exactly if one bit changed in one and two bits changed
    in the other can give the same value. Every row is dealt to the values it reaches with one change
    (near) and with two (far); near rows of a value lie within two bits of each other and within three
    of its far rows, so linking all of them to the smallest near row loses nothing.
    """
    near_bits = radius // 2
    far_bits = radius - near_bits

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for k, fp in zip(batch["k"].to_pylist(), batch["fp"].to_pylist()):
                free = [1 << i for i in range(64) if not MASKS[k] >> i & 1]
                for n in {*range(near_bits + 1), far_bits}:
                    out += [(k, _signed((fp ^ sum(bits)) % (1 << 64)), fp, n <= near_bits) for bits in combinations(free, n)]
            k, at, fp, near = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(fp, pa.int64()), pa.array(near, pa.bool_())], ["k", "at", "fp", "near"])

        return work

    # One row is dealt to some five hundred values.
    dealt = arrow_map(hot.select("k", "fp").hint("rebalance"), make, "k int, at long, fp long, near boolean")
    centre = dealt.filter("near").groupBy("k", "at").agg(F.min("fp").alias("b"))
    return dealt.join(centre, ["k", "at"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(prints: DataFrame, radius: int = RADIUS, run_rows: int = RUN_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all that differ in ``radius`` bits or fewer.

    ``radius`` may be 0 to 3: more bits need more blocks.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("six blocks guarantee a radius of three at most")
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(MASKS))))
    rows = prints.select("fp", keys.alias("key")).select("key.k", "key.part", "fp")
    met = rows.repartition("k", "part").sortWithinPartitions("k", "part").mapInArrow(_link_runs(radius, run_rows), "k int, a long, b long")
    met = stored(met.distinct())
    found = met.filter("k is null").select("a", "b")
    hot = met.filter("k is not null").select("k", F.col("a").alias("fp"))
    if hot.isEmpty():
        return found
    return stored(found.union(_meeting_points(hot, radius)).distinct())


def connected(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) of every node with a link, by alternating stars.

    A round is two aggregations and two joins over the links; each is written to the shared folder, and
    the rounds end when the links no longer change.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # A round never adds links, so it needs no more tasks than the one before had links for.
        edges = stored(small.filter("u <> v").distinct().coalesce(state[0] // TASK_LINKS + 1))
        before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, run_rows: int = RUN_ROWS, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable) of every row."""
    prints = stored(fingerprints(docs, n))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(classes.select("fp"), radius, run_rows))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _tagged(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, fp and the whole row as a struct, so that no column of the row can clash."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = (t if t is None else t.encode() for t in text_of(batch))
            prints = np.fromiter((fingerprint(t, n) for t in texts), dtype=np.uint64, count=batch.num_rows)
            return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64)), batch["row"]], ["doc_id", "fp", "row"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return arrow_map(rows, make, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), rows.schema["row"]]))


def keep_first(docs: DataFrame, radius: int = RADIUS, run_rows: int = RUN_ROWS, n: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, one for each component: that of the smallest doc_id.

    Null ids come last, so a null row stays only where a component has no id. Of rows that repeat both the id and
    the fingerprint, one stays.
    """
    prints = stored(fingerprints(docs, n))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(classes.select("fp"), radius, run_rows))
    rooted = classes.join(roots, classes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "fp")).alias("x")).select(F.col("x.first_id").alias("kept_id"), F.col("x.fp").alias("kept_fp"))
    same = (F.col("kept_id").eqNullSafe(F.col("doc_id"))) & (F.col("kept_fp") == F.col("fp"))
    kept = stored(prints.join(first, same).groupBy("kept_id", "kept_fp").agg(F.count("*").alias("copies")))
    once, more = kept.filter("copies = 1"), kept.filter("copies > 1")
    out = _tagged(docs, n).join(once, same).select("row.*")
    if more.isEmpty():
        return out
    few = docs.join(more.select("kept_id"), docs["doc_id"].cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    rest = _tagged(few, n).join(more, same).groupBy("doc_id", "fp").agg(F.first("row").alias("row")).select("row.*")
    return out.unionByName(rest)
