"""Near-duplicates by SimHash, and by exact similarity: all pairs of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The fingerprints, blocks and links are those of ``simhash``. Its links propose pairs, whole sets verify them. At 0.8 about ten of 64 bits
differ, too wide for pigeonhole blocks, so three bits miss similar pairs: those are found by a prefix-filter join among what is not joined yet.

1. Texts with equal sets of shingles (XXH64, as for fingerprints) become one representative, so a hot text costs one row.
   Representatives whose fingerprints are equal or linked (three bits or fewer, by blocks) are verified, and their components joined.
2. Prefixes. Shingles have one global order: common ones last, then by hash. Two sets of similarity 0.8 share a shingle of
   their first m - ceil(0.8 m) + 1. Any order is exact; which shingles are common is estimated from a sample of documents
   and only decides the cost.
3. Lists. Representatives meet on each prefix shingle; a shingle that one has alone ends there. In lists above
   ``LIST_ROWS`` members that are not in its component yet are first compared with one centre, then each with the next ``NEIGHBOURS`` in one order of all texts, so a large group of near
   copies joins in work linear in it. The centre is the member with the greatest part of its prefix in long lists: edits make rare shingles, which
   come first in a prefix, so that is the text the others were made from, or the one nearest to it.
4. All pairs of a list that are not in one component yet, and whose sizes and 256 parity bits allow 0.8, are counted over the lists. The bits travel
   with the list's rows, so that unlike texts in a long list never become a row. Sets a and b share at
   most their common prefix shingles and what one of them has after its prefix, which drops more pairs; parity bits of the whole sets, a hundredth of
   their size, drop nearly all others that are not similar; the rest is verified on whole sets. No pair of similarity 0.8 is lost, except inside a component, where it changes nothing.

Work above linear is left for long lists whose members are not near-duplicates of each other: texts that consist of common shingles
almost wholly, and yet differ. They are compared in slices and only pairs of fitting size become rows.

Defined cases are those of ``simhash``: texts without words have equal, empty sets; fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomatch.llm import simhash
from geomatch.llm.common import arrow_map, text_bytes, text_of
from geomatch.llm.simhash import connected, shingle_hashes
from geomatch.storage import stored

SHINGLE_WORDS = 5
#: Documents sampled for the order of shingles: one in so many, and so many at least.
SAMPLE_SHARE = 20
SAMPLE_DOCS = 2000
#: A shingle in so many sampled texts is common; so many common shingles are kept at most.
COMMON_TEXTS = 3
COMMON_SHINGLES = 200_000
LIST_ROWS = 64
#: Parity bits that the rows of lists carry, as columns of 64.
LIST_BITS = ("b0", "b1", "b2", "b3")
NEIGHBOURS = 8
SLICE = 512


def shingle_set(text: bytes | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order, as signed longs."""
    return _distinct(list(shingle_hashes(text, n)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.empty(0, np.int64)


def set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first m - ceil(0.8 m) + 1 of m shingles, common ones last."""
    if not len(shingles):
        return shingles
    at = np.searchsorted(common, shingles)
    last = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == shingles) if len(common) else np.zeros(len(shingles), bool)
    return shingles[np.argsort(last, kind="stable")][: prefix_size(len(shingles))]


def parity_bits(shingles: np.ndarray, size: int | None = None) -> np.ndarray:
    """The parity of how many shingles fall on each of ``size`` bits (a power of two, by default one from the number of shingles on), as longs.

    A shingle that only one of two sets has changes one bit, so two sets differ in no fewer shingles than their bits do.
    """
    size = size or max(64, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount(shingles & (size - 1), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def prefix_size(m):
    return m - (4 * m + 4) // 5 + 1


def _keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.fromiter(map(set_key, sets), dtype=np.uint64, count=len(sets)).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """key and shingles (all of them) of each row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, n) for t in batch["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([_keys(sets), _lists(sets)], ["key", "shingles"])

        return work

    return arrow_map(docs.select(text_bytes(F.col("text")).alias("text")), make, "key long, shingles array<long>")


def common_shingles(docs: DataFrame, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Shingles that several texts of a sample hold, equal texts counted once. The sample grows with the documents, so that the lists of
    shingles that it misses do not."""
    rows = docs.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = _sets(docs.filter(place * F.lit(rows) < max(SAMPLE_DOCS, rows // SAMPLE_SHARE)), n).dropDuplicates(["key"])
    counted = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter(F.col("c") >= COMMON_TEXTS)
    return np.sort(np.array([r.s for r in counted.orderBy(F.desc("c"), "s").limit(COMMON_SHINGLES).collect()], dtype=np.int64))


_LONGS = ", ".join(f"{c} long" for c in LIST_BITS)


def _prefixes(docs: DataFrame, common: np.ndarray, n: int) -> DataFrame:
    """doc_id, key, fp (the fingerprint), m (shingles), prefix, parity bits and the bits for lists of every row."""
    names = ["doc_id", "key", "fp", "m", "prefix", "bits", *LIST_BITS]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets, prints = [], np.empty(batch.num_rows, np.uint64)
            for i, text in enumerate(batch["text"].to_pylist()):
                parts = list(shingle_hashes(text, n))
                sets.append(_distinct(parts))
                prints[i] = simhash.majority(parts)
            columns = [batch["doc_id"], _keys(sets), pa.array(prints.view(np.int64)), pa.array(map(len, sets), pa.int32()), _lists([prefix(s, common) for s in sets]), _lists([parity_bits(s) for s in sets])]
            few = np.array([parity_bits(s, 64 * len(LIST_BITS)) for s in sets], np.int64).reshape(-1, len(LIST_BITS))
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in np.ascontiguousarray(few.T))], names)

        return work

    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_bytes(F.col("text")).alias("text")), make, "doc_id long, key long, fp long, m int, prefix array<long>, bits array<long>, " + _LONGS)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (s, key, m) sorted by s, those whose s another row has too."""
    held: pa.RecordBatch | None = None
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        s = batch["s"].to_numpy()
        up = np.r_[len(s) > 0 and before is not None and s[0] == before, s[1:] == s[:-1]]
        keep = up | np.r_[up[1:], False]
        # The last row waits for the next batch, which may share its shingle.
        yield batch.slice(0, len(s) - 1).filter(pa.array(keep[:-1]))
        held, before = batch.slice(len(s) - 1), int(s[-2]) if len(s) > 1 else before
    if held is not None:
        yield held.filter(pa.array([held["s"][0].as_py() == before]))


def _like(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rows (s, key, m, root, list bits) whose bits allow a similarity of 0.8."""
    # Counted as unsigned: of a negative number numpy counts the bits of its absolute value.
    unlike = np.bitwise_count((first[:, 4:] ^ second[:, 4:]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return 9 * unlike <= first[:, 2] + second[:, 2]


def _ring_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by s, as for ``_run_pairs``, such pairs of each row with the next ``NEIGHBOURS`` of its list."""
    names = ("s", "key", "m", "root", *LIST_BITS)
    held = np.empty((0, len(names)), np.int64)
    for batch in batches:
        fresh = np.stack([batch[c].to_numpy().astype(np.int64) for c in names], axis=1)
        rows = np.concatenate([held, fresh])
        for step in range(1, NEIGHBOURS + 1):
            # The second of a pair is always a fresh row, so no pair comes twice.
            at = np.arange(max(len(held), step), len(rows))
            a, b = rows[at - step], rows[at]
            m, o = a[:, 2], b[:, 2]
            fit = (a[:, 0] == b[:, 0]) & (a[:, 1] != b[:, 1]) & (a[:, 3] != b[:, 3]) & (5 * np.minimum(m, o) >= 4 * np.maximum(m, o))
            a, b = a[fit], b[fit]
            like = _like(a, b)
            k, l = a[like, 1], b[like, 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k, l)), pa.array(np.maximum(k, l))], ["a", "b"])
        held = rows[-NEIGHBOURS:]


def _run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (s, key, m, root, list bits) sorted by s, pairs a < b of a list with different roots, and sizes and bits that allow 0.8."""
    names = ("s", "key", "m", "root", *LIST_BITS)
    held = np.empty((0, len(names)), np.int64)

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        ends = np.r_[starts[1:], len(rows)]
        out: list[np.ndarray] = []
        waiting = 0
        for start, end in zip(starts, ends):
            run = rows[start:end]
            if (run[:, 3] == run[0, 3]).all():
                continue
            for i in range(0, len(run), SLICE):
                for j in range(i, len(run), SLICE):
                    a, b = run[i : i + SLICE, None], run[None, j : j + SLICE]
                    m, o = a[..., 2], b[..., 2]
                    x, y = np.nonzero((a[..., 1] < b[..., 1] if i == j else a[..., 1] != b[..., 1]) & (a[..., 3] != b[..., 3]) & (5 * np.minimum(m, o) >= 4 * np.maximum(m, o)))
                    first, second = run[i + x], run[j + y]
                    like = _like(first, second)
                    if like.any():
                        x, k, l = x[like], first[like, 1], second[like, 1]
                        out.append(np.stack([np.minimum(k, l), np.maximum(k, l)]))
                        waiting += len(x)
                    if waiting > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["a", "b"])
                        out, waiting = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["a", "b"])

    for batch in batches:
        held = np.concatenate([held, np.stack([batch[c].to_numpy().astype(np.int64) for c in names], axis=1)])
        if len(held):
            last = int(np.searchsorted(held[:, 0], held[-1, 0]))
            yield from pairs(held[:last])
            held = held[last:]
    yield from pairs(held)


def _fits(m: Column, o: Column) -> Column:
    return F.least(m, o) * 5 >= F.greatest(m, o) * 4


def _may_be_similar(x: Column, y: Column, m: Column, o: Column) -> Column:
    """Sets of similarity 0.8 differ in at most a ninth of their summed sizes, so their bits do. Sizes that fit are within a factor of two; the
    longer bits are folded."""
    least = F.least(F.size(x), F.size(y))

    def folded(bits: Column) -> Column:
        halves = F.zip_with(F.slice(bits, F.lit(1), least), F.slice(bits, least + 1, least), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(bits) > least, halves).otherwise(bits)

    unlike = F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return 9 * F.aggregate(unlike, F.lit(0), lambda a, b: a + b) <= m + o


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more, by whole sets."""
    pairs = pairs.select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("key").alias(side), F.col("m").alias(f"m{side}"), F.col("bits").alias(f"bits{side}")), side)
    likely = _may_be_similar(F.col("bitsa"), F.col("bitsb"), F.col("ma"), F.col("mb"))
    pairs = stored(pairs.filter(likely).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = stored(reps.join(wanted, "key", "left_semi").select("key", "first_id"))
    ids = wanted.select("first_id").distinct()
    held = docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["first_id"]), "left_semi")
    sets = stored(_sets(held, n).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    rows = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return stored(rows.filter(both * 5 >= (F.size("x") + F.size("y") - both) * 4).select("a", "b"))


def fingerprint_pairs(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives (key, fp, m) that SimHash proposes: equal fingerprints, and those that its links join. Each
    fingerprint stands for one representative, so there are about as many pairs as rows and links."""
    classes = stored(reps.groupBy("fp").agg(F.min_by(F.struct("key", "m"), "key").alias("c")))
    same = reps.join(classes, "fp").select(F.struct("key", "m").alias("x"), F.col("c").alias("y"))
    near = simhash.links(classes.select("fp"))
    for side, name in (("a", "x"), ("b", "y")):
        near = near.join(classes.select(F.col("fp").alias(side), F.col("c").alias(name)), side)
    met = same.union(near.select("x", "y")).filter((F.col("x.key") != F.col("y.key")) & _fits(F.col("x.m"), F.col("y.m")))
    return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def links(reps: DataFrame, docs: DataFrame, n: int = SHINGLE_WORDS, list_rows: int = LIST_ROWS) -> DataFrame:
    """node, root of the representatives (key, first_id, fp, m, prefix) that have a link of similarity 0.8 or more."""
    proposed = stored(fingerprint_pairs(reps))
    found = _verified(proposed, reps, docs, n)
    roots = connected(found)
    rows = reps.select(F.explode("prefix").alias("s"), "key", "m").repartition("s").sortWithinPartitions("s")
    lists = stored(rows.mapInArrow(_shared, "s long, key long, m int"))
    long_lists = stored(lists.join(lists.groupBy("s").agg(F.count("*").alias("c")).filter(F.col("c") > list_rows).select("s"), "s", "left_semi"))
    # The part of a prefix that lies in long lists. Any choice of centres gives the same components.
    size = F.col("m") - F.floor((4 * F.col("m") + 4) / 5) + 1
    central = long_lists.groupBy("key", "m").agg(F.count("*").alias("c")).select("key", (F.col("c") / size).alias("central"))
    order = F.struct(-F.col("central"), F.xxhash64("key"))
    centres = stored(long_lists.join(central, "key").groupBy("s").agg(F.min_by(F.struct("key", "m"), order).alias("c")))
    met = long_lists.join(centres, "s").filter((F.col("key") != F.col("c.key")) & _fits(F.col("m"), F.col("c.m")))
    met = met.select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b")).distinct()
    for side in ("a", "b"):
        met = met.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    apart = F.coalesce("ra", "a") != F.coalesce("rb", "b")
    met = stored(met.filter(apart).select("a", "b").join(proposed, ["a", "b"], "left_anti"))
    tried = proposed.union(met)
    found = found.union(_verified(met, reps, docs, n))
    roots = connected(found)

    def placed(part: DataFrame) -> DataFrame:
        rows = part.join(roots, part.key == roots.node, "left").select("s", "key", "m", F.coalesce("root", "key").alias("root"))
        return rows.join(reps.select("key", *LIST_BITS), "key").repartition("s")

    ring = placed(long_lists).sortWithinPartitions("s", F.xxhash64("key")).mapInArrow(_ring_pairs, "a long, b long")
    ring = stored(ring.distinct().join(tried, ["a", "b"], "left_anti"))
    tried = tried.union(ring)
    found = found.union(_verified(ring, reps, docs, n))
    roots = connected(found)
    pairs = placed(lists).sortWithinPartitions("s").mapInArrow(_run_pairs, "a long, b long")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("c"))
    for side in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("key").alias(side), F.col("m").alias(f"m{side}")), side)
    rest = lambda m: F.floor((F.col(m) * 4 + 4) / 5) - 1
    needed = F.ceil((F.col("ma") + F.col("mb")) * 4 / 9 - 1e-9)
    pairs = pairs.filter(F.col("c") + F.greatest(rest("ma"), rest("mb")) >= needed).join(tried, ["a", "b"], "left_anti")
    return connected(found.union(_verified(pairs, reps, docs, n)))


def _tagged(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key and the whole row as a struct, so that no column of the row can clash."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t if t is None else t.encode(), n) for t in text_of(batch)]
            return pa.RecordBatch.from_arrays([batch["doc_id"], _keys(sets), batch["row"]], ["doc_id", "key", "row"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return arrow_map(rows, make, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), rows.schema["row"]]))


def components(docs: DataFrame, n: int = SHINGLE_WORDS, list_rows: int = LIST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, first_id, root) of every representative."""
    rows = stored(_prefixes(docs, common_shingles(docs, n), n))
    reps = stored(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.first("m").alias("m"), F.first("prefix").alias("prefix"), *(F.first(c).alias(c) for c in ("bits", *LIST_BITS))))
    roots = links(reps, docs, n, list_rows)
    return rows.select("doc_id", "key"), reps.join(roots, reps.key == roots.node, "left").select("key", "first_id", F.coalesce("root", "key").alias("root"))


def keep_first(docs: DataFrame, n: int = SHINGLE_WORDS, list_rows: int = LIST_ROWS) -> DataFrame:
    """The rows of ``docs``, one for each component: that of the smallest doc_id, as ``simhash.keep_first`` chooses it."""
    rows, rooted = components(docs, n, list_rows)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("x")).select(F.col("x.first_id").alias("kept_id"), F.col("x.key").alias("kept_key"))
    same = (F.col("kept_id").eqNullSafe(F.col("doc_id"))) & (F.col("kept_key") == F.col("key"))
    kept = stored(rows.join(first, same).groupBy("kept_id", "kept_key").agg(F.count("*").alias("copies")))
    once, more = kept.filter("copies = 1"), kept.filter("copies > 1")
    out = _tagged(docs, n).join(once, same).select("row.*")
    if more.isEmpty():
        return out
    few = docs.join(more.select("kept_id"), docs["doc_id"].cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    rest = _tagged(few, n).join(more, same).groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row.*")
    return out.unionByName(rest)
