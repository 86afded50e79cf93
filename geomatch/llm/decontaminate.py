"""Benchmark decontamination: item-sized windows of documents against benchmark items, DataFrame functions only.

A document is contaminated by an item if one of its windows of the item's length has a weighted shingle similarity of ``THRESHOLD`` or
more with it: shingles of five words, weighted by how often they occur, shared weight over joint weight.

1. Anchors. A similar window shares most shingles with the item, and one of the best windows starts at a shared shingle (moving a window
   on until it does loses none) or ends the document. So the positions of item shingles are found first, and only windows that start
   there, and hold as many shingles of items of their length as the similarity needs, are built. Nothing is lost by that.
2. Fingerprints. Windows of equal shingles become one row, however many documents hold them, and get a SimHash of 64 bits.
3. Multi-index blocks. Two fingerprints within ``RADIUS`` = 15 bits differ by one bit or none in one of eight blocks. Each item is stored under its eight blocks and their
   one-bit neighbours, each window asks for its eight blocks, among items of its length; pairs within the radius go on.
4. Rare shingles. Similar pairs can differ in more bits (short items mostly), which blocks do not promise to find. A window that is similar to an item
   of m shingles holds at least ceil(0.8 m) of them, so it holds one of any m - ceil(0.8 m) + 1: each item is stored under that many of its shingles, those
   that the fewest items of its length have, and windows that hold one go on with it.
5. Exact similarity verifies each pair of 3 and 4, on multisets of shingle hashes (64 bits). No similar pair is lost.

Item shingles are broadcast only if their counted number is within ``BROADCAST_SHINGLES``; more are joined by a shuffle. What is shuffled
then follows the shingles of the documents; otherwise only anchors are. An item or passage that very many documents hold adds rows in
proportion to those documents, never pairs of them.

Words are runs of letters and digits in lower case. Items of fewer than five words have one shingle, all their words.

Defined cases. Items and documents that are null, empty or without words match nothing. A document shorter than an item is one window. Repeated items give a row
for each distinct id; repeated rows of a doc_id count as one document. A null doc_id is carried as a document of its own, and removed with its
contaminated text: rows with a null id share their fate. Ties between windows go to the first. Only ``doc_id`` and ``text``, ``item_id`` and ``text``
are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomatch.storage import stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS = 8
BLOCK_BITS = 8
BROADCAST_SHINGLES = 1_000_000
_LANES = (1 << 32) + 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(hashes: Column, n: int) -> Column:
    """Hash of each run of ``n`` word hashes; none if there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n))))
    return F.when(F.size(hashes) >= n, each).otherwise(F.array().cast("array<long>"))


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


def fingerprint(shingles: Column) -> Column:
    """Bits that more than half of the hashes set; the counters of bits i and i + 32 share a long."""
    zero = F.lit(0).cast("long")

    def votes(i: Column) -> Column:
        return F.aggregate(shingles, zero, lambda sums, h: sums + _shifted(h, i).bitwiseAND(F.lit(_LANES)))

    def bit(count: Column, at: Column) -> Column:
        return F.when(count * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(zero)

    def add(bits: Column, x: Column) -> Column:
        low, high = x.votes.bitwiseAND(F.lit((1 << 32) - 1)), _shifted(x.votes, F.lit(32))
        return bits.bitwiseOR(bit(low, x.i)).bitwiseOR(bit(high, x.i + 32))

    counted = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("i"), votes(i).alias("votes")))
    return F.aggregate(counted, zero, add)


def tagged(shingles: Column) -> Column:
    """The multiset as a set: each hash with the number of its earlier occurrences."""
    plain = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(0)))
    counted = F.transform(shingles, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(shingles, 1, i), lambda x: x == h))))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(counted)


def _block(fp: Column, b: Column) -> Column:
    return _shifted(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _numbers(values: list[int]) -> Column:
    return F.explode(F.array(*map(F.lit, values)))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, width (words), n (words of a shingle), shingles of items that have words."""
    rows = benchmark.select("item_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).filter(F.size("h") > 0)
    n = F.least(F.size("h"), F.lit(SHINGLE_WORDS))
    short = F.array(F.xxhash64("h"))
    return rows.select("item_id", F.size("h").alias("width"), n.alias("n"), F.when(n < SHINGLE_WORDS, short).otherwise(shingles_of(F.col("h"), SHINGLE_WORDS)).alias("shingles")).distinct()


def _document_shingles(hashes: Column, n: int) -> Column:
    if n == SHINGLE_WORDS:
        return shingles_of(hashes, n)
    # A short item's only shingle is the hash of its array of words.
    each = F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), lambda i: F.xxhash64(F.slice(hashes, i, n)))
    return F.when(F.size(hashes) >= n, each).otherwise(F.array().cast("array<long>"))


def _anchors(hashed: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """doc_id, at, width: where a shingle of an item of that width stands in a document."""
    own = items.filter(F.col("n") == n)
    seeds = own.select("width", F.explode("shingles").alias("h")).distinct()
    if own.agg(F.sum(F.size("shingles"))).first()[0] <= BROADCAST_SHINGLES:
        seeds = F.broadcast(seeds)
    placed = hashed.select("doc_id", F.posexplode(_document_shingles(F.col("h"), n)).alias("at", "h"))
    return placed.join(seeds, "h").select("doc_id", "at", "width", F.lit(n).alias("n"))


def windows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, width, shingles of the windows that can be similar to an item of that width."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    kinds = [r[0] for r in items.select("n").distinct().collect()]
    if not kinds:
        return hashed.filter(F.lit(False)).select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("width"), F.col("h").alias("shingles"))
    found = None
    for n in sorted(kinds):
        part = _anchors(hashed, items, n)
        found = part if found is None else found.unionByName(part)
    # One row for each document with anchors: those of each width in order. It is written, so that its size is known when
    # the join is planned, and the documents stay where they are if it is small.
    found = found.groupBy("doc_id", "width", "n").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    found = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("width", "n", "ats")).alias("anchors")))
    held = docs.select(F.col("doc_id").cast("long").alias("own_id"), "text").join(found, F.col("own_id").eqNullSafe(F.col("doc_id")))
    held = held.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), "anchors")
    rows = held.select("doc_id", "h", F.explode("anchors").alias("a")).select("doc_id", "h", "a.width", "a.n", "a.ats")
    have = F.least(F.size("h"), F.col("width")) - F.col("n") + 1
    last = F.greatest(F.size("h") - F.col("width"), F.lit(0))
    needed = F.ceil(threshold / (1 + threshold) * (have + F.col("width") - F.col("n") + 1) - 1e-9).cast("int")
    # Anchors are sorted, so a window holds enough of them if the one that many places on is inside it.
    start = lambda a, j: F.when(a >= last, last).when(F.get("ats", j + needed - 1) < a + have, a)
    starts = F.when(F.size("ats") >= needed, F.array_distinct(F.array_compact(F.transform("ats", start))))
    rows = rows.select("doc_id", "h", "width", "n", F.explode(starts).alias("start"))
    own = F.slice("h", F.col("start") + 1, F.least(F.size("h"), F.col("width")))
    shingles = F.when(F.col("n") < SHINGLE_WORDS, F.array(F.xxhash64(own))).otherwise(shingles_of(own, SHINGLE_WORDS))
    return rows.select("doc_id", "start", "width", shingles.alias("shingles"))


def _by_rare_shingles(contents: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """width, window, item of all pairs that can have the similarity, whatever their fingerprints are."""
    tags = items.select("width", "item", F.explode(tagged(F.col("item_shingles"))).alias("tag")).distinct()
    counted = tags.join(tags.groupBy("width", "tag").agg(F.count("*").alias("items")), ["width", "tag"])
    ranked = counted.groupBy("width", "item").agg(F.array_sort(F.collect_list(F.struct("items", "tag"))).alias("tags"))
    # Also right for a threshold of zero: every shingle is a key then.
    size = F.size("tags") - F.greatest(F.ceil(F.size("tags") * threshold - 1e-9).cast("int"), F.lit(1)) + 1
    keys = stored(ranked.select("width", "item", F.explode(F.slice(F.col("tags.tag"), F.lit(1), size)).alias("tag")))
    if keys.count() <= BROADCAST_SHINGLES:
        keys = F.broadcast(keys)
    held = contents.select("width", "window", F.explode(tagged(F.col("shingles"))).alias("tag"))
    return held.join(keys, ["width", "tag"]).select("width", "window", "item").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start: the best window of each contaminated document and item."""
    items = stored(_items(benchmark))
    placed = stored(windows(docs, items, threshold).withColumn("window", F.xxhash64("width", "shingles")))
    contents = stored(placed.groupBy("width", "window").agg(F.first("shingles").alias("shingles")))
    asked = contents.withColumn("fp", fingerprint(F.col("shingles"))).withColumn("block", _numbers([*range(BLOCKS)])).withColumn("value", _block(F.col("fp"), F.col("block")))
    # Items of equal text are one, with several ids.
    named = items.withColumn("item", F.xxhash64("width", "shingles"))
    texts = stored(named.groupBy("width", "item").agg(F.first("shingles").alias("item_shingles")))
    prints = texts.select("width", "item", fingerprint(F.col("item_shingles")).alias("item_fp"))
    flips = [0, *(1 << i for i in range(BLOCK_BITS))]
    near = prints.withColumn("block", _numbers([*range(BLOCKS)])).withColumn("flip", _numbers(flips))
    kept = near.withColumn("value", _block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("flip").cast("long"))).drop("flip")
    pairs = asked.join(kept, ["width", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = stored(pairs.select("width", "window", "item").union(_by_rare_shingles(contents, texts, threshold)).distinct())
    a, b = tagged(F.col("shingles")), tagged(F.col("item_shingles"))
    exact = pairs.join(contents, ["width", "window"]).join(texts, ["width", "item"])
    exact = exact.withColumn("similarity", F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    good = exact.filter(F.col("similarity") >= threshold).select("width", "window", "item", "similarity").join(named.select("width", "item", "item_id"), ["width", "item"])
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start"))).alias("best")
    return placed.select("doc_id", "start", "width", "window").join(good, ["width", "window"]).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", "best.start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; every column is kept."""
    bad = stored(matches(docs, benchmark, threshold).select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("_bad")), "left_anti")
