"""Tolerant id lookups: a batch of requests against a set of keys, first match wins.

All lookups are equi-joins. "One id is part of the other" joins on substrings, cut only to the lengths
that occur on the other side, so every join row is a real match and nothing is compared pairwise. Keys
are cut in one pass; what nobody asks for is dropped by a semi-join before anything is
aggregated or shuffled, so a lookup costs what is asked. Where very many texts are asked for, that join would shuffle all parts of all keys:
then neighbouring keys are cut in one task, which combines the parts that they share before anything is shuffled. A text that many keys hold is reduced to its
first key before the requests are joined, so it never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.functions.ids import base_name, digit_run, numeric_id, own_aliases, padding_variants
from geomatch.operators.ranking import top_in_group
from geomatch.storage import freed, remove, scratch, stored

# Texts asked for are sent to the keys up to this number; more are joined by a shuffle.
BROADCAST_TEXTS = 1_000_000
# Keys that one task cuts, where their parts are combined before the shuffle.
TASK_KEYS = 100_000
# Neighbouring keys whose parts are combined when an index is written, as a power of two.
DEAL_BITS = 14
# Texts found that one task sorts by request.
TASK_TEXTS = 500_000


def _lengths(frame: DataFrame, column: str) -> Column:
    """The distinct text lengths of a column: a scalar subquery of a few small integers."""
    return frame.agg(F.array_sort(F.collect_set(F.length(column)))).scalar()


def _asked(
    ids: DataFrame, exact: Sequence[Column], contains: Column | None, key_lengths: Column
) -> tuple[DataFrame, DataFrame | None]:
    """``request_id, tier, text, whole``: each text that answers a request, as a whole key or (``whole`` false) as a part
    of one; and the containment probes, ``request_id, tier, probe``."""
    whole, part = F.lit(True).alias("whole"), F.lit(False).alias("whole")
    asked, probes = [], None
    if exact:
        asked.append(ids.select("request_id", F.posexplode(F.array(*exact)).alias("tier", "text"), whole))
    if contains is not None:
        probes = ids.select("request_id", F.posexplode(contains).alias("tier", "probe")).where(F.length("probe") > 0)
        probes = probes.withColumn("tier", F.col("tier") + len(exact))
        inside = _substrings(probes.withColumn("_lengths", key_lengths), "probe", "text")
        asked += [inside.select("request_id", "tier", "text", whole), probes.select("request_id", "tier", F.col("probe").alias("text"), part)]
    wanted = asked[0]
    for more in asked[1:]:
        wanted = wanted.unionByName(more)
    # Requests are distinct, a tier gives a text once, and substrings are distinct for each probe: no row comes twice.
    return stored(wanted), probes


def _substrings(frame: DataFrame, column: str, alias: str) -> DataFrame:
    """One row per distinct substring of ``column`` with a length in ``_lengths``, as ``alias``."""
    kept = [c for c in frame.columns if c not in ("_lengths", column)]
    size, n = F.length(column), F.col("_n")
    sized = frame.select(*kept, column, F.explode(F.filter("_lengths", lambda n: (n > 0) & (n <= size))).alias("_n"))
    parts = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(column, i, n))
    return sized.select(*kept, F.explode(F.array_distinct(parts)).alias(alias))


@dataclass(frozen=True)
class KeyIndex:
    """Keys cut once and stored, so that a lookup reads what it asks for instead of all keys.

    Below ``path`` lie ``texts`` (every key as a whole and every part of it, each with the place of the first key that
    holds it), ``keys`` (the key at each place) and ``shape`` (one row: number of slots, type of a place, lengths of the keys). The first two are
    partitioned by a hash of what they are read by and sorted inside. A lookup joins them with the texts asked for, and Spark
    prunes the slots that none of those falls in while it runs.

    A key of n characters has up to n(n+1)/2 parts: ids, not long texts. A slot is one task's work when the index is
    written, so ``slots`` should grow with the keys; one row a text makes slots even, however often a text occurs.
    """

    spark: SparkSession
    path: str

    @staticmethod
    def write(keys: DataFrame, path: str, slots: int = 256, mode: str = "errorifexists") -> KeyIndex:
        """Store an index of ``key, key_pos`` (as :func:`ranked_lookup` takes them) below ``path``."""
        index = KeyIndex(keys.sparkSession, path.rstrip("/"))
        keys = stored(keys.select("key", "key_pos").where("key IS NOT NULL"), path=(kept := scratch(index.spark)))
        # Every part of every key is wanted here, so neighbours are cut together: they combine what they share before the shuffle.
        # A deal is known to lie in one task, so its parts are combined there. In the order of the keys, like texts stand together and pack well.
        dealt = _neighbours(keys).sortWithinPartitions("key", "key_pos").withColumn("_deal", F.shiftright(F.monotonically_increasing_id(), DEAL_BITS))
        dealt = dealt.repartitionByRange((keys.count() >> DEAL_BITS) + 1, "_deal").sortWithinPartitions("key", "key_pos")
        sized = dealt.withColumn("_lengths", F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))))
        parts = _cuts(sized).groupBy("_deal", "text", "whole").agg(F.min("key_pos").alias("key_pos")).drop("_deal")
        # They are shuffled once, by the slot that they are written to, and sorted there anyway: the first row of a text is its first key.
        placed = parts.repartition(_slot("text", slots)).withColumn("slot", _slot("text", slots))
        index._write("texts", top_in_group(placed, ["slot", "text", "whole"], [F.asc_nulls_last("key_pos")], 1, "_rank").drop("_rank"), "text", mode)
        index._write("keys", keys.withColumn("slot", _slot("key_pos", slots)).repartition("slot"), "key_pos", mode)
        pos_type = F.lit(keys.schema["key_pos"].dataType.simpleString())
        shape = keys.agg(F.lit(slots).alias("slots"), pos_type.alias("pos_type"), F.array_sort(F.collect_set(F.length("key"))).alias("lengths"))
        shape.write.mode(mode).parquet(f"{index.path}/shape")
        remove(index.spark, kept)
        return index

    def _write(self, name: str, placed: DataFrame, by: str, mode: str) -> None:
        """Write rows that lie by their slots."""
        # Neighbours in a slot differ in their last letters: delta encoding stores only those.
        sorted_rows = placed.sortWithinPartitions("slot", by).write.mode(mode).partitionBy("slot").option("compression", "zstd")
        sorted_rows = sorted_rows.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
        with freed(self.spark):
            sorted_rows.parquet(f"{self.path}/{name}")

    def _read(self, name: str, pos_type: str) -> DataFrame:
        columns = {"texts": f"text string, whole boolean, key_pos {pos_type}", "keys": f"key string, key_pos {pos_type}"}[name]
        return self.spark.read.schema(f"{columns}, slot int").parquet(f"{self.path}/{name}")

    def _lookup(self, ids: DataFrame, exact: Sequence[Column], contains: Column | None) -> DataFrame:
        shape = self.spark.read.schema("slots int, pos_type string, lengths array<int>").parquet(f"{self.path}/shape")
        slots, pos_type = shape.select("slots", "pos_type").first()
        wanted, _ = _asked(ids, exact, contains, shape.select("lengths").scalar())
        few = wanted.count() <= BROADCAST_TEXTS
        sent = F.broadcast if few else (lambda frame: frame)
        # Slots are never negative. Spark prunes partitions only by a side that has a filter.
        texts = wanted.select("text", "whole").distinct().withColumn("slot", _slot("text", slots)).where("slot >= 0")
        first = self._read("texts", pos_type).join(sent(texts), ["slot", "text", "whole"])
        best = wanted.join(first, ["text", "whole"]).groupBy("request_id").agg(F.min(F.struct("tier", "key_pos")).alias("best"))
        # As many rows as requests at most, of which each has asked for a text at least.
        best = best.select("request_id", "best.tier", "best.key_pos").withColumn("slot", _slot("key_pos", slots)).where("slot >= 0")
        best = self._read("keys", pos_type).join(sent(best), ["slot", "key_pos"])
        return ids.join(best.select("request_id", "key", "tier"), "request_id", "left").select("request_id", "key", "tier")


def _slot(column: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")


def ranked_lookup(
    requests: DataFrame,
    keys: DataFrame | KeyIndex,
    exact: Sequence[Column],
    contains: Column | None = None,
) -> DataFrame:
    """Key found for each request: ``request_id, key, tier`` with NULLs when nothing matches.

    ``requests`` has ``request_id``; ``keys`` has ``key`` and an orderable ``key_pos`` that occurs
    once. A key may repeat under several positions; its first one counts.
    ``exact`` are expressions over ``request_id`` tried in order as tiers 0, 1, ...; ``contains`` is
    an array expression whose elements are the containment tiers that follow: a key that contains the
    element or is contained in it. Empty texts never match by containment.
    Keys that are asked for again and again can be a :class:`KeyIndex`; the rows are the same.
    """
    ids = requests.select("request_id").distinct()
    if isinstance(keys, KeyIndex):
        return keys._lookup(ids, exact, contains)
    keys = keys.select("key", "key_pos")
    wanted, probes = _asked(ids, exact, contains, _lengths(keys, "key"))
    rows = wanted.count()
    few = rows <= BROADCAST_TEXTS
    if not few:
        keys = _neighbours(stored(keys))
    pieces = keys.select("key", "key_pos", F.col("key").alias("text"), F.lit(True).alias("whole"))
    if probes is not None:
        pieces = _cuts(keys.withColumn("_lengths", _lengths(probes, "probe")))
    if few:
        pieces = pieces.join(F.broadcast(wanted.select("text", "whole").distinct()), ["text", "whole"], "left_semi")
    # Only the place is aggregated: a fixed-width buffer keeps this a hash aggregation. The keys found are few.
    first = pieces.groupBy("text", "whole").agg(F.min("key_pos").alias("key_pos"))
    met = (wanted if few else wanted.hint("merge")).join(first, ["text", "whole"])
    if not few:
        # Short texts take many times their compressed bytes when they are sorted or sent: their number decides how many tasks get them.
        met = met.repartition(rows // TASK_TEXTS + 1, "request_id")
    best = met.groupBy("request_id").agg(F.min(F.struct("tier", "key_pos")).alias("best"))
    best = best.select("request_id", "best.tier", "best.key_pos").join(keys, "key_pos").select("request_id", "key", "tier")
    return ids.join(best, "request_id", "left").select("request_id", "key", "tier")


def _neighbours(keys: DataFrame) -> DataFrame:
    """Stored keys, dealt by their order to as many tasks as their number needs: neighbours share most of their parts."""
    return keys.repartitionByRange(keys.count() // TASK_KEYS + 1, "key")


def _cuts(keys: DataFrame) -> DataFrame:
    """``key, key_pos, text, whole`` and further columns: each key as it is (length 0 stands for that) and its substrings of the lengths in ``_lengths``."""
    size, n = F.length("key"), F.col("_n")
    keep = [c for c in keys.columns if c not in ("key", "key_pos", "_lengths")]
    fitting = F.array_append(F.filter("_lengths", lambda x: (x > 0) & (x <= size)), F.lit(0))
    places = F.sequence(F.lit(1), F.when(n == 0, 1).otherwise(size - n + 1))
    cut = keys.select(*keep, "key", "key_pos", F.explode(fitting).alias("_n")).select(*keep, "key", "key_pos", "_n", F.explode(places).alias("_i"))
    text = F.when(n == 0, F.col("key")).otherwise(F.substr("key", F.col("_i"), n))
    return cut.select(*keep, "key", "key_pos", text.alias("text"), (n == 0).alias("whole"))


def feature_lookup(requests: DataFrame, keys: DataFrame | KeyIndex) -> DataFrame:
    """Building whose features answer a request: the id, its number, then containment with the
    number as it is, without leading zeros, and padded to 16."""
    number = numeric_id(F.col("request_id"))
    return ranked_lookup(requests, keys, [F.col("request_id"), number], padding_variants(number))


def pair_lookup(requests: DataFrame, keys: DataFrame | KeyIndex) -> DataFrame:
    """Building whose pairs answer a request: its number, then containment with the number."""
    number = numeric_id(F.col("request_id"))
    return ranked_lookup(requests, keys, [number], F.array(number))


def file_lookup(requests: DataFrame, files: DataFrame, prefer_exact: bool = False) -> DataFrame:
    """Metrics record for each requested file path: the first record, in order, whose name equals,
    contains or is contained in the base name. ``prefer_exact`` lets an equal name win.

    ``requests`` has ``request_id``; ``files`` has ``file_name`` and ``file_pos``.
    """
    name = base_name(F.col("request_id"))
    keys = files.select(F.col("file_name").alias("key"), F.col("file_pos").alias("key_pos"))
    return ranked_lookup(requests, keys, [name] if prefer_exact else [], F.array(name))


def request_probes(requests: DataFrame, *keep: str) -> DataFrame:
    probe = F.array_distinct(F.array("request_id", numeric_id(F.col("request_id"))))
    return requests.select("request_id", *keep).distinct().select("request_id", *keep, F.explode(probe).alias("alias"))


def object_lookup(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """Object that a building id stands for inside one file: ``request_id, file_path, object_id``.

    An object matches when its id is the request or the request's number, or when its own digit run
    is that number; the first one in the file wins. Not found, or found empty, gives a NULL id.
    ``requests`` has ``request_id, file_path``. A path that both sources list is one file: its first source counts.
    """
    probes = request_probes(requests, "file_path")
    named = objects.select("source", "file_path", "obj_pos", "object_id", "is_empty", F.explode(own_aliases(F.col("object_id"))).alias("alias"))
    first = (
        named.join(probes.select("file_path", "alias").distinct(), ["file_path", "alias"], "left_semi")
        .groupBy("file_path", "alias")
        .agg(F.min(F.struct("source", "obj_pos", "object_id", "is_empty")).alias("hit"))
    )
    found = (
        probes.join(first, ["file_path", "alias"], "left")
        .groupBy("request_id", "file_path")
        .agg(F.min("hit").alias("hit"))
    )
    return found.select(
        "request_id", "file_path", F.when(~F.col("hit.is_empty"), F.col("hit.object_id")).alias("object_id")
    )


def find_file(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """File that holds a building: ``request_id, source, file_path, object_id``, NULLs when none does.

    Source A is searched before Source B, files by path, objects in file order.
    """
    probes = request_probes(requests)
    named = objects.select("source", "file_path", "obj_pos", "object_id", F.explode(own_aliases(F.col("object_id"))).alias("alias"))
    first = (
        named.join(probes.select("alias").distinct(), "alias", "left_semi")
        .groupBy("alias")
        .agg(F.min(F.struct("source", "file_path", "obj_pos", "object_id")).alias("hit"))
    )
    return (
        probes.join(first, "alias", "left")
        .groupBy("request_id")
        .agg(F.min("hit").alias("hit"))
        .select("request_id", "hit.source", "hit.file_path", "hit.object_id")
    )


def shared_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose number also occurs in ``right``; both have ``building_id``."""
    return _by_number(left, right, "left_semi")


def unshared_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose number does not occur in ``right``."""
    return _by_number(left, right, "left_anti")


def _by_number(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    numbers = right.select(numeric_id(F.col("building_id")).alias("_number")).distinct()
    return left.withColumn("_number", numeric_id(F.col("building_id"))).join(numbers, "_number", how).drop("_number")
