"""One results document of any size, read by many tasks.

A whole JSON text is one row of one task. Here a document is read in fragments instead, cut at every ``}``: that is one byte, so
Spark splits the file anywhere. What a fragment means depends on all text before it: whether it starts inside a string, and how many brackets
are open. Both are prefix sums (quotes modulo two, brackets), taken in two levels: inside a split by a window, and over the splits on the
driver, which holds a few numbers for each split as it holds the splits themselves. A fragment is therefore counted for both states in which its split may start.

Fragments up to the end of a building's object are one segment, made whole again in one row and parsed alone; so a task holds one building's list at a time. What
follows the last segment's end in a split is read with the split where it goes on, its home, so texts are shuffled once for segments, parsing and the prefix sums that number
files and buildings.

A document may also lie in several parts, which follow each other by path and are each cut after a ``}``; :func:`write_fragments` writes them so, compressed.
A compressed part is read whole by one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geomatch.functions.objects import dict_entries
from geomatch.sources.results import RESULTS
from geomatch.storage import remove, scratch, stored

_CUT = "}"


def write_fragments(fragments: DataFrame, path: str) -> None:
    """Write ordered texts (column ``text``) as parts of one document, each followed by ``}``. A partition is one part, which one task reads."""
    fragments.select("text").write.option("lineSep", _CUT).option("compression", "gzip").text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """``part, block, at, text``: place of a fragment by file, split and order in it, and its text without the ``}``."""
    return spark.read.option("lineSep", _CUT).text(path).select(
        F.col("_metadata.file_path").alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
    )


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _opened(text: Column) -> Column:
    return _count(text, "{[") - _count(text, "}]")


def _with_sums(fragments: DataFrame) -> DataFrame:
    """Adds ``quotes``, and ``depth0``, ``depth1``: brackets open after a fragment if its split starts outside and inside a string, each from the start of the split."""
    plain = fragments.select("*", F.regexp_replace("text", r"(?s)\\.", "").alias("plain"))
    # Between its quotes a text is outside and inside strings by turns: what is not outside in one state is so in the other.
    outside = plain.select("*", F.regexp_replace("plain", '(?s)"[^"]*("|$)', "").alias("outside"))
    counted = outside.select("part", "block", "at", "text", _count(F.col("plain"), '"').alias("own"), _opened(F.col("plain")).alias("all"), _opened(F.col("outside")).alias("even"))
    order = Window.partitionBy("part", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("quotes", F.sum("own").over(order))
    before = F.col("quotes") - F.col("own")

    def change(start: int) -> Column:
        opened = F.when((before + start) % 2 == 0, F.col("even")).otherwise(F.col("all") - F.col("even"))
        closed = F.when((F.col("quotes") + start) % 2 == 0, 1).otherwise(0)
        return opened - closed

    changes = placed.select("part", "block", "at", "text", "quotes", change(0).alias("change0"), change(1).alias("change1"))
    return changes.select("part", "block", "at", "text", "quotes", *[F.sum(f"change{s}").over(order).alias(f"depth{s}") for s in (0, 1)], "change0", "change1")


def _starts(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """One row for each split or home, with what comes before it."""
    return F.broadcast(spark.createDataFrame(rows, columns))


def _before(numbers: list[int]) -> list[int]:
    return [0, *accumulate(numbers)][:-1]


def _homes(ends: list[int]) -> list[int]:
    """For each split the next one with an end, to which what follows its own last end belongs; one beyond the last split if there is none."""
    homes, home = [], len(ends)
    for i in reversed(range(len(ends))):
        homes.append(home)
        home = i if ends[i] else home
    return homes[::-1]


def _segments(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``home, segment, document, started``: texts that hold at most one building each, closed so that each is a results document by
    itself, in the order of homes and of segments in a home. ``started`` tells how many brackets were open before it: with two, its file's name is given in an
    earlier segment. Rows lie by home. Also the path of the table that they are made from."""
    fragments = stored(_with_sums(_fragments(spark, path)), path=(kept := scratch(spark)), dense=True)
    keys = ["part", "block"]
    splits = fragments.groupBy(*keys).agg(*[F.max_by(c, "at").alias(c) for c in ("quotes", "depth0", "depth1")]).orderBy(*keys).collect()
    inside = [n % 2 for n in _before([s.quotes for s in splits])]
    depth = _before([s.depth1 if i else s.depth0 for s, i in zip(splits, inside)])
    starts = [(s.part, s.block, i, *more) for i, (s, *more) in enumerate(zip(splits, inside, depth))]
    placed = fragments.join(_starts(spark, starts, "part string, block bigint, split bigint, inside bigint, open bigint"), keys)
    of = lambda name: F.when(F.col("inside") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    ended = F.col("open") + of("depth")
    ends = (ended <= 2) & ((F.col("quotes") + F.col("inside")) % 2 == 0)
    placed = placed.select("split", "at", "text", ended.alias("ended"), (ended - of("change")).alias("started"), ends.cast("int").alias("ends"))
    last = {r.split: r.last for r in placed.where("ends = 1").groupBy("split").agg(F.max("at").alias("last")).collect()}
    homes = [(i, last.get(i, -1), home) for i, home in enumerate(_homes([i in last for i in range(len(splits))]))]
    home = F.when(F.col("at") <= F.col("last"), F.col("split")).otherwise(F.col("next"))
    rows = placed.join(_starts(spark, homes, "split bigint, last bigint, next bigint"), "split").withColumn("home", home)
    order = Window.partitionBy("home").orderBy("split", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("home", "split", "at", "text", "started", "ended", (F.sum("ends").over(order) - F.col("ends")).alias("segment"))
    place = F.struct("split", "at")
    whole = rows.groupBy("home", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "text"))), lambda x: x["text"]), _CUT).alias("text"),
        F.min_by("started", place).alias("started"),
        F.max_by("ended", place).alias("ended"),
    )
    opened = F.when(F.col("started") == 2, '{"":{').when(F.col("started") == 1, "{").otherwise("")
    body = F.when(F.col("started") > 0, F.regexp_replace("text", r"^\s*,", "")).otherwise(F.col("text"))
    closed = F.concat(opened, body, F.lit(_CUT), F.repeat(F.lit(_CUT), F.greatest("ended", F.lit(0))))
    return whole.select("home", "segment", "started", closed.alias("document")), kept


def result_buildings(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`geomatch.sources.results.result_buildings` for one document, in parts or whole, of any size. They come from a
    stored table: the document is not read any more."""
    segments, kept = _segments(spark, path)
    parsed = segments.select("home", "segment", "started", F.from_json("document", RESULTS).alias("files"))
    entries = parsed.select("home", "segment", "started", dict_entries(F.col("files")).alias("entries"))
    news = F.when(F.col("started") < 2, F.size("entries")).otherwise(0)
    own = entries.select(
        "home", "segment", "started", "entries", news.cast("bigint").alias("files"),
        F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + F.greatest(F.coalesce(F.size(e["value"]), F.lit(0)), F.lit(0))).alias("buildings"),
    )
    order = Window.partitionBy("home").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = own.select("home", "started", "entries", *[F.sum(c).over(order).alias(f"{c}_to") for c in ("files", "buildings")], "files", "buildings")
    before = [(F.col(f"{c}_to") - F.col(c)).alias(c) for c in ("files", "buildings")]
    entry = summed.select("home", "started", *before, "files_to", "buildings_to", F.posexplode("entries").alias("i", "e"))
    entry = entry.select("home", "started", "files", "buildings", "files_to", "buildings_to", "i", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    entry = stored(entry, dense=True)
    remove(spark, kept)
    totals = entry.groupBy("home").agg(F.max("files_to").alias("files"), F.max("buildings_to").alias("buildings")).orderBy("home").collect()
    starts = list(zip([t.home for t in totals], _before([t.files for t in totals]), _before([t.buildings for t in totals])))
    entry = entry.join(_starts(spark, starts, "home bigint, files_before bigint, buildings_before bigint"), "home")
    file, building = F.col("files_before") + F.col("files"), F.col("buildings_before") + F.col("buildings")
    # In a segment that goes on with a file, that is the last file before it.
    number = F.when(F.col("started") == 2, file - 1).otherwise(file + F.col("i"))
    entry = entry.select(number.alias("file"), (F.col("started") < 2).alias("named"), building.alias("building"), "name", "value")
    # A repeated file keeps its first place and its last value.
    names = entry.where("named").select("file", "name", "building")
    # Stored, the files' size is known: where they are few, they are sent to the buildings.
    files = stored(names.groupBy("name").agg(F.min("file").alias("file_pos"), F.max("file").alias("file"), F.max_by("building", "file").alias("from")))
    rows = entry.select("file", "building", F.explode(dict_entries(F.col("value"))).alias("b")).join(files, "file")
    rows = rows.select(
        F.col("name").alias("file_name"), "file_pos", F.col("b.key").alias("building_id"),
        (F.col("building") + F.col("b.pos") - F.col("from")).cast("bigint").alias("bld_pos"), F.col("b.value.possible_matches").alias("matches"),
    )
    last = rows.groupBy("file_name", "file_pos", "building_id").agg(F.min("bld_pos").alias("bld_pos"), F.max_by(F.struct("matches"), "bld_pos").alias("last"))
    n = F.greatest(F.coalesce(F.size("last.matches"), F.lit(0)), F.lit(0)).cast("bigint")
    return last.select("file_name", "file_pos", "building_id", "bld_pos", n.alias("n_matches"), "last.matches")
