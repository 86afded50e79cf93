"""City tables that are kept up to date by version key: a refresh reads and parses new and changed files only.

A refresh is one generation. It writes the rows of new and changed files below ``generation=N`` of each table, in slots by a hash
of the file, and the manifest of that generation last. The manifest names every file that is there, with its version key and the
generation that holds its rows; rows of other generations do not count. So a reader sees a generation as a whole or not at all, a refresh
that broke off is repeated under the same number, and rows of unchanged files are never rewritten until :func:`compact`.

One refresh of a target runs at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.sources import cityjson
from geomatch.storage import stored

#: Part of the layout of a target: tables of one target must have the same.
SLOTS = 64
#: So many changed files are read by their paths; more are found by reading the source roots.
PATHS_AT_ONCE = 10_000
FILE = ["source", "file_path"]
_MANIFEST = "source string, file_path string, version_key string, in_generation bigint"


def _folder(target: str, name: str, generation: int | None = None) -> str:
    top = f"{target.rstrip('/')}/{name}"
    return top if generation is None else f"{top}/generation={generation}"


def newest(spark: SparkSession, target: str) -> int:
    """Number of the newest finished generation, 0 if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = path(_folder(target, "manifest"))
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(top)]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("generation=")]
    return max((n for n in numbers if files.exists(path(f"{_folder(target, 'manifest', n)}/_SUCCESS"))), default=0)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """``source, file_path, version_key, in_generation`` of the files in the newest generation."""
    if not (generation := newest(spark, target)):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(_folder(target, "manifest", generation))


def changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """``source, file_path, version_key, in_generation, state``: what became of each file of a listing (``source, file_path,
    version_key``) or a manifest: ``new``, ``changed``, ``removed`` or ``same``.

    A file that is listed twice counts once, with its greater key. Two files without a key are the same.
    """
    now = listing.groupBy(*FILE).agg(F.max("version_key").alias("_now"), F.lit(True).alias("_is"))
    was = known.select(*FILE, F.col("version_key").alias("_was"), "in_generation")
    state = (
        F.when(F.col("_is").isNull(), "removed")
        .when(F.col("in_generation").isNull(), "new")
        .when(F.col("_now").eqNullSafe(F.col("_was")), "same")
        .otherwise("changed")
    )
    return now.join(was, FILE, "full_outer").select(
        *FILE, F.coalesce("_now", F.when(F.col("_is").isNull(), F.col("_was"))).alias("version_key"), "in_generation", state.alias("state")
    )


def _slot(source: Column, file_path: Column) -> Column:
    return F.pmod(F.xxhash64(source, file_path), F.lit(SLOTS)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    # Rebalanced by slot: small slots share a task, a large one is split.
    slotted = rows.withColumn("slot", _slot(F.col("source"), F.col("file_path"))).hint("rebalance", F.col("slot"))
    slotted.write.mode("overwrite").partitionBy("slot").parquet(path)


def _publish(rows: DataFrame, target: str, generation: int) -> None:
    rows.select(*FILE, "version_key", F.col("in_generation").cast("bigint")).write.mode("overwrite").parquet(_folder(target, "manifest", generation))


def refresh(spark: SparkSession, listing: DataFrame, read: Callable[[DataFrame], DataFrame], target: str) -> DataFrame:
    """Bring the tables below ``target`` to the state of a listing (``source, file_path, version_key``); the :func:`changes` that it found.

    ``read`` takes the wanted files (``source, file_path``) and gives their texts (``source, file_path, document``); it may give others
    too, which are left out. Where nothing has changed, nothing is written.
    """
    found = stored(changes(listing.select(*FILE, "version_key"), manifest(spark, target)))
    if found.where("state <> 'same'").isEmpty():
        return found
    generation = newest(spark, target) + 1
    wanted = found.where("state IN ('new', 'changed')").select(*FILE)
    documents = stored(read(wanted).join(wanted, FILE, "left_semi").select(*FILE, "document"))
    for name, make in cityjson.TABLES.items():
        _write(make(documents), _folder(target, name, generation))
    here = F.when(F.col("state") == "same", F.col("in_generation")).otherwise(F.lit(generation)).alias("in_generation")
    _publish(found.where("state <> 'removed'").select(*FILE, "version_key", here), target, generation)
    return found


def read_table(spark: SparkSession, target: str, name: str, source: str | None = None, file_path: str | None = None) -> DataFrame:
    """A table of the newest generation (a name of ``cityjson.TABLES``), of one file where ``source`` and ``file_path`` are given: then
    only one slot is read."""
    texts = spark.createDataFrame([], "source string, file_path string, document string")
    schema = cityjson.TABLES[name](texts).schema
    files = manifest(spark, target)
    if not newest(spark, target):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema.add("generation", "long").add("slot", "integer")).parquet(_folder(target, name))
    if file_path is not None:
        one = (F.col("source") == source) & (F.col("file_path") == file_path)
        rows, files = rows.where(one & (F.col("slot") == _slot(F.lit(source), F.lit(file_path)))), files.where(one)
    live = files.select(*FILE, F.col("in_generation").alias("generation"))
    return rows.join(live, [*FILE, "generation"], "left_semi").drop("generation", "slot")


def compact(spark: SparkSession, target: str) -> None:
    """Write all rows that count as one generation. Older ones are not read any more and may be deleted when nobody reads them."""
    if not (last := newest(spark, target)):
        return
    for name in cityjson.TABLES:
        _write(read_table(spark, target, name), _folder(target, name, last + 1))
    _publish(manifest(spark, target).withColumn("in_generation", F.lit(last + 1)), target, last + 1)


def changed_texts(spark: SparkSession, roots: Mapping[str, str], data_root: str, at_once: int = PATHS_AT_ONCE) -> Callable[[DataFrame], DataFrame]:
    """A ``read`` for :func:`refresh`: the texts of files below the source roots, with paths as ``catalog.list_files`` gives them.

    Up to ``at_once`` wanted files are opened by their paths, and no others; beyond that the roots are read.
    """

    def read(wanted: DataFrame) -> DataFrame:
        plain = F.regexp_replace("file_path", r"([\\\[\]{}*?])", r"\\$1")
        outside = F.col("file_path").startswith("/") | F.col("file_path").contains("://")
        path = F.when(outside, plain).otherwise(F.concat(F.lit(data_root.rstrip("/") + "/"), plain))
        few = wanted.select("source", path.alias("path")).limit(at_once + 1).collect()
        if len(few) > at_once:
            return cityjson.read_documents(spark, roots, data_root)
        by_source: dict[str, list[str]] = {}
        for row in few:
            by_source.setdefault(row.source, []).append(row.path)
        if not by_source:
            return spark.createDataFrame([], "source string, file_path string, document string")
        return cityjson.read_documents(spark, by_source, data_root)

    return read
