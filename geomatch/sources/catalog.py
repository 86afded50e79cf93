"""File catalogue: listing, choice of source roots, request resolution, version keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomatch.constants import CITY_FOLDER, NAME_LOOKUP_FOLDERS, SOURCE_ROOTS
from geomatch.functions.ids import base_name
from geomatch.storage import stored

#: Requested paths that one task resolves.
TASK_REQUESTS = 50_000


def _plain_uri(path: Column) -> Column:
    """``file:/x`` and ``file:///x`` as ``/x``; other schemes keep their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def relative_path(path: Column, data_root: str) -> Column:
    """Path below the data root; the full path for files outside it."""
    root = data_root.rstrip("/") + "/"
    plain = _plain_uri(path)
    return F.when(plain.startswith(root), F.substr(plain, F.lit(len(root) + 1))).otherwise(plain)


def version_key(path: Column, mtime: Column) -> Column:
    """Fingerprint that changes when the file at ``path`` is rewritten."""
    return F.md5(F.concat_ws("_", path, F.unix_micros(mtime).cast("string")))


def list_files(spark: SparkSession, root: str, data_root: str | None = None, pattern: str = "*.json") -> DataFrame:
    """Files below ``root``, recursively. Only the listing is read, never the contents."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return found.select(
        F.substring_index("path", "/", -1).alias("file_name"),
        relative_path(F.col("path"), data_root or root).alias("path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    ).withColumn("version_key", version_key(F.col("path"), F.col("mtime")))


def file_catalog(
    spark: SparkSession,
    data_root: str,
    roots: Mapping[str, str] | None = None,
    pattern: str = "*.json",
) -> DataFrame:
    """Catalogue of both sources. ``roots`` names the source roots; without it they are chosen below
    the data root by :func:`assign_sources`."""
    if roots is None:
        return assign_sources(list_files(spark, data_root, data_root, pattern))
    parts = [
        list_files(spark, root, data_root, pattern).withColumn("source", F.lit(source))
        for source, root in roots.items()
    ]
    catalog = parts[0]
    for part in parts[1:]:
        catalog = catalog.unionByName(part)
    return catalog.select("source", "file_name", "path", "size", "mtime", "version_key")


def assign_sources(listing: DataFrame, roots: Mapping[str, Sequence[str]] = SOURCE_ROOTS) -> DataFrame:
    """Give every listed file (``path`` relative to the data root) its sources.

    Each source takes the first of its roots that holds a file. The data root itself is the last
    choice, so a file can belong to both sources.
    """

    def rank(choices: Sequence[str]) -> Column:
        chain = None
        for i, root in enumerate(choices):
            inside = F.col("path").startswith(root.rstrip("/") + "/") if root else F.lit(True)
            chain = F.when(inside, i) if chain is None else chain.when(inside, i)
        return chain

    parts = []
    for source, choices in roots.items():
        ranked = listing.withColumn("_root", rank(choices))
        chosen = ranked.agg(F.min("_root")).scalar()
        parts.append(
            ranked.where(F.col("_root") == chosen).drop("_root").withColumn("source", F.lit(source))
        )
    catalog = parts[0]
    for part in parts[1:]:
        catalog = catalog.unionByName(part)
    others = [c for c in listing.columns if c != "source"]
    return catalog.select("source", *others)


def decode_path(path: Column) -> Column:
    """Percent-decoding that keeps ``+`` and malformed escapes as they are."""
    kept = F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), path)


def resolve_paths(
    requests: DataFrame,
    catalog: DataFrame,
    mode: str = "get",
    city_folder: str = CITY_FOLDER,
    folders: Sequence[str] = NAME_LOOKUP_FOLDERS,
) -> DataFrame:
    """File that each requested path stands for: ``request_path, path, priority``.

    ``requests`` has ``request_path``. Candidate paths are tried in order: the path itself, its base
    name in each source folder (``mode='get'`` only), the path below the city folder. Requests that
    match nothing keep a NULL ``path``. Each candidate is an equality, so the lookup is one equi-join.
    """
    if mode not in ("get", "select"):
        raise ValueError(f"unknown mode {mode!r}")

    def tries(path: Column) -> Column:
        wanted = decode_path(path) if mode == "get" else path
        names = [F.concat(F.lit(f"{city_folder}/{f}/"), base_name(wanted)) for f in folders]
        below = F.when(wanted.startswith("/"), wanted).otherwise(F.concat(F.lit(f"{city_folder}/"), wanted))
        return F.array(wanted, *(names if mode == "get" else []), below)

    asked = stored(requests.select("request_path").distinct())
    # Short texts take many times their compressed bytes in a task: their number decides how many tasks get them.
    tasks = asked.count() // TASK_REQUESTS + 1
    wanted = asked.repartition(tasks, "request_path").select("request_path", F.posexplode(tries(F.col("request_path"))).alias("priority", "path"))
    # The stored requests are small as bytes, so Spark would send all their tries to every task; both sides are shuffled instead.
    # Only the number of the try is aggregated, in a fixed-width buffer; it tells the path.
    hits = wanted.join(catalog.select("path").distinct().hint("merge"), "path").groupBy("request_path").agg(F.min("priority").alias("priority"))
    found = F.get(tries(requests["request_path"]), hits["priority"])
    return requests.repartition(tasks, "request_path").join(hits, "request_path", "left").select(
        *[requests[c] for c in requests.columns], found.alias("path"), hits["priority"]
    )
