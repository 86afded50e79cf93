"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomatch.storage import shared_folder

PIECE_CHARS = 1 << 20
GROUP_CHARS = 1 << 18
BROADCAST_KEYS = 10_000
SLICE_ROWS = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BREAK = re.compile(rb"[ \t-\r]")
LETTERS = r"[^\W\d_]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``; a null id has no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def text_bytes(text: Column) -> Column:
    """A whole text as UTF-8."""
    return text.cast("binary")


def give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on after its task, next to those of other tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | T.StructType, rows: int = SLICE_ROWS
) -> DataFrame:
    """Apply a function to slices of the batches that Spark sends; ``make`` builds it once per task. Slices bound what a task
    holds as Python objects. Batches are made no longer than slices: a batch of whole texts stands in the executor's JVM and in the worker at once."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_ROWS)) <= SLICE_ROWS:
        conf.set(BATCH_ROWS, str(SLICE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := work(batch.slice(at, rows))) is not None:
                    yield out
        del work
        give_back()

    return df.mapInArrow(run, schema)


def new_folder(spark: SparkSession, what: str) -> str:
    """A URI below the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder in the shared storage, as a task sees it."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_pieces(texts: list[str | None], size: int = PIECE_CHARS, group: int = GROUP_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Whole texts in groups of about ``group`` characters: the row of each piece, and the pieces.

    A text longer than ``size`` is cut at white space, so that no word is cut; a word without end stays whole.
    """
    group = min(group, size)
    rows: list[int] = []
    pieces: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = at + size
            while end < len(text) and not text[end].isspace():
                end += 1
            rows.append(row)
            pieces.append(text[at:end] if at or end < len(text) else text)
            held += len(pieces[-1])
            at = end
            if held >= group:
                yield rows, pieces
                rows, pieces, held = [], [], 0
    if rows:
        yield rows, pieces


def text_of(batch: pa.RecordBatch) -> list[str | None]:
    """The texts of rows that travel as a struct ``row``."""
    return pc.struct_field(batch["row"], "text").to_pylist()


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> DataFrame:
    """The rows whose text a function keeps; rows travel as a struct, so no column can clash."""

    def build():
        keeps = make()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            return batch.filter(pa.array(keeps(text_of(batch)), pa.bool_()))

        return work

    rows = docs.select(F.struct("*").alias("row"))
    return arrow_map(rows, build, rows.schema).select("row.*")


def hashed_sample(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of each key, the first by a hash of ``doc_id``; keys of up to ``n`` rows are whole. Without
    keys, ``n`` rows of all.

    Rows are counted, then thinned by their hash to about twice ``n`` before they are ordered, so the ordering does not grow with the input.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    if not keys:
        return rows.filter(place * F.lit(rows.count()) < max(2 * n, 100)).orderBy(place, "doc_id").limit(n)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    # Keys are few (languages, classes): then their counts go to where the rows are read. Many are joined as they are.
    few = sizes.limit(BROADCAST_KEYS + 1).collect()
    if len(few) <= BROADCAST_KEYS:
        sizes = F.broadcast(rows.sparkSession.createDataFrame(few, sizes.schema))
    thin = rows.join(sizes, keys).filter(place * F.col("_rows") < max(2 * n, 100))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(place, "doc_id"))
    return thin.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank", "_rows")


def word_runs(data: bytes | None, size: int = PIECE_CHARS) -> Iterator[list[bytes]]:
    """The words of a whole text, A-Z in lower case, in lists of about ``size`` bytes of text each.

    Words are runs of bytes other than space and 0x09 to 0x0D, as ``bytes.split`` has them.
    """
    data = data or b""
    at = 0
    while at < len(data):
        found = _BREAK.search(data, at + size) if len(data) - at > size else None
        end = found.start() if found else len(data)
        yield data[at:end].lower().split()
        at = end
