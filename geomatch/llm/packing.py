"""Best-fit packing of documents into sequences, with certified bin counts.

A document's ids, ended by id 2, are one piece, or pieces of ``CAPACITY`` ids if it is longer; only its first piece may then be
shorter. Full pieces are sequences of their own. All others are dealt to tasks of ``task_rows`` pieces; each
task packs its own by best-fit decreasing. Dual feasible functions of the piece lengths give a lower bound of the sequences that any
packing needs. A task whose count equals its bound is certified. While the total is above the bound of all lengths together,
tasks exchange documents: the pieces of sequences with room (in a certified task, of its emptiest one only) are dealt anew, more of
them to a task, and packed again; a round that saves nothing ends the exchange and is discarded.

What comes to the driver is one count for each length and round. A task holds at most about ``task_rows`` rows of
numbers; texts stay where they are read.

Defined cases. A null or empty text is one piece, id 2 alone. Rows that repeat are packed each; a null doc_id stays null. An empty table gives an empty
table. Ties in length are packed in the order in which they are dealt; sequence numbers carry no meaning.
Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geomatch.llm.common import arrow_map
from geomatch.storage import stored

CAPACITY = 1024
END_ID = 2
TASK_ROWS = 200_000
VOCABULARY = "byte_bpe_50k.json"


class Ids:
    """Token ids of whole texts.

    The encoder of ``tiktoken``, given the ranks of the vocabulary file, makes the same ids as that of ``tokenizers`` in under half the
    time (a test compares them). Only texts that hold the string of an added token need the latter.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {c: bytes([b]) for b, c in _byte_letters().items()}
        ranks = {b"".join(map(byte_of.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.added}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*own}))}


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    path = path or public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], dtype="<u4")

    def make():
        ids = Ids(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                data = memoryview(np.concatenate([ids.of(text or ""), end])).cast("B")
                total = len(data) // 4
                first = total % capacity or capacity
                for piece, stop in enumerate(range(first, total + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        return work

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that no packing can go below: the best of two families of dual feasible functions.

    Such a function keeps the sum of every full sequence within the capacity, so the sum over all pieces, divided by the
    capacity, is a bound.
    """
    if not len(lengths):
        return 0
    x, n, best = lengths.astype(np.int64), counts.astype(np.int64), 0
    # Pieces below t are left out; pieces that leave less than t fill a sequence.
    for t in range(1, capacity // 2 + 1):
        value = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, -(-int((value * n).sum()) // capacity))
    # Lengths are rounded down to multiples of 1/k of the capacity, in units of 1/(k + 1).
    for k in range(1, 64):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the room left in each sequence, by best-fit decreasing."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a sequence has room r
    left: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(left)
            left.append(capacity)
        sequence[i], offset[i] = at, capacity - room
        room -= size
        left[at] = room
        if room:
            with_room[room].append(at)
            rooms |= 1 << room
    return sequence, offset, np.array(left, dtype=np.int64)


def _packed(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Each task packs its rows; ``open`` marks what it offers for exchange, ``first`` one row of each sequence."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.select(names) for b in batches] or [])
        if not table.num_rows:
            return
        lengths = table["length"].to_numpy()
        sequence, offset, left = best_fit(lengths, capacity)
        certified = len(left) == lower_bound(*np.unique(lengths, return_counts=True), capacity)
        offered = left == left.max() if certified else left > 0
        offered &= left > 0
        if certified:
            offered[np.flatnonzero(offered)[1:]] = False
        number = (turn << 56) + (TaskContext.get().partitionId() << 32) + sequence
        table = table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        table = table.append_column("open", pa.array(offered[sequence])).append_column("first", pa.array(offset == 0))
        yield from table.combine_chunks().to_batches()

    def guarded(batches):
        first = next(batches, None)
        return run(iter(())) if first is None else run(b for b in (first, *batches))

    return rows.select(*names).mapInArrow(guarded, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean, first boolean")


def pack(rows: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces."""
    full, short = rows.filter(F.col("length") == capacity), rows.filter(F.col("length") < capacity)
    names = [*rows.columns, "sequence_id", "offset"]
    done = [full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}).select(names)]
    turn, waiting, n = 0, short, short.count()
    best: DataFrame | None = None
    best_count = 0
    while n:
        now = stored(_packed(waiting.repartition(max(1, -(-n // task_rows))), capacity, turn))
        lengths = now.groupBy("length").agg(F.count("*").alias("n")).toPandas()
        bound = lower_bound(lengths.length.to_numpy(), lengths.n.to_numpy(), capacity)
        count, n_open = now.agg(F.count_if("first"), F.count_if("open")).first()
        if best is not None and count >= best_count:
            done.append(best.select(names))
            break
        if count == bound or not n_open or n <= task_rows:
            done.append(now.select(names))
            break
        done.append(now.filter("not open").select(names))
        best = waiting = now.filter("open")
        best_count = waiting.agg(F.count_if("first")).first()[0]
        # Offers of many tasks meet in fewer, so that each sees other lengths than before.
        turn, n = turn + 1, n_open
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row."""
    return pack(stored(pieces(docs, capacity, path)), capacity, task_rows)
