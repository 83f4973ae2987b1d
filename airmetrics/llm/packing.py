"""Bounded-space online packing of tokenized documents into training sequences.

Each input partition is packed on its own while its documents stream by. A document of at least
one whole sequence is cut there; its full pieces are sequences of their own. The rest goes to the
open window it fills best. When none fits, the fullest window is emitted and a new one opened, so
a partition never holds more than ``open_windows`` of them. Windows still open at the end of the
partitions are leftovers; they are merged with one another, whole windows at a time.

Defined results: a document without text consists of the end id alone; equal documents and ids
are packed like any others, each row on its own; an empty table gives no piece. Only ``doc_id``
and ``text`` are read. The pieces of the first pass are stored before leftovers are merged, so a
lost executor cannot pack a document in two ways.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from airmetrics.llm.common import release_memory, stored
from airmetrics.llm.tokens import encoder

SEQUENCE_TOKENS = 4096
OPEN_WINDOWS = 64
END_ID = 2
#: Leftover windows that one task merges.
MERGE_WINDOWS = 4096
#: A task hands pieces on when their ids reach so many bytes.
OUT_BYTES = 8 << 20
_MERGED = 1 << 62


class OpenWindows:
    """At most ``limit`` open windows; ``place`` gives the window, its offset, and one closed by it."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []
        self.count = 0

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def place(self, length: int) -> tuple[int, int, int | None]:
        at, closed = bisect_left(self.free, (length, -1)), None
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                closed = self.free.pop(0)[1]
            room, window = self.capacity, self.new()
        if room > length:
            insort(self.free, (room - length, window))
        else:
            closed = window
        return window, self.capacity - room, closed


def _first_pass(vocabulary: str, capacity: int, open_windows: int, end_id: int, id_type: pa.DataType, with_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset"] + ["ids"] * with_ids
    types = [id_type] + [pa.int64()] * 6 + [pa.binary()] * with_ids
    schema = pa.schema(list(zip(names + ["origin", "closed"], types + [pa.int64(), pa.bool_()])))

    def pack(batches):
        release_memory()
        encode = encoder(vocabulary)
        windows = OpenWindows(capacity, open_windows)
        origin = TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = {}

        def table(rows: list[tuple], closed: bool) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            columns += [pa.array([origin] * len(rows), pa.int64()), pa.array([closed] * len(rows), pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        done: list[tuple] = []
        size = 0
        for batch in batches:
            # One text at a time: a batch may hold very long ones.
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encode(text.as_py()) + end
                doc_id, total = doc_id.as_py(), len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    row = (doc_id, start, length, zlib.crc32(piece), total)
                    kept = (piece,) if with_ids else ()
                    if length == capacity:
                        done.append((*row, windows.new(), 0, *kept))
                    else:
                        window, offset, closed = windows.place(length)
                        waiting.setdefault(window, []).append((*row, window, offset, *kept))
                        if closed is not None:
                            done += waiting.pop(closed)
                    size += len(piece)
                    if size >= OUT_BYTES and done:
                        yield table(done, True)
                        done, size = [], 0
        if done:
            yield table(done, True)
        if rest := [row for rows in waiting.values() for row in rows]:
            yield table(rest, False)

    return pack, schema


def _merge(capacity: int):
    """Leftover windows of a task, longest first, each to the merged window it fills best."""

    def merge(frames):
        rows = [row for frame in frames for row in zip(frame.origin, frame.window, frame.length)]
        windows = OpenWindows(capacity, len(rows))
        out: dict[str, list[int]] = {"origin": [], "window": [], "sequence_id": [], "base": []}
        first = _MERGED + (TaskContext.get().partitionId() << 32)
        for origin, window, length in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            place, base, _ = windows.place(int(length))
            for name, value in zip(out, (origin, window, first + place, base)):
                out[name].append(value)
        import pandas as pd

        yield pd.DataFrame(out, dtype="int64")

    return merge


def pack(
    documents: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    capacity: int = SEQUENCE_TOKENS,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit numbers."""
    kept = documents.select("doc_id", "text")
    id_type = kept.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    run, _ = _first_pass(vocabulary, capacity, open_windows, end_id, arrow_id, with_ids)
    schema = (
        f"doc_id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, window long, "
        "offset long, " + "ids binary, " * with_ids + "origin long, closed boolean"
    )
    pieces = stored(kept.mapInArrow(run, schema), "pieces")
    left = pieces.where("not closed")
    sizes = stored(left.groupBy("origin", "window").agg(F.sum("length").alias("length")), "leftovers")
    tasks = -(-sizes.count() // MERGE_WINDOWS) or 1
    merged = stored(
        sizes.repartition(tasks, "origin", "window").mapInPandas(
            _merge(capacity), "origin long, window long, sequence_id long, base long"
        ),
        "merged",
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    closed = pieces.where("closed").withColumn("sequence_id", F.shiftleft("origin", 36) + F.col("window"))
    joined = left.join(merged, ["origin", "window"]).withColumn("offset", F.col("offset") + F.col("base"))
    return closed.select(*columns).unionByName(joined.select(*columns))
