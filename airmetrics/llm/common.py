"""Shared folders, words, shingles and hashes of the corpus operators.

A word is a run of letters, digits or underscores, lower-cased letter by letter. A shingle is five
words in a row; a text of one to four words is one shingle, a text without words has none.
All hashes are 64 bits wide and depend on the text alone, so every executor gets the same ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import shutil
import sys
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Longer texts are hashed in pieces of about so many characters, cut between words.
PIECE_CHARS = 1 << 20

#: Bytes of a text that are split into words at once.
SLICE_BYTES = 8 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here."""
    spark = frame.sparkSession
    folder = shared_folder(spark, purpose)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that :func:`shared_folder` named, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Hash buckets of ids that a broadcast may hold, whatever the number of ids.
ID_BUCKETS = 1 << 20


def maybe_among(frame: DataFrame, ids: DataFrame, key: str, maybe: bool = True) -> DataFrame:
    """Rows whose ``key`` may be among ``ids``, or with ``maybe=False`` those where it surely is not.

    Ids are reduced to the hash buckets they fall into, at most ``ID_BUCKETS`` numbers, so the
    broadcast has a fixed bound. It spares wide rows a shuffle when few ids matter; with very many
    ids all rows are "maybe", and the exact join that follows does the work.
    """
    def bucket(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(ID_BUCKETS)).cast("int")

    buckets = ids.select(bucket(F.col(key)).alias("_bucket")).distinct()
    how = "left_semi" if maybe else "left_anti"
    return frame.join(F.broadcast(buckets), bucket(frame[key]) == buckets["_bucket"], how)


def release_memory(cycles: bool = True) -> None:
    """Give memory that earlier tasks of this worker process have freed back to the system.

    Without ``cycles``, for steps that repeat in one task, objects that refer to one another are left.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it by the path the driver was given."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in known or any(f.endswith("airmetrics-py.zip") for f in context._python_includes):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/airmetrics-py", "zip", root, "airmetrics")
    context.addPyFile(archive)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case, and whether it belongs to a word."""
    size = sys.maxunicode + 1
    lower = np.arange(size, dtype=np.uint32)
    word = np.zeros(size, dtype=bool)
    for code in range(size):
        char = chr(code)
        if char.isalnum() or char == "_":
            word[code] = True
            small = char.lower()
            if small != char and len(small) == 1:
                lower[code] = ord(small)
    return lower, word


_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) < length:
        size = max(length, 1 << 16)
        for name, factor in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, np.uint64(factor))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _word_hashes(piece: str) -> np.ndarray:
    lower, word = _tables()
    codes = code_points(piece)
    if not len(codes):
        return np.empty(0, dtype=np.uint64)
    inside = np.zeros(len(codes) + 2, dtype=bool)
    inside[1:-1] = word[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(lower[codes].astype(np.uint64) * up[: len(codes)], out=total[1:])
    # The value of a word does not depend on where it stands.
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of bounded size, cut before blanks; only a longer word makes a longer piece."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b" ", at + 1, at + size), text.rfind(b"\t", at + 1, at + size))
        if cut < 0:
            ahead = (text.find(b" ", at + size), text.find(b"\t", at + size))
            cut = min((c for c in ahead if c > 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, in order."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    if len(text) <= PIECE_CHARS:
        return _word_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        parts.append(_word_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per shingle, in order; all words make one if they are fewer than ``width``."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    value = np.full(count, np.uint64(width))
    for k in range(width):
        value = value * _STEP + words[k : k + count]
    return mix(value)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text)))
