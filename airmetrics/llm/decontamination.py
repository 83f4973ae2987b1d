"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item of n words is looked for in windows of n words. Windows and items are multisets
of word shingles; SimHash turns each into 64 bits. Item fingerprints are indexed by eight blocks
of eight bits, each entered under all values within ``radius // 8`` bits: by the pigeonhole
principle every item within the radius of a window shares an entry with it. Candidates are then
verified exactly: the shingles weighted by their counts, the sum of the lesser weights over the
sum of the greater ones, must reach the threshold.

Only windows that hold at least one shingle of some item of their size are fingerprinted. That
loses nothing: a window without any has similarity 0 to all these items. At the threshold of 0.8 a fingerprint differs in
about 10 of 64 bits with a deviation of 3, so the radius of 23 leaves out less than one in 10,000.

The scan runs inside the row, so copies and hot sources need no shuffle. Benchmarks are taken in
blocks of items of bounded size, each a pass over the documents.

Defined results: null, empty and wordless texts and items match nothing. An item of fewer than
five words is a single shingle and matches only a text of just these words. Texts shorter than an
item are one window. Equal items match alike, repeated rows are scanned alike. Of several windows
for one item and row the most similar, then the first, is reported. Extra columns pass through the
filter. An empty benchmark rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.llm.common import SIMILARITY, shingle_hashes, word_hashes

RADIUS = 23
BLOCKS = 8
#: Benchmark items that one pass holds in memory.
ITEMS_PER_PASS = 20_000
_FILTER = 1 << 20
_PIECE = 1 << 13


def _bits(shingles: np.ndarray) -> np.ndarray:
    """One signed vote per bit and shingle."""
    votes = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return votes.astype(np.int32) * 2 - 1


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Eight bytes: the majority of every bit."""
    return np.packbits(_bits(shingles).sum(axis=0) > 0)


def similarity(one: np.ndarray, other: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    values, at = np.unique(np.concatenate([one, other]), return_inverse=True)
    a = np.bincount(at[: len(one)], minlength=len(values))
    b = np.bincount(at[len(one) :], minlength=len(values))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


class SizeIndex:
    """The items of one size, indexed by blocks of their fingerprints."""

    def __init__(self, items: np.ndarray, prints: np.ndarray, radius: int):
        self.items, self.prints, self.radius = items, prints, radius
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)) <= radius // BLOCKS
        masks = np.flatnonzero(near).astype(np.uint8)
        self.starts, self.lists = [], []
        for block in range(BLOCKS):
            values = (prints[:, block, None] ^ masks[None]).ravel()
            owner = np.repeat(np.arange(len(items)), len(masks))
            order = np.argsort(values, kind="stable")
            self.lists.append(owner[order])
            self.starts.append(np.searchsorted(values[order], np.arange(257)))

    def candidates(self, windows: np.ndarray) -> np.ndarray:
        """Pairs of window and item within the radius."""
        pairs = []
        for block in range(BLOCKS):
            first = self.starts[block][windows[:, block]]
            count = self.starts[block][windows[:, block].astype(np.int64) + 1] - first
            window = np.repeat(np.arange(len(windows)), count)
            place = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            pairs.append(window * len(self.items) + self.lists[block][place])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(self.items), pair % len(self.items)
        near = np.bitwise_count(windows[window] ^ self.prints[item]).sum(axis=1) <= self.radius
        return np.column_stack([window[near], item[near]])


class Benchmark:
    """Items, their shingles, and an index per item size."""

    def __init__(self, ids: list, texts: list[str | None], radius: int = RADIUS, threshold: float = SIMILARITY):
        self.threshold = threshold
        words = [word_hashes(text) for text in texts]
        kept = [k for k, w in enumerate(words) if len(w)]
        self.ids = [ids[k] for k in kept]
        self.words = [len(words[k]) for k in kept]
        self.shingles = [shingle_hashes(words[k]) for k in kept]
        every = np.concatenate(self.shingles) if kept else np.empty(0, np.uint64)
        self.known, place = np.unique(every, return_inverse=True)
        self.filter = np.zeros(_FILTER, dtype=bool)
        self.filter[(self.known & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        size = np.array([len(s) for s in self.shingles], dtype=np.int64)
        # Per known shingle: the sizes of the items that hold it.
        pairs = np.unique(np.column_stack([place, np.repeat(size, size)]), axis=0)
        self.size_starts = np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 1))
        self.size_of = pairs[:, 1]
        self.sizes = {}
        for one in np.unique(size):
            own = np.flatnonzero(size == one)
            prints = np.array([simhash(self.shingles[k]) for k in own])
            self.sizes[int(one)] = SizeIndex(own, prints, radius)

    def _held(self, shingles: np.ndarray) -> dict[int, np.ndarray]:
        """Per item size: places of shingles that belong to an item of that size."""
        at = np.flatnonzero(self.filter[(shingles & np.uint64(_FILTER - 1)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return {}
        spot = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        same = self.known[spot] == shingles[at]
        at, spot = at[same], spot[same]
        first, count = self.size_starts[spot], self.size_starts[spot + 1] - self.size_starts[spot]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        sizes, places = self.size_of[np.repeat(first, count) + inner], np.repeat(at, count)
        return {int(one): places[sizes == one] for one in np.unique(sizes)}

    def matches(self, text: str | None) -> dict[int, tuple[float, int]]:
        """Per item: the similarity of its best window, and the word where that window starts."""
        shingles = shingle_hashes(word_hashes(text))
        found: dict[int, tuple[float, int]] = {}
        for size, held in self._held(shingles).items():
            index = self.sizes[size]
            width = min(size, len(shingles))
            # Starts of the windows around the places held, in runs without long gaps.
            reach = np.zeros(len(shingles) + 1, dtype=np.int64)
            np.add.at(reach, np.maximum(held - width + 1, 0), 1)
            np.add.at(reach, held + 1, -1)
            starts = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
            starts = starts[starts <= len(shingles) - width]
            for at in range(0, len(starts), _PIECE):
                some = starts[at : at + _PIECE]
                for run in np.split(some, np.flatnonzero(np.diff(some) > width) + 1):
                    self._verify(shingles, run, width, index, found)
        return found

    def _verify(self, shingles, starts, width, index, found) -> None:
        first = starts[0]
        votes = np.cumsum(_bits(shingles[first : starts[-1] + width]), axis=0, dtype=np.int32)
        votes = np.concatenate([np.zeros((1, 64), np.int32), votes])
        windows = np.packbits(votes[starts - first + width] - votes[starts - first] > 0, axis=1)
        for window, number in index.candidates(windows).tolist():
            item, start = int(index.items[number]), int(starts[window])
            near = similarity(shingles[start : start + width], self.shingles[item])
            if near >= self.threshold and near > found.get(item, (0.0, 0))[0]:
                found[item] = (near, start)


def _passes(benchmark: DataFrame, radius: int, threshold: float) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``ITEMS_PER_PASS`` items."""
    items = benchmark.select("item_id", "text").where("text is not null")
    blocks = -(-items.count() // ITEMS_PER_PASS)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toPandas()
        yield Benchmark(own.item_id.tolist(), own.text.tolist(), radius, threshold)


def leaks(
    documents: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = SIMILARITY
) -> DataFrame:
    """One row per document and item found in it, with the best window and its similarity."""
    spark = documents.sparkSession
    kept = documents.select("doc_id", "text")
    doc_type, item_type = kept.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", doc_type),
            T.StructField("item_id", item_type),
            T.StructField("first_word", T.LongType()),
            T.StructField("words", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )

    def scan(shared):
        def run(batches):
            known = shared.value
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [
                    (k, known.ids[item], start, known.words[item], near)
                    for k, text in enumerate(batch.column("text").to_pylist())
                    for item, (near, start) in sorted(known.matches(text).items())
                ]
                if rows:
                    at, items, starts, words, near = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array(items), pa.array(starts, pa.int64()),
                         pa.array(words, pa.int64()), pa.array(near, pa.float64())],
                        names=["doc_id", "item_id", "first_word", "words", "similarity"],
                    )

        return run

    found = spark.createDataFrame([], schema)
    for known in _passes(benchmark, radius, threshold):
        found = found.unionByName(kept.mapInArrow(scan(spark.sparkContext.broadcast(known)), schema))
    return found


def without_leaks(
    documents: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = SIMILARITY
) -> DataFrame:
    """The documents in which no item is found, all columns kept."""
    spark = documents.sparkSession

    def clean(shared):
        @F.pandas_udf("boolean")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = shared.value
            for texts in batches:
                yield pd.Series([not known.matches(text) for text in texts], dtype=bool)

        return run

    for known in _passes(benchmark, radius, threshold):
        documents = documents.where(clean(spark.sparkContext.broadcast(known))("text"))
    return documents
