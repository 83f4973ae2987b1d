"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Unit vectors are centred, rotated by a learned rotation (iterative quantisation) and cut to their
signs: one bit per dimension. A code is split into substrings, and each substring is indexed. By
the pigeonhole principle a code within Hamming radius r of a query agrees with it in some
substring up to r / substrings bits, so that probing every substring within that radius retrieves
every code within r. Retrieved vectors are then ranked by their exact cosine.

Rows are dealt into blocks of bounded size, each with its own index over all its rows, and every
query visits every block: the queries are a stated set. Each block answers with its best few; the
answers meet per query. A block where the radius holds fewer than k ids besides the query's own
widens it step by step, so that a query always gets k neighbours where there are as many. Rows of
one id are dealt by their vectors too, and many equal ones are one row, so no id fills a block.

The rotation and the radius are fitted on a bounded sample. The radius is the one within which the
sample's queries find the target share of their true neighbours; neighbours among all rows are
nearer than among the sample, so the recall over all rows is higher than that.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold a
null or non-finite component take no part. Ties go to the smaller id. Repeated vectors are ranked
one by one; of rows that share an id the nearest counts and takes one place, and to a query of that
id none. Without usable
vectors the result is empty. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUBSTRING_BITS = 8
SAMPLE_ROWS = 8_000
SAMPLE_QUERIES = 200
TARGET_RECALL = 0.97
BLOCK_ROWS = 8192
ROTATION_ROUNDS = 30


@dataclass
class BinaryCodes:
    """Centre and rotation of the codes, and the Hamming radius to search."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of bytes: one substring of eight bits each."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits((unit - self.centre) @ self.rotation > 0, axis=1)


def _distances(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def learn(sample: np.ndarray, k: int, target: float = TARGET_RECALL) -> BinaryCodes:
    """Fit rotation and radius on sample vectors."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    moved = unit - centre
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(moved.shape[1],) * 2))[0]
    for _ in range(ROTATION_ROUNDS):
        left, _, right = np.linalg.svd(np.sign(moved @ rotation).T @ moved)
        rotation = (left @ right).T
    codes = BinaryCodes(centre, rotation, 8 * -(-moved.shape[1] // 8))
    known = codes.encode(unit)
    step = max(1, len(unit) // SAMPLE_QUERIES)
    far: list[int] = []
    for q in range(0, len(unit), step):
        near = unit @ unit[q]
        near[q] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(unit) - 1)]
        far += _distances(known[q], known[best]).tolist()
    if far:
        codes.radius = int(np.sort(far)[min(len(far) - 1, int(np.ceil(target * len(far))))])
    return codes


class MultiIndex:
    """An inverted list per substring over the codes of one block."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray | None = None):
        self.codes = codes
        self.ids = np.arange(len(codes)) if ids is None else ids
        known = np.unique(self.ids)
        self.repeats, self.known = len(known) < len(self.ids), len(known)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [
            np.searchsorted(codes[order, j], np.arange(257)) for j, order in enumerate(self.order)
        ]
        weight = np.bitwise_count(np.arange(256, dtype=np.uint8))
        self.masks = [np.flatnonzero(weight <= r).astype(np.uint8) for r in range(SUBSTRING_BITS + 1)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code lies within the radius."""
        reach = min(radius // self.codes.shape[1], SUBSTRING_BITS)
        found = np.zeros(len(self.codes), dtype=bool)
        for j, (order, starts) in enumerate(zip(self.order, self.starts)):
            for value in (self.masks[reach] ^ code[j]).tolist():
                found[order[starts[value] : starts[value + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[_distances(code, self.codes[rows]) <= radius]

    def others(self, rows: np.ndarray, own: int) -> int:
        """How many ids besides ``own`` the rows have."""
        ids = self.ids[rows]
        ids = ids[ids != own]
        return len(np.unique(ids)) if self.repeats else len(ids)

    def at_least(self, code: np.ndarray, radius: int, count: int, own: int) -> np.ndarray:
        """As ``within``, with the radius widened until ``count`` ids besides ``own`` or all are found."""
        bits = SUBSTRING_BITS * self.codes.shape[1]
        rows = self.within(code, radius)
        while radius < bits and self.others(rows, own) < min(count, self.known):
            radius += 2
            rows = self.within(code, radius)
        return rows[self.ids[rows] != own]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, each from its own sums, so that equal pairs get equal values."""
    return (vectors * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(axis=1)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(codes: BinaryCodes, k: int):
    """Rows of a block come first, then the queries, which stream by."""

    def answer(ids: np.ndarray, vectors: np.ndarray, index: MultiIndex, query_ids, queries) -> pa.RecordBatch:
        out = [[], [], []]
        for query_id, query, code in zip(query_ids, queries, codes.encode(queries)):
            rows = index.at_least(code, codes.radius, k, query_id)
            if not len(rows):
                continue
            score = cosines(query, vectors[rows])
            best = np.lexsort((ids[rows], -score))
            if index.repeats:
                best = best[np.sort(np.unique(ids[rows[best]], return_index=True)[1])]
            best = best[:k]
            out[0].append(np.full(len(best), query_id))
            out[1].append(ids[rows[best]])
            out[2].append(score[best])
        columns = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))],
            names=["query_id", "vec_id", "score"],
        )

    def search(batches):
        block, held_ids, held_vectors, ready = None, [], [], None
        for batch in batches:
            number = batch.column("block").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"))
            change = (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(number)]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                if number[first] != block:
                    block, held_ids, held_vectors, ready = number[first], [], [], None
                if not asks[first]:
                    held_ids.append(ids[first:last])
                    held_vectors.append(vectors[first:last])
                    continue
                if not held_ids:
                    continue
                if ready is None:
                    own = np.concatenate(held_vectors)
                    known = np.concatenate(held_ids)
                    ready = (known, own, MultiIndex(codes.encode(own), known))
                yield answer(*ready, ids[first:last], vectors[first:last])

    return search


def usable(vector: Column) -> Column:
    """Finite, without null components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """The ``k`` nearest rows of every row for which ``queries`` (of ``vec_id``) holds."""
    spark = vectors.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    schema = "query_id long, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    length, count = lengths
    rows = rows.where(F.size("vector") == length)
    share = min(1.0, SAMPLE_ROWS / count)
    taken = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) < int(share * (1 << 32))).select("vec_id", "vector")
    # One row of each id: copies are no neighbours to learn a radius from.
    sample = taken.groupBy("vec_id").agg(F.min("vector").alias("vector")).limit(2 * SAMPLE_ROWS).toPandas()
    sample = sample.sort_values("vec_id", kind="stable")
    if sample.empty:
        sample = rows.limit(SAMPLE_ROWS).toPandas()
    codes = learn(np.array(sample.vector.tolist(), dtype=np.float64), k, target_recall)
    blocks = -(-count // block_rows)
    # Equal rows of an id go to one block; where they are many, one stands for all.
    place = F.xxhash64("vec_id", "vector", F.lit(1))
    many = rows.groupBy(place.alias("place")).count().where(F.col("count") > max(1, block_rows // 8))
    many = [row.place for row in many.collect()]
    held = rows
    if many:
        held = rows.where(~place.isin(many)).unionByName(rows.where(place.isin(many)).dropDuplicates(["vec_id", "vector"]))
    dealt = held.select(
        F.pmod(place, F.lit(blocks)).cast("int").alias("block"),
        F.lit(False).alias("asks"),
        "vec_id",
        "vector",
    )
    asked = rows.where(queries).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "vector"
    )
    found = (
        dealt.unionByName(asked)
        .repartition(blocks, "block")
        .sortWithinPartitions("block", "asks", "vec_id")
        .mapInArrow(_search(codes, k), schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = once.withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k)
