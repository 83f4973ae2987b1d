"""N-gram Jaccard join by MinHash banding with exact verification.

Texts are sets of word shingles. Texts with one and the same set are a class of copies; the join
works on classes. Every class gets one key per tree, a hash of its first minima there. This is
banding in place of an LSH forest: the depth is one number, shortened from the full one until a pair
at the threshold meets with the target probability, and does not adapt to the data. Two classes meet
when they share a key in some tree; more similar pairs meet more surely.

Classes that meet are compared exactly. A pair is counted in the first tree where it meets, so it
is verified once. Large nodes are cut into chunks, and tasks compare a chunk with a chunk:
pairs are never emitted. What leaves a task is one row per class: how many links it has there,
and one link that keeps its group connected.

Defined results: a null or empty text, and a null id, stands alone without links. Texts of other
characters than words are copies when they are equal, and have no links. Copies count once: the
links of a class are the other classes at the threshold. Ties and repeated rows need no order:
groups are named by their least id. Rows that share an id are told apart by their text. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airmetrics.llm.common import SIMILARITY, maybe_among, mix, shingle_set, stored
from airmetrics.llm.components import components

TREES = 24
DEPTH = 8
TARGET_RECALL = 0.9999
#: A task compares at most two chunks of so many classes, or of so many shingles.
CHUNK_CLASSES = 512
CHUNK_SHINGLES = 1 << 20
_BLOCK = 2048


def prefix_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """Shorten the prefix until a pair at the threshold meets with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def class_key(shingles: np.ndarray, text: str | None) -> bytes | None:
    if len(shingles):
        return blake2b(shingles.tobytes(), digest_size=16).digest()
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest() if text else None


def tree_keys(shingles: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One hash per tree of its signature prefix; the tree is part of the hash."""
    number = np.arange(1, trees * depth + 1, dtype=np.uint64)
    factor, offset = mix(number) | np.uint64(1), mix(number + np.uint64(1 << 40))
    least = np.full(trees * depth, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), _BLOCK):
        block = (shingles[None, at : at + _BLOCK] ^ offset[:, None]) * factor[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    key = np.arange(trees, dtype=np.uint64)
    for step in mix(least).reshape(trees, depth).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + step)
    return key.view(np.int64)


def _features(trees: int, depth: int):
    names = ["class", "n"] + [f"k{k}" for k in range(trees)]

    def compute(batches):
        for batch in batches:
            classes, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text)
                classes.append(class_key(shingles, text))
                sizes.append(len(shingles))
                keys.append(tree_keys(shingles, trees, depth))
            columns = np.array(keys, dtype=np.int64).reshape(len(sizes), trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64())]
                + [pa.array(np.ascontiguousarray(columns[:, k])) for k in range(trees)],
                names=["doc_id", *names],
            )

    return compute


def _shingles_of(batches):
    for batch in batches:
        classes, sets = [], []
        for key, text in zip(batch.column("class").to_pylist(), batch.column("text").to_pylist()):
            shingles = shingle_set(text)
            # Another row with the same id can have another text.
            if class_key(shingles, text) == key:
                classes.append(key)
                sets.append(shingles.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["class", "shingles"])


def _values(column: pa.Array):
    """Lists of equal length become the rows of a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), -1)
    return column.to_pylist()


def _units(batches, columns: list[str]):
    """The rows of one unit after the other, out of batches sorted by unit."""
    held, unit = [], None
    for batch in batches:
        for row in zip(*(_values(batch.column(name)) for name in ["unit", *columns])):
            if row[0] != unit:
                if held:
                    yield unit, held
                held, unit = [], row[0]
            held.append(row[1:])
    if held:
        yield unit, held


def _meeting(rows: list[tuple], tree: int, cross: bool, threshold: float) -> np.ndarray:
    """Which pairs (above the diagonal) first meet in this tree and are near enough in size."""
    keys = np.array([row[2] for row in rows])
    size = np.array([row[1] for row in rows])
    small, large = np.minimum(size[:, None], size[None]), np.maximum(size[:, None], size[None])
    pairs = small >= threshold * large
    for earlier in range(tree):
        pairs &= keys[:, None, earlier] != keys[None, :, earlier]
    if cross:
        chunk = np.array([row[3] for row in rows])
        pairs &= chunk[:, None] != chunk[None]
    return np.triu(pairs, 1)


def _active(threshold: float):
    """Keep the members of a unit that have a pair to verify there."""

    def compute(batches):
        for unit, rows in _units(batches, ["class", "n", "keys", "chunk", "tree", "crossing"]):
            if len(rows) < 2:
                continue
            pairs = _meeting(rows, rows[0][4], rows[0][5], threshold)
            use = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
            if len(use):
                kept = [rows[k] for k in use]
                types = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit] * len(kept)), *(pa.array(list(c), t) for c, t in zip(zip(*kept), types))],
                    names=["unit", "class", "n", "keys", "chunk", "tree", "crossing"],
                )

    return compute


def _verified(threshold: float):
    """Links per class, and the least member of the class's group within the unit."""

    def compute(batches):
        for _, rows in _units(batches, ["class", "n", "keys", "chunk", "tree", "crossing", "shingles"]):
            if len(rows) < 2:
                continue
            pairs = _meeting(rows, rows[0][4], rows[0][5], threshold)
            lengths = np.array([len(row[6]) // 8 for row in rows])
            values, ids = np.unique(np.frombuffer(b"".join(row[6] for row in rows), dtype=np.uint64), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            mark = np.zeros(len(values), dtype=bool)
            links = np.zeros(len(rows), dtype=np.int64)
            root = list(range(len(rows)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for i in np.flatnonzero(pairs.any(axis=1)):
                mark[ids[starts[i] : starts[i + 1]]] = True
                for j in np.flatnonzero(pairs[i]):
                    shared = np.count_nonzero(mark[ids[starts[j] : starts[j + 1]]])
                    if shared >= threshold * (lengths[i] + lengths[j] - shared):
                        links[[i, j]] += 1
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
                mark[ids[starts[i] : starts[i + 1]]] = False
            use = np.flatnonzero(links)
            if len(use):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows[k][0] for k in use], pa.binary()),
                        pa.array([rows[find(k)][0] for k in use], pa.binary()),
                        pa.array(links[use]),
                    ],
                    names=["class", "other", "links"],
                )

    return compute


def near_duplicates(
    documents: DataFrame,
    threshold: float = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per document: ``class_id`` (least id of its group), ``copy_of`` (least id with the
    same shingles) and ``links`` (other classes of copies at the threshold)."""
    depth = prefix_depth(threshold, trees, depth, target_recall)
    kept = documents.select("doc_id", "text")
    id_type = kept.schema["doc_id"].dataType
    keys = [f"k{k}" for k in range(trees)]
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("class", T.BinaryType()), T.StructField("n", T.LongType())]
        + [T.StructField(k, T.LongType()) for k in keys]
    )
    rows = stored(kept.mapInArrow(_features(trees, depth), schema), "features")
    named = rows.where("doc_id is not null and class is not null")
    classes = stored(
        named.groupBy("class").agg(
            F.min("doc_id").alias("copy_of"), F.first("n").alias("n"), *(F.first(k).alias(k) for k in keys)
        ),
        "classes",
    )

    # Nodes of the forest with at least two classes, cut into chunks.
    entries = classes.where("n > 0").select("class", "n", F.posexplode(F.array(*keys)).alias("tree", "key"))
    nodes = entries.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    pieces = F.greatest(F.ceil(F.col("members") / CHUNK_CLASSES), F.ceil(F.col("total") / CHUNK_SHINGLES))
    met = entries.select("class", "tree", "key").join(nodes.select("key", pieces.cast("int").alias("pieces")), "key")
    met = met.withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int"))
    met = met.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = F.least("chunk", "partner"), F.greatest("chunk", "partner")
    unit = F.concat_ws("/", "key", "low", "high")
    met = met.withColumns({"low": low, "high": high}).select(
        unit.alias("unit"), "class", "tree", "chunk", (F.col("low") != F.col("high")).alias("crossing")
    )
    members = met.join(classes.select("class", "n", F.array(*keys).alias("keys")), "class")
    unit_schema = "unit string, class binary, n long, keys array<long>, chunk int, tree int, crossing boolean"
    active = stored(
        members.repartition("unit").sortWithinPartitions("unit").mapInArrow(_active(threshold), unit_schema), "active"
    )

    # Shingles of the classes that have something to verify.
    wanted = active.select("class").distinct().join(classes.select("class", "copy_of"), "class")
    wanted = stored(wanted.withColumnRenamed("copy_of", "doc_id"), "wanted")
    sets = maybe_among(kept, wanted, "doc_id").join(wanted, "doc_id").select("class", "text")
    sets = sets.mapInArrow(_shingles_of, "class binary, shingles binary").dropDuplicates(["class"])
    linked = stored(
        active.join(sets, "class")
        .repartition("unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_verified(threshold), "class binary, other binary, links long"),
        "links",
    )
    stars = components(linked.select(F.col("class").alias("a"), F.col("other").alias("b")))
    totals = linked.groupBy("class").agg(F.sum("links").alias("links"))
    groups = classes.select("class", "copy_of").join(totals, "class", "left")
    groups = groups.join(stars.withColumnRenamed("child", "class"), "class", "left")
    groups = groups.withColumn("root", F.coalesce("parent", "class"))
    names = groups.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    groups = groups.join(names, "root").select("class", "class_id", "copy_of", F.coalesce("links", F.lit(0)).alias("links"))
    found = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    return found.join(groups, "class", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
    )
