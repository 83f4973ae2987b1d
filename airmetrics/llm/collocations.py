"""Phrases of two and three words that occur together more often than their parts suggest.

Counting. Texts are counted in runs of about two million words, in numpy, and Spark adds the runs
up. A phrase can be frequent only if its parts are, so each longer order counts just the phrases
whose parts may be: a bitmap of fixed size tells frequent words and frequent pairs by hash. It only
spares work. A wrong bit lets a rare phrase through, which its exact count then removes; on inputs
so large that the bitmap fills up, more phrases are counted and the result stays the same.

Streams. Frequent phrases of all orders form one stream of counts. In prefix order (by first word,
second, third) a phrase follows its own beginnings; in suffix order (by last word, the one before,
the first) it follows its own ends. So one walk over each sorted stream, in lockstep with the last
seen shorter phrase of each length, gives left counts (first word, first two), right counts (last
word, last two) and with them the extensions that cover a pair. The streams are range-partitioned
without regard to words, so that a very frequent word does not fill a task; what a partition needs
from those before it are two counts, looked up for its first row.

Defined results: null texts count as empty, a null language as ``und``; equal texts count each;
words may hold any character but blanks and the piece marks; an empty table gives no phrase. Counts
up to 10**16 are exact. Only ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airmetrics.llm.common import SLICE_BYTES, mix, release_memory, shared_folder, slices, stored

AT_LEAST = 10
TOP = 2000
#: A longer phrase with this share (in percent) of a pair's occurrences covers it.
COVERED = 50
#: Bits that tell what may be frequent: 8 MB, whatever the corpus.
BITMAP_BITS = 1 << 26
#: Words that a task counts at once; local word numbers have 21 bits.
RUN_WORDS = 1 << 21
#: Hashes of pairs that one task adds up, and rows of a stream that one task walks.
MERGE_HASHES = 1 << 22
STREAM_ROWS = 1 << 20
#: First cut of the ranking, so that a language is not sorted in one task.
SALTS = 64

_STEP = np.uint64(0x9FB21C651E98DF25)
#: Lower case for A-Z; piece marks become a byte that UTF-8 never uses.
_END = b"\xff"
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class Run:
    """Words of many texts as numbers, with the hash of every distinct word of a language."""

    def __init__(self, words: list[bytes], langs: list[tuple[str, int]], carried: int):
        """``langs`` holds a language and how many words are its own, in order; of the first
        ``carried`` words only phrases that end later are counted."""
        names, codes = np.unique(np.array([lang for lang, _ in langs], dtype=object), return_inverse=True)
        number, found = pd.factorize(np.array(words, dtype=object))
        inside = found[number] != _END if len(found) else np.zeros(0, dtype=bool)
        lang = np.repeat(codes, [count for _, count in langs])
        both = lang.astype(np.int64) * max(len(found), 1) + number
        keys, first = np.unique(both, return_index=True)
        self.ids = np.searchsorted(keys, both)
        self.inside, self.carried = np.asarray(inside, dtype=bool), carried
        self.langs = pa.array(names[lang[first]], pa.string())
        texts = [found[k] for k in number[first]]
        self.texts = pa.array(texts, pa.binary())
        seeds = [xxhash.xxh3_64_intdigest(name.encode()) for name in names]
        self.hashes = np.array(
            [xxhash.xxh3_64_intdigest(t, seed=seeds[k]) for t, k in zip(texts, lang[first])], dtype=np.uint64
        )

    def ends(self, order: int) -> np.ndarray:
        """Where phrases of ``order`` words end that lie inside one piece."""
        ok = self.inside.copy()
        for back in range(1, order):
            ok[back:] &= self.inside[: len(ok) - back]
            ok[:back] = False
        ok[: self.carried] = False
        return np.flatnonzero(ok)

    def counted(self, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct phrases that end at these places, as word numbers, and how often each does."""
        key = np.zeros(len(at), dtype=np.int64)
        for back in reversed(range(order)):
            key = key << 21 | self.ids[at - back]
        keys, counts = np.unique(key, return_counts=True)
        return [keys >> (21 * back) & 0x1FFFFF for back in reversed(range(order))], counts

    def pair_hashes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(self.hashes[first] * _STEP + self.hashes[second])

    def rows(self, words: list[np.ndarray], counts: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(counts), 1 << 17):
            part = [w[at : at + (1 << 17)] for w in words]
            texts = [self.texts.take(pa.array(p)) for p in part]
            phrase = texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, b" ")
            columns = [self.langs.take(pa.array(part[0])), phrase.cast(pa.string())]
            kept = [pa.array(self.hashes[part[0]].view(np.int64))] if "hash" in schema.names else []
            yield pa.RecordBatch.from_arrays([*columns, *kept, pa.array(counts[at : at + (1 << 17)])], schema=schema)


def _runs(batches) -> Iterator[Run]:
    """The texts of a task, run by run; the last two words go over into the next run."""
    words: list[bytes] = []
    langs: list[tuple[str, int]] = []
    carried = 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            lang, text = lang.as_py(), (text.as_py() or b"").translate(_LETTERS)
            for part in slices(text + _END, SLICE_BYTES):
                found = part.replace(_END, b" \xff ").split()
                while found:
                    room = RUN_WORDS - 1 - len(words)
                    words += found[:room]
                    langs.append((lang, len(found[:room])))
                    found = found[room:]
                    if len(words) >= RUN_WORDS - 1:
                        yield Run(words, langs, carried)
                        words, langs, carried = words[-2:], [(lang, 2)], 2
    if words:
        yield Run(words, langs, carried)


def _may_be(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(BITMAP_BITS - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _words(schema: pa.Schema):
    def count(batches):
        release_memory()
        for run in _runs(batches):
            words, counts = run.counted(run.ends(1), 1)
            yield from run.rows(words, counts, schema)

    return count


def _pairs(words, buckets: int, schema: pa.Schema):
    """Sorted hashes and counts of the pairs of frequent words, cut by ranges of the hash."""

    def count(batches):
        bits = words.value
        for run in _runs(batches):
            often = _may_be(bits, run.hashes)
            at = run.ends(2)
            at = at[often[run.ids[at]] & often[run.ids[at - 1]]]
            (first, second), counts = run.counted(at, 2)
            hashes = run.pair_hashes(first, second)
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order].astype(np.uint32)
            starts = np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)
            edges = np.append(np.searchsorted(hashes, starts), len(hashes))
            for k in np.flatnonzero(edges[1:] > edges[:-1]):
                part = slice(edges[k], edges[k + 1])
                row = {"bucket": int(k), "hashes": hashes[part].tobytes(), "counts": counts[part].tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return count


def _frequent_bits(at_least: int):
    """Sum the runs of one range of hashes; the frequent ones become bits."""

    def merge(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(h.as_py(), dtype=np.uint64) for h in table["hashes"]])
        counts = np.concatenate([np.frombuffer(c.as_py(), dtype=np.uint32) for c in table["counts"]])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        often = hashes[starts][np.add.reduceat(counts, starts) >= at_least]
        return pa.table({"hash": pa.array(often.view(np.int64))})

    return merge


def _phrases(words, pairs, schema: pa.Schema):
    """Pairs that may be frequent, and phrases of three words both of whose pairs may be."""

    def count(batches):
        release_memory()
        for run in _runs(batches):
            often = _may_be(words.value, run.hashes)
            two = run.ends(2)
            two = two[often[run.ids[two]] & often[run.ids[two - 1]]]
            two = two[_may_be(pairs.value, run.pair_hashes(run.ids[two - 1], run.ids[two]))]
            known = np.zeros(len(run.ids) + 1, dtype=bool)
            known[two] = True
            yield from run.rows(*run.counted(two, 2), schema)
            # A pair that ends in the part carried over is known from the run before; look again.
            if run.carried == 2 and run.inside[:2].all():
                known[1] = _may_be(pairs.value, run.pair_hashes(run.ids[:1], run.ids[1:2]))[0]
            three = run.ends(3)
            three = three[known[three] & known[three - 1]]
            yield from run.rows(*run.counted(three, 3), schema)

    return count


def _bitmap(hashes: DataFrame):
    """The bitmap of these hashes for all tasks: at most ``BITMAP_BITS / 64`` numbers pass the driver."""
    place = F.col("hash").bitwiseAND(BITMAP_BITS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    found = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def counts(documents: DataFrame, at_least: int = AT_LEAST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of one to three words (``lang, phrase, f``), and all words per language (``lang, n``)."""
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    named = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("hash", pa.int64()), ("f", pa.int64())])
    every = texts.mapInArrow(_words(named), "lang string, phrase string, hash long, f long")
    every = every.groupBy("lang", "phrase").agg(F.min("hash").alias("hash"), F.sum("f").alias("f"))
    # Rare words are only needed for the sum of their counts.
    rare = F.col("f") < at_least
    kept = every.groupBy("lang", F.when(~rare, F.col("phrase")).alias("phrase")).agg(
        F.min(F.when(~rare, F.col("hash"))).alias("hash"), F.sum("f").alias("f")
    )
    kept = stored(kept, "words")
    totals = kept.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = kept.where("phrase is not null")
    words = _bitmap(frequent)

    size = kept.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    buckets = -(-size // MERGE_HASHES) or 1
    binary = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
    pairs = texts.mapInArrow(_pairs(words, buckets, binary), "bucket int, hashes binary, counts binary")
    pairs = _bitmap(pairs.groupBy("bucket").applyInArrow(_frequent_bits(at_least), "hash long"))

    plain = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
    longer = texts.mapInArrow(_phrases(words, pairs, plain), "lang string, phrase string, f long")
    longer = longer.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= at_least)
    return stored(frequent.select("lang", "phrase", "f").unionByName(longer), "phrases"), totals


# -- streams -------------------------------------------------------------------------------


def _first_row(batches):
    for batch in batches:
        if batch.num_rows:
            row = batch.slice(0, 1).to_pylist()[0]
            yield pa.RecordBatch.from_pylist(
                [{"part": TaskContext.get().partitionId(), "lang": row["lang"], "key": row["key"]}],
                schema=pa.schema([("part", pa.int32()), ("lang", pa.string()), ("key", pa.list_(pa.string()))]),
            )
            return


def _walk(before: dict[int, tuple[int, int]], names: tuple[str, str]):
    """One pass over a sorted stream: the counts of the last phrases of one and of two words."""

    def walk(batches):
        last = list(before.get(TaskContext.get().partitionId(), (0, 0)))
        for batch in batches:
            if not batch.num_rows:
                continue
            f = batch.column("f").to_numpy()
            length = pc.list_value_length(batch.column("key")).to_numpy()
            for k, name in enumerate(names):
                at = np.maximum.accumulate(np.where(length == k + 1, np.arange(len(f)), -1))
                seen = np.where(at >= 0, f[at], last[k])
                last[k] = int(seen[-1])
                batch = batch.append_column(name, pa.array(seen, mask=length <= k))
            yield batch

    return walk


def _lockstep(phrases: DataFrame, backwards: bool, names: tuple[str, str]) -> DataFrame:
    """Add the counts of the shorter phrases that each phrase begins with (``backwards``: ends with)."""
    spark = phrases.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "streams"))
    words = F.split("phrase", " ")
    key = F.reverse(words) if backwards else words
    tasks = -(-phrases.count() // STREAM_ROWS) or 1
    # Arrays compare word by word, a beginning before what it begins. The checkpoint fixes which
    # rows lie in which partition.
    stream = phrases.withColumn("key", key).repartitionByRange(tasks, "lang", "key").sortWithinPartitions("lang", "key").checkpoint()
    firsts = stream.select("lang", "key").mapInArrow(_first_row, "part int, lang string, key array<string>").collect()
    wanted = {(r.lang, " ".join((r.key[:k])[:: -1 if backwards else 1])): 0 for r in firsts for k in (1, 2) if len(r.key) > k}
    if wanted:
        # At most two phrases a partition.
        asked = spark.createDataFrame(list(wanted), "lang string, phrase string")
        wanted = {(r.lang, r.phrase): r.f for r in stream.join(F.broadcast(asked), ["lang", "phrase"]).collect()}
    before = {
        r.part: tuple(wanted.get((r.lang, " ".join((r.key[:k])[:: -1 if backwards else 1])), 0) for k in (1, 2)) for r in firsts
    }
    kept = [c for c in stream.columns if c != "key"]
    schema = ", ".join(f"{n} {t}" for n, t in stream.dtypes) + "".join(f", {n} long" for n in names)
    return stream.mapInArrow(_walk(before, names), schema).select(*kept, *names)


def collocations(
    documents: DataFrame, at_least: int = AT_LEAST, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """The strongest phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``score`` is
    ``1000000 * a * a / (l * r)`` rounded down. Pairs that a longer phrase covers are left out.
    """
    phrases, totals = counts(documents, at_least)
    led = _lockstep(phrases, False, ("first", "first_two"))
    both = stored(_lockstep(led, True, ("last", "last_two")), "parts")
    size = F.size(F.split("phrase", " "))
    triples = both.where(size == 3).withColumn("w", F.split("phrase", " "))
    pair = F.explode(
        F.array(
            F.struct(F.col("first_two").alias("of"), F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("phrase")),
            F.struct(F.col("last_two").alias("of"), F.concat_ws(" ", F.col("w")[1], F.col("w")[2]).alias("phrase")),
        )
    )
    hidden = triples.select("lang", "f", pair.alias("pair")).where(F.col("f") * 100 >= F.col("pair.of") * covered)
    hidden = hidden.select("lang", "pair.phrase").distinct()

    def cut(k: int, left: str, right: str):
        value = f"(1000000 * cast(f AS decimal(17, 0)) * f) div (cast({left} AS decimal(19, 0)) * {right})"
        return F.struct(F.expr(value).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    weakest = F.when(size == 2, cut(1, "first", "last")).otherwise(
        F.least(cut(1, "first", "last_two"), cut(2, "first_two", "last"))
    )
    scored = both.where(size > 1).select("lang", "phrase", F.col("f").alias("a"), weakest.alias("cut"))
    scored = scored.join(hidden.hint("merge"), ["lang", "phrase"], "left_anti")
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    near = scored.withColumn("near", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order)))
    ranked = near.where(F.col("near") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top).join(totals, "lang")
    longs = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *longs)
