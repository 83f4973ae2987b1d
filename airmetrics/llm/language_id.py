"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one array of slots, and each slot holds one bit per language: the filters lie
side by side, bit-sliced. Looking an n-gram up means reading the slots of its hashes and taking
their AND, which gives the mask of all languages that contain it. Per text and language the set
bits are counted; the share of hits that Bloom collisions explain is taken off; the language with
the largest corrected count wins.

An n-gram belongs to a language when it occurs at least ``min_count`` times in its sample, at a
rate of at least ``share`` of its rate in the language where it is most frequent.

Defined results: a text that is null, empty or without a letter (numerals such as ½ or Ⅷ are none) is
``und`` with score 0. A text
whose n-grams are all unknown gets the language of the largest sample, with score 0. Ties go to
the first language by name. Long texts are read whole, in slices of bounded size. Rows repeat as
they come; other columns pass through untouched.

The filters are fitted on a bounded sample: of each language at most about ``sample_bytes`` of
labelled text, whole texts taken by a hash of the text. Everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airmetrics.llm.common import code_points, mix

GRAM = 4
SLOTS = 1 << 20
PROBES = 3
SAMPLE_BYTES = 8_000_000
MIN_COUNT = 3
SHARE = 0.2
#: Languages that one word of a mask holds; further ones get further words.
WORD_LANGUAGES = 63
UNDETERMINED = "und"
_SLICE = 1 << 19
# Numerals such as ½, ① or Ⅷ are no letters.
_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters(text: str | None) -> str:
    """Lower-cased words parted and bounded by single spaces; empty when there is no letter."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def gram_hashes(words: str) -> Iterator[np.ndarray]:
    """The hashes of all n-grams, slice by slice."""
    for at in range(0, max(len(words) - GRAM + 1, 0), _SLICE):
        codes = code_points(words[at : at + _SLICE + GRAM - 1]).astype(np.uint64)
        count = len(codes) - GRAM + 1
        value = codes[:count]
        for k in range(1, GRAM):
            value = (value << np.uint64(16)) ^ (value >> np.uint64(48)) ^ codes[k : k + count]
        yield mix(value)


def _slots(hashes: np.ndarray, slots: int, probes: int) -> Iterator[np.ndarray]:
    for k in range(probes):
        yield ((hashes >> np.uint64(20 * k)) & np.uint64(slots - 1)).astype(np.int64)


def upper_share(share: float, count: int, z: float = 2.0) -> float:
    """Upper end of the Wilson interval of a share seen in ``count`` trials; 1 when there is none."""
    if count <= 0:
        return 1.0
    spread = z * (share * (1 - share) / count + z * z / (4.0 * count * count)) ** 0.5
    return min(1.0, max(share, (share + z * z / (2.0 * count) + spread) / (1.0 + z * z / count)))


@dataclass
class LanguageFilters:
    """The slots, the names of the bits, and the false-positive rate of each language's filter.

    ``masks`` has one entry per slot, or a row of them for every :data:`WORD_LANGUAGES` languages.
    """

    masks: np.ndarray
    names: list[str]
    false_rate: np.ndarray
    largest: int = 0
    probes: int = PROBES

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The masks of all languages that hold each n-gram, one row per word of the mask."""
        sliced = np.atleast_2d(self.masks)
        found = None
        for at in _slots(hashes, sliced.shape[1], self.probes):
            found = sliced[:, at] if found is None else found & sliced[:, at]
        return found

    def counts(self, words: str) -> tuple[np.ndarray, int]:
        hits, total = np.zeros(len(self.names), dtype=np.int64), 0
        for hashes in gram_hashes(words):
            total += len(hashes)
            for word, masks in enumerate(self.lookup(hashes)):
                if len(self.names) <= 8:
                    seen = np.bincount(masks, minlength=256)
                    values = np.arange(256)
                else:
                    values, seen = np.unique(masks, return_counts=True)
                first = word * WORD_LANGUAGES
                for bit in range(min(WORD_LANGUAGES, len(self.names) - first)):
                    hits[first + bit] += seen[(values >> np.array(bit, dtype=values.dtype)) & 1 == 1].sum()
        return hits, total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share of all corrected counts, and its share of the text's n-grams."""
        return self.judge(text)[:3]

    def judge(self, text: str | None) -> tuple[str, float, float, float]:
        """What :meth:`predict` tells, and the upper end of the interval that the last share lies in."""
        words = letters(text)
        if not words or not self.names:
            return UNDETERMINED, 0.0, 0.0, 0.0
        hits, total = self.counts(words)
        corrected = np.maximum(0.0, (hits - total * self.false_rate) / (1.0 - self.false_rate))
        best = int(np.argmax(corrected))
        if corrected[best] <= 0:
            return self.names[self.largest], 0.0, 0.0, upper_share(0.0, total)
        share = float(min(1.0, corrected[best] / total))
        return self.names[best], float(corrected[best] / corrected.sum()), share, upper_share(share, total)


def _count_grams(names: list[str]):
    number = {name: k for k, name in enumerate(names)}

    def count(batches):
        for batch in batches:
            held: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(number[lang], []).extend(gram_hashes(letters(text)))
            for lang, hashes in held.items():
                values, seen = np.unique(np.concatenate(hashes or [np.empty(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), lang, np.int32)), pa.array(values.view(np.int64)), pa.array(seen)],
                    names=["bit", "gram", "seen"],
                )

    return count


def fit(
    labelled: DataFrame,
    slots: int = SLOTS,
    probes: int = PROBES,
    sample_bytes: int = SAMPLE_BYTES,
    min_count: int = MIN_COUNT,
    share: float = SHARE,
) -> LanguageFilters:
    """Learn the filters from rows of ``lang`` and ``text``; null languages teach nothing."""
    known = labelled.select("lang", "text").where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).orderBy("lang").collect()
    names = [row.lang for row in sizes]
    kind = np.uint8 if len(names) <= 8 else np.uint64
    words = max(1, -(-len(names) // WORD_LANGUAGES))
    masks = np.zeros((words, slots), dtype=kind)
    if not names:
        return LanguageFilters(masks, names, np.zeros(0), probes=probes)
    taken = F.lit(False)
    for row in sizes:
        limit = int(min(1.0, sample_bytes / max(row.bytes, 1)) * (1 << 32))
        taken = taken | ((F.col("lang") == row.lang) & (F.crc32(F.col("text").cast("binary")) < limit))
    grams = known.where(taken).mapInArrow(_count_grams(names), "bit int, gram long, seen long")
    seen = grams.groupBy("bit", "gram").agg(F.sum("seen").alias("seen"))
    # Rates are relative to each language's own sample.
    totals = {row.bit: row.total for row in seen.groupBy("bit").agg(F.sum("seen").alias("total")).collect()}
    total = F.element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("bit"))
    rated = seen.where(F.col("seen") >= min_count).withColumn("rate", F.col("seen") / total)
    entries = rated.groupBy("gram").agg(F.collect_list(F.struct("bit", "rate")).alias("own"), F.max("rate").alias("top"))
    member = F.filter("own", lambda x: x["rate"] >= share * F.col("top"))

    def mask(word: int) -> Column:
        def with_bit(m: Column, x: Column) -> Column:
            inside = x["bit"] - word * WORD_LANGUAGES
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), inside)
            return F.when(inside.between(0, WORD_LANGUAGES - 1), m.bitwiseOR(bit)).otherwise(m)

        return F.aggregate(member, F.lit(0).cast("long"), with_bit).alias(f"mask{word}")

    places = [F.shiftrightunsigned("gram", 20 * k).bitwiseAND(slots - 1).alias(f"p{k}") for k in range(probes)]
    spread = entries.select(*map(mask, range(words)), F.explode(F.array(*places)).alias("at"))
    # At most one row per slot, a fixed number.
    filled = spread.groupBy("at").agg(*[F.bit_or(f"mask{w}").alias(f"mask{w}") for w in range(words)]).toArrow()
    for w in range(words):
        masks[w, filled.column("at").to_numpy()] = filled.column(f"mask{w}").to_numpy().astype(kind)
    places_of = [divmod(k, WORD_LANGUAGES) for k in range(len(names))]
    fill = np.array([np.count_nonzero(masks[w] & kind(1 << bit)) / slots for w, bit in places_of])
    largest = max(range(len(sizes)), key=lambda k: sizes[k].bytes)
    return LanguageFilters(masks, names, fill**probes, largest, probes)


def predictor(spark: SparkSession, filters: LanguageFilters):
    """A column function ``text -> struct<lang, score, coverage, reach>``; the filters have a fixed size.

    ``coverage`` is the share of the text's n-grams that belong to its language, ``reach`` the upper end of
    the interval that share lies in, given how few n-grams the text may have.
    """
    shared = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang string, score double, coverage double, reach double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            rows = [model.judge(text) for text in texts]
            yield pd.DataFrame(rows, columns=["lang", "score", "coverage", "reach"])

    return predict


def with_language(documents: DataFrame, filters: LanguageFilters, text: str | Column = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``documents``."""
    found = documents.withColumn("_language", predictor(documents.sparkSession, filters)(text))
    return found.withColumns({"lang_pred": F.col("_language.lang"), "score": F.col("_language.score")}).drop("_language")


def identified(documents: DataFrame, filters: LanguageFilters, coverage: float = 0.1) -> DataFrame:
    """The documents in a known language, all columns kept.

    A text goes when it has no letter, or when less than ``coverage`` of its n-grams belong to its
    language with certainty: the upper end of the share's Wilson interval (two deviations) lies below. One
    rule holds for all lengths; a text of a few words has too few n-grams to be sure and stays.
    """
    found = predictor(documents.sparkSession, filters)("text")
    return documents.where((found["lang"] != UNDETERMINED) & (found["reach"] >= coverage))
