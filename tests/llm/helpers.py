"""Frames and plain re-computations shared by the tests."""

from __future__ import annotations

import re

from airmetrics.llm.common import ship_package

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"\w+")


def documents(spark, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    ship_package(spark)
    width = len(columns.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], columns)


def words(text):
    return [w.lower() for w in WORDS.findall(text or "")]


def shingles(text, width=5):
    found = words(text)
    width = min(width, len(found))
    return [tuple(found[k : k + width]) for k in range(len(found) - width + 1)] if found else []


def jaccard(a, b):
    one, two = set(shingles(a)), set(shingles(b))
    return len(one & two) / len(one | two) if one and two else 0.0


def prose(seed, count):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8))) for _ in range(count))
