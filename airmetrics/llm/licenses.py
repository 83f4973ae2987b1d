"""Licence scan by sentence rules.

A text is normalised (lower case, runs of other characters than letters and digits become one
space) with its places of rest kept. A sentence stops at ``.``, ``!`` or ``?`` before white space
and at a blank line, where lines of nothing but comment marks are blank too. At the end of a line
and at ``: `` or ``; `` it may stop or go on, so that wrapped notices, in comments as well, are read
like those on one line, and a clause that stands alone is still a sentence. Sentences of a table of
known licence sentences are found between such places, the leftmost and then the longest first.
What remains is the text's sequence of sentence identifiers. Ordered rules then match identifier
sequences to licences: a rule that matches takes its sentences away, so that a longer notice is
not counted again as the shorter one inside it. Known sentences that no rule uses are reported.

Everything happens inside the row with built-in functions; nothing is shuffled.

Defined results: null, empty and unlicensed texts get an empty list of licences, no sentences and
no rest. Long texts are read whole. Repeated rows are scanned alike and other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and their usual notices, normalised, by identifier.
SENTENCES = {
    "spdx_apache_2": ["spdx license identifier apache 2 0"],
    "apache_2": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
    ],
    "apache_comply": ["you may not use this file except in compliance with the license"],
    "apache_obtain": ["you may obtain a copy of the license at"],
    "apache_as_is": [
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "apache_limits": [
        "see the license for the specific language governing permissions and limitations under the license"
    ],
    "spdx_mit": ["spdx license identifier mit"],
    "mit": ["released under the mit license", "licensed under the mit license", "distributed under the mit license"],
    "mit_title": ["the mit license", "mit license"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_notice": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software"
    ],
    "spdx_bsd_3": ["spdx license identifier bsd 3 clause"],
    "bsd": ["licensed under the bsd license", "released under the bsd license"],
    "bsd_grant": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met"
    ],
    "spdx_gpl_3": ["spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"],
    "gpl_3": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
    ],
    "gpl_2": [
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2",
    ],
    "gpl_free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version"
    ],
    "gpl_warranty": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose"
    ],
    "cc_by": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "cc_by_sa": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "cc_by_nc": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "cc_by_nd": ["licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0"],
    "cc_0": ["licensed under cc0 1 0", "released under cc0 1 0"],
    "reserved": ["all rights reserved"],
}

# Licences and the sentence sequences that state them, tried in this order.
RULES = [
    ("Apache-2.0", ["apache_2", "apache_comply", "apache_obtain", "apache_as_is", "apache_limits"]),
    ("Apache-2.0", ["apache_2", "apache_comply", "apache_obtain"]),
    ("MIT", ["mit_title", "mit_grant", "mit_notice"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("GPL-3.0", ["gpl_free", "gpl_warranty"]),
    ("Apache-2.0", ["spdx_apache_2"]),
    ("Apache-2.0", ["apache_2"]),
    ("MIT", ["spdx_mit"]),
    ("MIT", ["mit"]),
    ("MIT", ["mit_grant"]),
    ("BSD-3-Clause", ["spdx_bsd_3"]),
    ("BSD", ["bsd_grant"]),
    ("BSD", ["bsd"]),
    ("GPL-3.0", ["spdx_gpl_3"]),
    ("GPL-3.0", ["gpl_3"]),
    ("GPL-3.0", ["gpl_free"]),
    ("GPL-2.0", ["gpl_2"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-ND-4.0", ["cc_by_nd"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC0-1.0", ["cc_0"]),
    ("Proprietary", ["reserved"]),
]

#: Capitals mark the places of rest in lower-cased text: ``H`` where a sentence stops, ``S`` where it may.
_REST = [("\n[^a-z0-9\n]+", "\n"), ("[.!?]\\s+|\n\n+", "H"), ("[:;][ \t]+|\n", "S"), ("[^a-z0-9HS]+", " ")]


def sequence(text: str | Column = "text", sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """The identifiers of the known sentences, in order, as ``<a><b>``."""
    column = F.col(text) if isinstance(text, str) else text
    lines = F.translate(F.replace(F.lower(F.coalesce(column, F.lit(""))), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    marked = F.concat(F.lit("\n\n"), lines, F.lit("\n\n"))
    for pattern, mark in _REST:
        marked = F.regexp_replace(marked, pattern, mark)
    known = sorted({t for texts in sentences.values() for t in texts}, key=lambda t: (-len(t), t))
    either = "|".join(t.replace(" ", "[ S]++") for t in known)
    found = F.regexp_extract_all(marked, F.lit(f"(?<=[HS] ?)(?:{either})(?= ?[HS])"), F.lit(0))
    words = F.transform(found, lambda s: F.regexp_replace(s, "[ S]+", " "))
    return F.array_join(F.transform(words, lambda s: _known(s, sentences)), "")


def _known(sentence: Column, sentences: dict[str, list[str]]) -> Column:
    """The identifier or null; the length is asked first, which rules most sentences out cheaply."""
    by_length: dict[int, list[tuple[str, str]]] = {}
    for name, texts in sentences.items():
        for text in texts:
            by_length.setdefault(len(text), []).append((text, name))
    found = None
    for length, known in sorted(by_length.items()):
        inner = None
        for text, name in known:
            inner = (F if inner is None else inner).when(sentence == text, f"<{name}>")
        found = (F if found is None else found).when(F.length(sentence) == length, inner)
    return found


def scan(documents: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id``, the licences in rule order, the sequence of known sentences and its unused rest."""
    marks = ["".join(f"<{name}>" for name in names) for _, names in rules]
    found = documents.select("doc_id", sequence(text, sentences).alias("sentences"))
    rest = reduce(lambda column, mark: F.replace(column, F.lit(mark), F.lit("")), marks, F.col("sentences"))
    stated, left = [], F.col("sentences")
    for (licence, _), mark in zip(rules, marks):
        stated.append(F.when(F.contains(left, F.lit(mark)), F.lit(licence)))
        left = F.replace(left, F.lit(mark), F.lit(""))
    names = F.array_distinct(F.array_compact(F.array(*stated)))
    known = F.col("sentences") != ""
    return found.select(
        "doc_id",
        F.when(known, names).otherwise(F.array().cast("array<string>")).alias("licences"),
        "sentences",
        F.when(known, rest).otherwise(F.lit("")).alias("rest"),
    )
