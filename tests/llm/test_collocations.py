import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from airmetrics.llm import collocations
from airmetrics.llm.oracle import COLLOCATIONS
from tests.llm.helpers import documents

LOWER = {c: c + 32 for c in range(65, 91)}


def _counts(rows):
    found, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                found[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    return found, totals


def _brute(rows, at_least=10, top=2000):
    found, totals = _counts(rows)
    out = []
    for lang, counts in found.items():
        often = {p: a for p, a in counts.items() if a >= at_least and len(p) > 1}
        covered = {q for p, a in often.items() if len(p) == 3 for q in (p[:2], p[1:]) if a * 100 >= counts[q] * 50}
        scored = []
        for p, a in often.items():
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in covered:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def _found(frame):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def _prose(seed, texts, vocabulary=25, marks=" , .\t\n; "):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeéß日Ä") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [
        "".join(rng.choice(names) + rng.choice([" ", " ", "  ", " ", *marks]) for _ in range(rng.randint(0, 120)))
        for _ in range(texts)
    ]


def test_hard_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(collocations, "STREAM_ROWS", 40)  # many partitions: carried counts matter
    texts = _prose(1, 60)
    rows = [(k, t, ["en", "de", None, "und"][k % 4], None, 0) for k, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "x", 1)] * 12 + [(1, None, "en", None, None), (2, "", None, None, None)]
    rows += [(3, "Don't STOP\x0bnow " * 40, "fr", None, None), (4, "x" * 300_000 + " y z " * 20, "fr", None, None)]
    frame = documents(spark, rows, "doc_id long, text string, lang string, phrase string, f long")
    plain = [(r[1], r[2]) for r in rows]
    assert _found(collocations.collocations(frame)) == _brute(plain)
    few = collocations.collocations(frame, at_least=3, top=7)
    assert _found(few) == _brute(plain, 3, 7)


def test_the_sql_equals_brute_force():
    rows = [(t, [None, "en"][k % 2]) for k, t in enumerate(_prose(4, 50))]
    con = duckdb.connect()
    con.sql("create table documents (text varchar, lang varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(tuple(r) for r in con.sql(COLLOCATIONS).fetchall()) == _brute(rows)


@pytest.mark.parametrize("run_words", [5, 17, 1000])
def test_runs_lose_no_phrase(monkeypatch, run_words):
    """Phrases across the borders of runs and slices are counted once."""
    monkeypatch.setattr(collocations, "RUN_WORDS", run_words)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 50)
    rows = [(t, ["en", "de"][k % 2]) for k, t in enumerate(_prose(2, 30))]
    batch = pa.RecordBatch.from_pylist(
        [{"text": t.encode(), "lang": lang} for t, lang in rows], schema=pa.schema([("text", pa.binary()), ("lang", pa.string())])
    )
    found = defaultdict(Counter)
    for run in collocations._runs([batch]):
        for size in (1, 2, 3):
            words, counts = run.counted(run.ends(size), size)
            for *ids, count in zip(*words, counts):
                lang = run.langs[int(ids[0])].as_py()
                found[lang][tuple(run.texts[int(k)].as_py().decode() for k in ids)] += int(count)
    assert found == _counts(rows)[0]


def test_empty_tables(spark):
    frame = documents(spark, [])
    assert collocations.collocations(frame).count() == 0
    assert collocations.collocations(documents(spark, [(1, None)])).count() == 0


def test_large_counts_are_exact(spark):
    """The score's products pass 64 bits."""
    a, left, right = 3 * 10**15 + 1, 4 * 10**15 + 3, 5 * 10**15 + 7
    sql = "(1000000 * cast(f AS decimal(17, 0)) * f) div (cast(l AS decimal(19, 0)) * r) AS score"
    frame = spark.createDataFrame([(a, left, right)], "f long, l long, r long")
    assert frame.selectExpr(sql).first().score == 10**6 * a * a // (left * right)


def test_bits_have_no_false_negative(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = collocations._bitmap(spark.createDataFrame([(int(h),) for h in hashes], "hash long")).value
    assert collocations._may_be(bits, hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 5000).view(np.uint64)
    assert collocations._may_be(bits, others).mean() < 0.01
