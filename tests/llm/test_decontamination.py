from pyspark.sql import functions as F

from airmetrics.llm import decontamination
from airmetrics.llm.common import shingle_hashes, word_hashes
from airmetrics.llm.queries import op4_simhash_windows
from tests.llm.helpers import SF, documents, prose, shingles


def _similar(one, other):
    from collections import Counter

    a, b = Counter(one), Counter(other)
    return sum((a & b).values()) / sum((a | b).values())


def _brute(texts, items, threshold=0.8):
    """Every window of every text against every item."""
    found = set()
    for d, text in texts:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if not have or not want or not set(have) & set(want):
                continue
            width = min(len(want), len(have))
            if any(_similar(have[k : k + width], want) >= threshold for k in range(len(have) - width + 1)):
                found.add((d, i))
    return found


def test_planted_passages(spark):
    items = [(k, prose(k, 14 + 3 * k)) for k in range(12)] + [(50, "tiny item"), (51, None), (52, "")]
    texts = []
    for k in range(12):
        parts = items[k][1].split()
        altered = parts[:-1] + ["changed"]
        texts.append((k, prose(100 + k, 300) + " " + items[k][1].upper() + ". " + prose(200 + k, 50)))
        texts.append((100 + k, prose(300 + k, 80) + " " + " ".join(altered) + " " + prose(400 + k, 9)))
        texts.append((200 + k, prose(500 + k, 200)))
        texts.append((300 + k, " ".join(parts[: len(parts) // 2])))
    texts += [(900, "tiny item"), (901, "a tiny item here"), (902, None), (903, "")]
    docs = documents(spark, texts).withColumn("similarity", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert got == _brute(texts, items)
    assert {(k, k) for k in range(12)} <= got and (900, 50) in got and (901, 50) not in got
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - {d for d, _ in got}


def test_passes_over_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 5)
    items = [(k, prose(k, 20)) for k in range(23)]
    docs = documents(spark, [(k, prose(99, 30) + " " + items[k][1]) for k in range(23)] * 2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()) == sorted(
        [(k, k) for k in range(23)] * 2
    )
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.leaks(docs.limit(0), bench).count() == 0
    assert decontamination.without_leaks(docs, bench.limit(0)).count() == 46


def test_index_finds_every_item_within_the_radius():
    """Brute force over all pairs of fingerprints."""
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 256, (300, 8), dtype=np.uint8)
    windows = prints[rng.integers(0, 300, 200)] ^ (rng.random((200, 8)) < 0.3) * rng.integers(0, 256, (200, 8), dtype=np.uint8)
    index = decontamination.SizeIndex(np.arange(300), prints, 23)
    far = np.bitwise_count(windows[:, None] ^ prints[None]).sum(axis=2)
    assert set(map(tuple, index.candidates(windows).tolist())) == set(map(tuple, np.argwhere(far <= 23).tolist()))


def test_windows_of_a_long_text_in_pieces(monkeypatch):
    item = prose(5, 30)
    text = " ".join([prose(6, 40), item] * 20)
    known = decontamination.Benchmark([1], [item])
    whole = known.matches(text)
    monkeypatch.setattr(decontamination, "_PIECE", 7)
    assert known.matches(text) == whole == {0: (1.0, 40)}
    assert len(shingle_hashes(word_hashes(text))) == 20 * 70 - 4


def test_query_matches_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op4_simhash_windows(spark, SF).collect()}
    assert got == _brute(texts, items)
