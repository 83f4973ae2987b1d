import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from airmetrics.llm import sharding
from airmetrics.llm.queries import op3_virtual_slots
from tests.llm.helpers import SF, documents


def test_every_document_has_one_place(spark):
    rows = op3_virtual_slots(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    places = defaultdict(list)
    loads = Counter()
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        places[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(places) <= set(range(16))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r.size for r in rows)
    assert max(loads.values()) <= max(largest, 1.02 * sum(loads.values()) / 16)


def test_plan_is_longest_first():
    """Brute force: the lightest shard is searched anew for every slot."""
    weights = {k: (k * 7919) % 1000 for k in range(300)}
    placed = sharding.plan(weights, 7, 300)
    loads, counts = [0] * 7, [0] * 7
    for slot in sorted(weights, key=lambda s: (-weights[s], s)):
        shard = min(range(7), key=lambda x: (loads[x], counts[x], x))
        assert placed[slot] == shard
        loads[shard] += weights[slot]
        counts[shard] += 1


def test_rebalancing_moves_little():
    weights = {k: 100 + k % 13 for k in range(400)}
    placed = sharding.plan(weights, 8, 400)
    assert sharding.rebalance(placed, weights, 8) == placed
    grown = sharding.rebalance(placed, weights, 9)
    moved = [s for s in placed if placed[s] != grown[s]]
    assert all(grown[s] == 8 for s in moved) and 35 <= len(moved) <= 55
    shrunk = sharding.rebalance(placed, weights, 7)
    assert set(shrunk.values()) == set(range(7))
    assert all(shrunk[s] == placed[s] or placed[s] == 7 for s in placed)


def test_maps_are_versioned(spark, tmp_path):
    first = sharding.plan({1: 5, 2: 9}, 2, 8)
    sharding.save_map(spark, str(tmp_path), 1, first)
    sharding.save_map(spark, str(tmp_path), 2, first | {3: 0})
    assert sharding.load_map(spark, str(tmp_path), 1) == first
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(spark, str(tmp_path), 1, first)


def test_defined_results(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None), (3, ""), (4, "ü" * 3_000_000)]
    docs = documents(spark, rows).withColumn("slot", F.lit("clash")).withColumn("shard", F.lit(1.5))
    got = sharding.shard_documents(docs, 3).collect()
    assert sorted(r.size for r in got) == [1, 1, 2, 2, 2, 2, 6_000_001]
    assert len({(r.shard, r.slot) for r in got}) == len(rows)
    assert sharding.shard_documents(docs.limit(0), 3).count() == 0
