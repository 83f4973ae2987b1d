from collections import Counter

from pyspark.sql import functions as F

from airmetrics.llm import jaccard_join
from airmetrics.llm.components import components
from airmetrics.llm.queries import op8_minhash_forest
from tests.llm.helpers import SF, documents, prose, shingles


def _brute(rows):
    """Links per document from all pairs of distinct shingle sets, and groups by flooding."""
    sets = {}
    for d, text in rows:
        if d is not None and (s := frozenset(shingles(text))):
            sets.setdefault(s, []).append(d)
    keys = list(sets)
    near = {k: set() for k in range(len(keys))}
    for i, a in enumerate(keys):
        for j in range(i):
            b = keys[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                near[i].add(j)
                near[j].add(i)
    links, group = {}, {}
    for k in range(len(keys)):
        reach, todo = {k}, [k]
        while todo:
            for other in near[todo.pop()] - reach:
                reach.add(other)
                todo.append(other)
        for d in sets[keys[k]]:
            links[d], group[d] = len(near[k]), min(x for r in reach for x in sets[keys[r]])
    return links, group


def _family(seed, count, size=120):
    """Near copies of one text, most of them linked, some only through others."""
    base = prose(seed, size).split()
    for k in range(count):
        own = list(base)
        for e in range(k % 4):
            own[(k * 17 + e * 31) % size] = f"edit{seed}x{k}x{e}"
        yield " ".join(own)


def test_near_copies_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_CLASSES", 8)
    rows = [(k, t) for k, t in enumerate(_family(1, 60))] + [(100 + k, t) for k, t in enumerate(_family(2, 9))]
    rows += [(200 + k, prose(50 + k, 100)) for k in range(20)]
    rows += [(300 + k, rows[0][1].upper()) for k in range(30)]
    links, group = _brute(rows)
    got = jaccard_join.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.links for r in got} == links
    assert {r.doc_id: r.class_id for r in got} == group
    assert {r.copy_of for r in got if r.doc_id >= 300} == {0}


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "!!"), (5, "?"), (None, "one two three"), (6, "one two three")]
    rows += [(7, prose(1, 50)), (7, prose(2, 50)), (8, prose(2, 50)), (9, "a"), (10, "A."), (11, "w " * 200_000)]
    docs = documents(spark, rows).withColumn("class_id", F.lit("clash"))
    got = Counter((r.doc_id, r.class_id, r.copy_of, r.links) for r in jaccard_join.near_duplicates(docs).collect())
    alone = [(k, k, k, 0) for k in (1, 2, 5, 6, 11)] + [(None, None, None, 0)]
    assert got == Counter(alone + [(3, 3, 3, 0), (4, 3, 3, 0), (7, 7, 7, 0), (7, 7, 7, 0), (8, 7, 7, 0), (9, 9, 9, 0), (10, 9, 9, 0)])
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_prefixes_shorten_to_the_target():
    assert jaccard_join.prefix_depth(0.8, 24, 8, 0.9) == 8
    assert jaccard_join.prefix_depth(0.8, 24, 8, 0.9999) == 5
    assert jaccard_join.prefix_depth(0.8, 1, 8, 0.9999) == 1


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (502, 501), (7, 7)]
    got = {r.child: r.parent for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {501: 500, 502: 500}


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    links, group = _brute(rows)
    got = op8_minhash_forest(spark, SF).collect()
    assert {r.doc_id: (r.links, r.class_id) for r in got} == {
        d: (links.get(d, 0), group.get(d, d)) for d, _ in rows
    }
