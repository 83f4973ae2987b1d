import math

import numpy as np
from pyspark.sql import functions as F

from airmetrics.llm import nearest
from airmetrics.llm.queries import op10_multi_index
from tests.llm.helpers import SF


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def _brute(rows, every, k=5):
    out = {}
    fine = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v, *_ in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    vectors = np.array([v for _, v in fine])
    for q, v in fine:
        if q % every == 0:
            scores = nearest.cosines(v, vectors)
            out[q] = sorted(((-s, i) for (i, _), s in zip(fine, scores) if i != q))[:k]
    return out


def test_recall_and_scores(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=16).tolist(), "x") for k in range(900)]
    got = nearest.nearest(_frame(spark, rows), F.col("vec_id") % 10 == 0, block_rows=200).collect()
    want = _brute(rows, 10)
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, best in want.items() for _, i in best} for r in got)
    assert len(got) == 450 and hits >= 0.9 * 450
    for r in got:
        exact = dict((i, -s) for s, i in _brute([rows[r.query_id], rows[r.vec_id]], 1)[r.query_id])
        assert r.score == exact[r.vec_id]


def test_pigeonhole_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (700, 4), dtype=np.uint8)
    index = nearest.MultiIndex(codes)
    for radius in (0, 3, 7, 11, 32):
        for q in range(0, 700, 97):
            far = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_defined_results(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.9, 0.1], ""), (2, [0.9, 0.1], ""), (3, [-1.0, 0.0], ""), (4, None, ""), (5, [], ""),
            (6, [0.0, 0.0], ""), (7, [float("nan"), 1.0], ""), (8, [None, 1.0], ""), (9, [1.0, 2.0, 3.0], ""),
            (10, [float("inf"), 1.0], ""), (None, [1.0, 1.0], ""), (12, [2.0, 0.0], "")]
    got = nearest.nearest(_frame(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 12), (2, 1), (3, 2), (4, 3)]
    assert got[0].score == 1.0
    assert nearest.nearest(_frame(spark, rows[4:8]), F.lit(True)).count() == 0
    assert nearest.nearest(_frame(spark, rows[:1]), F.lit(True)).count() == 0
    twice = nearest.nearest(_frame(spark, rows + rows[1:2]), F.col("vec_id") == 0).collect()
    assert [r.rank for r in twice] == [1, 2, 3, 4]


def test_equal_vectors_in_a_hot_group(spark):
    rows = [(k, [1.0, 2.0, 3.0, 4.0], "") for k in range(300)] + [(1000 + k, [float(k), 1.0, -2.0, 0.5], "") for k in range(50)]
    got = nearest.nearest(_frame(spark, rows), F.col("vec_id") == 150, block_rows=64).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_copies_of_an_id_take_one_place(spark):
    """The nearest id ten times, the query's own id twenty times, an id with more rows than a block."""
    rng = np.random.default_rng(11)
    rows = [(k, [1.0, 0.1 * k, 0.0, 0.0], "") for k in range(1, 8)]
    rows += [(1, [1.0, 0.1 + 0.001 * k, 0.0, 0.0], "") for k in range(1, 10)] + [(0, [1.0, 0.0, 0.0, 0.0], "")]
    copies = [(0, [1.0, -0.001 * k, 0.0, 0.0], "") for k in range(1, 20)]
    far = [(100 + k, (rng.normal(size=4) - [3, 0, 0, 0]).tolist(), "") for k in range(40)]
    hot = [(99, [-1.0, 0.001 * k, 1.0, 0.0], "") for k in range(200)] + [(99, [-1.0, 0.0, 1.0, 0.0], "")] * 200
    for some, block_rows in ((rows + far, 8192), (rows + copies + far, 8192), (rows + copies + far + hot, 64)):
        got = nearest.nearest(_frame(spark, some), F.col("vec_id") == 0, block_rows=block_rows).orderBy("rank").collect()
        assert [(r.rank, r.vec_id) for r in got] == [(k, k) for k in range(1, 6)]


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(q, i) for q, best in _brute(rows, 50).items() for _, i in best}
    got = {(r.query_id, r.vec_id) for r in op10_multi_index(spark, SF).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
