from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from airmetrics.llm import language_id, toxicity
from airmetrics.llm.common import read_table, stored
from tests.llm.helpers import SF, documents, prose
from tests.llm.test_decontamination import _brute as leaks
from tests.llm.test_jaccard_join import _brute as groups
from tests.llm.test_packing import _round_trip


def test_stages_match_brute_force(spark):
    """Each stage against a plain version of itself, on what the stage before kept."""
    docs = read_table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    model = toxicity.fit(docs, read_table(spark, SF, "labels"))
    want = {d: t for d, t in rows.items() if model.score(t) < 0.5}
    for (_, stage), after in zip(corpus_pipeline.STAGES, range(5)):
        if after == 1:
            filters = language_id.fit(docs)
            found = {d: (filters.predict(t), t) for d, t in rows.items()}
            want = {d: t for d, ((lang, _, share), t) in found.items() if lang != "und" and (share >= 0.1 or len(t) < 50)}
        elif after == 2:
            _, group = groups(rows.items())
            want = {d: t for d, t in rows.items() if group.get(d, d) == d}
        elif after == 3:
            items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
            gone = {d for d, _ in leaks(rows.items(), items)}
            want = {d: t for d, t in rows.items() if d not in gone}
        docs = stored(stage(spark, docs, SF), f"stage{after}")
        if after == 4:
            _round_trip(rows.items(), docs.collect(), 4096)
            return
        assert docs.columns == columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        assert rows == want and len(rows) > 50


def test_run_returns_pieces(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "ids"} <= set(pieces.columns)
    assert pieces.count() > 50


def test_one_of_each_group_stays(spark):
    text, other = prose(1, 80), prose(2, 80)
    rows = [(1, text), (1, text), (2, text.upper()), (3, other), (3, prose(3, 80)), (None, text), (None, None), (5, None)]
    kept = corpus_pipeline.without_near_duplicates(spark, documents(spark, rows), SF)
    found = defaultdict(int)
    for r in kept.collect():
        found[r.doc_id] += 1
    assert found == {1: 1, 3: 2, None: 1, 5: 1}


def test_rows_decide_not_ids(spark):
    """Copies without id, or under an id that other texts share, go like any others."""
    one, two, three = (prose(k, 90) for k in (11, 12, 13))
    rows = [(None, one)] * 3 + [(None, one + " end")] + [(7, two), (7, three), (8, three), (9, three + " more")]
    frame = documents(spark, [(*r, "x", 1) for r in rows], "doc_id long, text string, class_id string, rows int")
    kept = corpus_pipeline.without_near_duplicates(spark, frame, SF)
    assert kept.columns == frame.columns
    found = sorted((str(r.doc_id), r.text[:20]) for r in kept.collect())
    assert found == sorted([("None", one[:20]), ("7", two[:20]), ("7", three[:20])])


def test_empty_documents_pass_every_stage(spark):
    docs = read_table(spark, SF, "documents").limit(0).withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
