import numpy as np
from pyspark.sql import functions as F

from airmetrics.llm import toxicity
from airmetrics.llm.queries import op9_string_kernel
from tests.llm.helpers import SF, documents, prose


def _model():
    clean = [prose(k, 60) for k in range(60)]
    bad = [prose(100 + k, 30) + f" you {('vylkrunt', 'skorzabe')[k % 2]} " + prose(200 + k, 30) for k in range(60)]
    return toxicity.train(clean + bad, [0] * 60 + [1] * 60)


def test_kernel_is_the_sum_over_shared_subsequences():
    """Brute force: all subsequences of four letters within the span, word ends included."""
    from collections import Counter
    from itertools import combinations

    def explicit(word):
        text, out = f" {word} ", Counter()
        for at in range(len(text)):
            for rest in combinations(range(1, toxicity.SPAN), toxicity.LETTERS - 1):
                if at + rest[-1] < len(text):
                    out[(text[at], *(text[at + k] for k in rest))] += toxicity.DECAY ** rest[-1]
        return out

    places = {}
    for word in ("idiot", "idxiot", "table"):
        at, place, weight = toxicity._kernel_rows([word])
        places[word] = Counter()
        for p, w in zip(place, weight):
            places[word][p] += w
    norm = {}
    for word in places:
        count = explicit(word)
        norm[word] = np.sqrt(sum(toxicity.DECAY ** (2 * r[-1]) for at in range(len(word) + 2)
                                 for r in combinations(range(1, toxicity.SPAN), 3) if at + r[-1] < len(word) + 2))
        assert len(count) == len(places[word])
    for a, b in (("idiot", "idxiot"), ("idiot", "table")):
        want = sum(v * explicit(b)[k] for k, v in explicit(a).items()) / norm[a] / norm[b]
        got = sum(v * places[b][k] for k, v in places[a].items())
        assert abs(want - got) < 1e-5


def test_gaps_and_inserted_characters_are_tolerated():
    model = _model()
    clean = max(model.score(prose(900 + k, 200)) for k in range(20))
    for insult in ("vylkrunt", "v.y.l.k.r.u.n.t", "v y l k r u n t", "VYLKRUNT!", "vylkkrunt", "vylk-runt", "skorzzabe", "skorz4abe"):
        assert model.score(f"{prose(7, 40)} {insult} {prose(8, 40)}") > max(0.5, clean), insult
    assert clean < 0.5


def test_defined_results(spark):
    model = _model()
    none = model.score(None)
    assert none == model.score("") == model.score("123 !!") < 0.5
    long = " ".join([prose(1, 400)] * 300) + " vylkrunt"
    assert model.score(long) > 0.5
    docs = documents(spark, [(1, None), (2, "vylkrunt"), (2, "vylkrunt"), (None, "x")]).withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.predicted) for r in toxicity.with_toxicity(docs, model).collect()]
    assert got == [(1, 0), (2, 1), (2, 1), (None, 0)]
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0
    unlabelled = toxicity.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert unlabelled.score("vylkrunt") < 1e-9


def test_tiny_samples_train_something():
    for texts, labels in (([], []), (["a"], [1]), (["a", "b"], [0, 1]), (["", "?"], [0, 1]), (["abc def", "ghi"], [0, 1])):
        assert 0 <= toxicity.train(texts, labels).score("abc") <= 1


def test_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    found = op9_string_kernel(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = found.select("score", "predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
