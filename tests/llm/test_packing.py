import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airmetrics.llm import packing
from airmetrics.llm.queries import op7_bounded_packing
from airmetrics.llm.tokens import Encoder, vocabulary_path
from tests.llm.helpers import SF, documents, prose

VOCABULARY = "word_bpe_49k.json"


def _plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(VOCABULARY))


@pytest.mark.parametrize(
    "text",
    ["", "Hello, World's  best\tTest!! 12½ _x_ a'll''s", "Éèß İSTANBUL Σίσυφος ΟΔΟΣ", "日本語 \x1c\u200b x", "é e\u0301",
     "<|endoftext|> in <|startoftext|>text", "don't-stop...(ok)\x85next\xa0one\u2028z", "ǅ ŉ ſ ª ²³ x" * 50],
)
def test_ids_equal_the_tokenizer(text):
    encode = Encoder(VOCABULARY, kept=2000)
    for _ in range(2):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == _plain().encode(text, add_special_tokens=False).ids


def test_every_vocabulary_is_encoded():
    from tokenizers import Tokenizer

    name = "byte_bpe_50k.json"
    want = Tokenizer.from_file(vocabulary_path(name)).encode("Any text, here.", add_special_tokens=False).ids
    assert np.frombuffer(Encoder(name)("Any text, here."), dtype="<u4").tolist() == want


def _round_trip(rows, pieces, capacity):
    """Exact: pieces rebuild the documents, sequences have no gap and no overflow."""
    plain = _plain()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert p.length > 0 and p.ids_crc32 == zlib.crc32(p.ids)
    for doc_id, text in rows:
        want = plain.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc.pop(doc_id), key=lambda p: p.start)
        assert [t for p in own for t in np.frombuffer(p.ids, dtype="<u4").tolist()] == want
        assert {p.doc_tokens for p in own} == {len(want)} and own[0].start == 0
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_round_trip(spark):
    rows = [(k, prose(k, 5 + (k * 37) % 90)) for k in range(120)] + [(500, None), (501, ""), (502, prose(1, 3000))]
    docs = documents(spark, rows).repartition(3).withColumn("offset", F.lit("clash"))
    used = _round_trip(rows, packing.pack(docs, capacity=256, open_windows=4).collect(), 256)
    total = sum(len(_plain().encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert used <= 1.1 * total / 256 + 1


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [(1, "same text")] * 5 + [(None, "no id")])
    pieces = packing.pack(docs).collect()
    assert len(pieces) == 6 and len({(p.sequence_id, p.offset) for p in pieces}) == 6
    assert packing.pack(docs.limit(0)).count() == 0


def test_windows_stay_bounded():
    """Brute force: best fit over all open windows, the fullest leaves when none fits."""
    windows, open_, sizes = packing.OpenWindows(100, 5), {}, {}
    for k in range(400):
        length = 1 + (k * 61) % 99
        fits = {w: room for w, room in open_.items() if room >= length}
        gone = None
        if fits:
            want = min(fits, key=lambda w: (fits[w], w))
        else:
            if len(open_) == 5:
                gone = min(open_, key=lambda w: (open_[w], w))
                del open_[gone]
            want = len(sizes)
            open_[want] = sizes[want] = 100
        offset = 100 - open_[want]
        open_[want] -= length
        if not open_[want]:
            del open_[want]
            gone = want
        assert windows.place(length) == (want, offset, gone)
        assert len(windows.free) <= 5


def test_query_round_trip(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    _round_trip(rows, pieces, 4096)
    digests = op7_bounded_packing(spark, SF)
    assert "ids" not in digests.columns
    assert {(r.doc_id, r.start, r.ids_crc32) for r in digests.collect()} == {(p.doc_id, p.start, p.ids_crc32) for p in pieces}


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(20,0)", "date"])
def test_ids_of_any_type(spark, kind):
    frame = documents(spark, [(1, "one two"), (None, "three")])
    ids = "date_from_unix_date(cast(doc_id as int))" if kind == "date" else f"cast(doc_id as {kind})"
    found = packing.pack(frame.selectExpr(f"{ids} AS doc_id", "text"))
    assert dict(found.dtypes)["doc_id"] == kind and found.count() == 2


def test_remembered_words_are_bounded_in_bytes():
    encode = Encoder(VOCABULARY, kept=30_000)
    for k in range(2000):
        encode(f"word{k} " * 3)
    assert len(encode.words) + len(encode.chunks) < 150
