import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing
from tidemark.llm.queries import tokenizer


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(docs, corpus, reference):
    got = packing.pack(docs, tokenizer(), size=256, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in corpus:
        want = [*reference(t), 1]
        rows = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in rows] == list(np.cumsum([0, *[r.length for r in rows]])[:-1])
        assert np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4").tolist() == want and rows[0].doc_tokens == len(want)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *[r.length for r in rows]])[:-1]) and rows[-1].offset + rows[-1].length <= 256
    total = sum(r.length for r in got)
    assert total / (256 * len(by_seq)) > 0.95


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), min_size=1))
def test_patterns_use_the_histogram_exactly(histogram):
    patterns = packing.shortest_pack_first(histogram, 32)
    used = {}
    for count, lengths in patterns:
        assert sum(lengths) <= 32 and count > 0
        for n in lengths:
            used[n] = used.get(n, 0) + count
    assert used == histogram


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\t", "\x1c", " ", "'s", "don't", ".", '"', "<|endoftext|>", "é", "日本", "12"]), st.text(max_size=5)), max_size=12).map("".join))
def test_pieces_encode_as_whole_texts(reference, text):
    ids = list(packing.Encoder.of(tokenizer()).encode([text]))[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference(text)


def test_long_texts_in_parts(reference, monkeypatch):
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    text = "some words, and  more\n\nwords. " * 30 + "x" * 200 + " end"
    assert np.frombuffer(list(packing.Encoder.of(tokenizer()).encode([text]))[0], "<u4").tolist() == reference(text)


def test_a_small_memory_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 5)
    texts = [f"alpha beta {k} gamma, delta{k}" for k in range(50)]
    e = packing.Encoder(tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in e.encode([t])] == [reference(t) for t in texts]


def test_empty_and_nulls(spark, empty):
    assert packing.pack(empty, tokenizer()).count() == 0
    got = packing.pack(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string"), tokenizer()).collect()
    assert [(r.length, r.doc_tokens) for r in got] == [(1, 1)] * 3 and sorted(r.offset for r in got) == [0, 1, 2]


def test_a_worker_keeps_little_between_tasks(reference, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_ENTRIES", 20)
    e = packing.Encoder(tokenizer())
    texts = [f"alpha beta {k} gamma, delta{k} end." for k in range(200)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [reference(t) for t in texts]
        e.rest()
        assert len(e.known) == 20 and " beta" in e.known and not e.older


def test_tasks_end_with_small_caches_and_read_small_batches(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(400).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 400), x -> concat('word', id * 400 + x))) as text").coalesce(1)
    assert packing.pieces(docs, tokenizer()).count() >= 400
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    path = tokenizer()
    held = spark.range(1).coalesce(1).mapInPandas(lambda it, p=path: (b.assign(id=len(packing._encoders[p].known) if p in packing._encoders else 0) for b in it), "id long").first()[0]
    assert held <= packing.KEPT_ENTRIES
