"""Benchmark items and documents of many tokens, and seeds that are not broadcast."""

import time

from wherescore.llm import decontaminate


def _found(spark, docs, items):
    given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, tuple(r["items"]), r.n_overlaps) for r in decontaminate.contaminated(*given).collect()}


def test_item_of_many_tokens(spark):
    words = [f"w{i}" for i in range(20_000)]
    changed = ["other" if i % 20 == 5 else w for i, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, "before " + " ".join(changed)), (3, " ".join(words[::2])), (4, None), (1, " ".join(words))]
    begin = time.monotonic()
    assert _found(spark, docs, [(7, " ".join(words)), (7, " ".join(words)), (8, None)]) == {(1, (7,), 1), (2, (7,), 1)}
    assert time.monotonic() - begin < 60


def test_seeds_that_are_not_broadcast(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}t{n}" for n in range(8 + k))) for k in range(12)]
    docs = [(k, f"a b {text} c d") for k, text in items] + [(100 + k, text[8:]) for k, text in items]
    broadcast = _found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert _found(spark, docs, items) == broadcast
    assert {d for d, _, _ in broadcast} >= set(range(12))


def test_null_and_repeated_ids(spark):
    text = " ".join(f"t{n}" for n in range(20))
    docs = [(None, text), (0, text), (0, "x " + text), (5, "clean words only in this short text here"), (6, "")]
    assert _found(spark, docs, [(None, text), (3, text)]) == {(None, (3,), 2), (0, (3,), 2)}
    assert _found(spark, [], [(3, text)]) == set() == _found(spark, docs, [])
