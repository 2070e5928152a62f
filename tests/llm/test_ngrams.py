"""Scores of the n-gram trie against a plain model, the trie's levels, and defined cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wherescore.llm import ngrams, trie

SCHEMA = "doc_id long, text string, row long, steps string, shard int"


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()) + [b""]


class Plain:
    """The model without shards, numbers and parts: interpolated absolute discounting over dictionaries."""

    def __init__(self, texts):
        self.c = Counter(w for t in texts for w in tokens(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.c3 = Counter(g for t in texts for g in self.grams(t))
        self.c2, self.nv, self.nuv, self.tv, self.tuv = (Counter() for _ in range(5))
        for (u, v, w), k in self.c3.items():
            self.c2[v, w] += k
            self.nv[v] += k
            self.nuv[u, v] += k
            self.tuv[u, v] += 1
        for v, _ in self.c2:
            self.tv[v] += 1

    @staticmethod
    def grams(text):
        s = [None, None, *tokens(text)]
        return zip(s, s[1:], s[2:], strict=False)

    def p1(self, w):
        return (self.c[w] + 1) / (self.n + self.v + 1)

    def p2(self, v, w):
        return (max(self.c2[v, w] - 0.75, 0) + 0.75 * self.tv[v] * self.p1(w)) / self.nv[v] if v in self.nv else self.p1(w)

    def p3(self, u, v, w):
        if (u, v) not in self.nuv:
            return self.p2(v, w)
        return (max(self.c3[u, v, w] - 0.75, 0) + 0.75 * self.tuv[u, v] * self.p2(v, w)) / self.nuv[u, v]

    def steps(self, u, v, w):
        q = lambda p: round(-math.log10(p) * trie.GRID)
        if (u, v, w) in self.c3 or (v, w) in self.c2 and (u, v) not in self.nuv:
            return q(self.p3(u, v, w))
        found = q(0.75 * self.tuv[u, v] / self.nuv[u, v]) if (u, v) in self.nuv else 0
        if (v, w) in self.c2:
            return found + q(self.p2(v, w))
        return found + (q(0.75 * self.tv[v] / self.nv[v]) if v in self.nv else 0) + q(self.p1(w))

    def score(self, text):
        return -sum(self.steps(*g) for g in self.grams(text)) / trie.GRID


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def make(n, seed=1, longest=60):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["The", "é", "THE"] * 40
    texts = [" ".join(draw.choices(words, k=draw.randrange(longest))) for _ in range(n)]
    texts[:4] = [None, "", " \t\n", "the the the the the the"]
    rows = [(draw.choice([None, 7, k]) if k % 50 == 0 else k, t, 1, "s", 2) for k, t in enumerate(texts)]
    return rows + rows[:60]


def check(spark, rows, parts=4, **limits):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    found = ngrams.score_documents(docs, limits=ngrams.Limits(**limits))
    model = Plain([r[1] for r in rows if not held_out(r[0])])
    expected = sorted(
        (r[0] is None, r[0] or 0, model.score(r[1]), held_out(r[0]), len(tokens(r[1])), sum(model.c[w] > 0 for w in tokens(r[1])), model.n)
        for r in rows
    )
    shown = found.rows.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.score, *r[1:5]) for r in shown) == expected
    base = sorted(sum(math.log10(model.p1(w)) for w in tokens(r[1])) for r in rows)
    assert sorted(r.base_score for r in shown) == pytest.approx(base)
    return found, model


def test_equals_plain_model(spark):
    found, _ = check(spark, make(400))
    assert found.tries.count() == 1


def test_many_chunks_and_shards(spark):
    """Pieces end within texts, chunks within tasks, and words, contexts and answers are dealt out over many shards."""
    rows = [*make(120), (1000, "long " * 3000 + "text " * 3000, 1, "s", 2), (1001, "x" * 5000 + " the end", 1, "s", 2)]
    found, _ = check(spark, rows, chunk_tokens=500, piece_bytes=300, vocabulary_words=90, shard_tokens=700)
    assert found.tries.count() > 10


def test_probabilities_add_up():
    model = Plain(["a b a c", "a b b", "c a b"])
    for u, v in [(None, None), (None, b"a"), (b"a", b"b"), (b"x", b"b"), (b"c", b"c")]:
        assert sum(model.p3(u, v, w) for w in [*model.c, b"unknown"]) == pytest.approx(1)


def test_parts_of_frequent_words(spark):
    """Words beyond the limit of a cell are parted; texts still score far better than by words alone, copies alike."""
    rows = [(k, t[1], 1, "s", 2) for k, t in enumerate(make(600, longest=40))]
    rows += [(5000 + k, "the same words for everyone and then " + str(k % 9), 1, "s", 2) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    parted = ngrams.score_documents(docs, limits=ngrams.Limits(cell_tokens=50, shard_tokens=500)).rows.collect()
    assert len(parted) == len(rows)
    by_text = {}
    for r in parted:
        by_text.setdefault(rows[r.doc_id][1] if r.doc_id < 5000 else rows[len(rows) - 400 + r.doc_id - 5000][1], set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(r.score > 0.6 * r.base_score for r in parted if r.doc_id >= 5000)
    model = ngrams.Vocabulary(None, np.array([0, 1]), np.array([1000, 30]), 4000, 100, 400, ngrams.Limits(cell_tokens=50))
    v, u = np.zeros(1000, np.int64), np.arange(1000) % 90 + 1
    some = ngrams.cells(v, u, np.arange(1000), model)
    assert len(np.unique(some)) > 15 and all(len(np.unique(some[u == k])) == 1 for k in range(1, 90))
    hot = ngrams.cells(v, v, np.arange(1000), model)  # the same pair everywhere: by the text
    assert len(np.unique(hot)) == 20 and np.unique(hot, return_counts=True)[1].max() <= 60


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngrams.score_documents(none).rows.collect() == []
    unseen = spark.createDataFrame([(k, "no training text", 1, "s", 2) for k in range(40) if held_out(k)], SCHEMA)
    assert {tuple(r)[1:] for r in ngrams.score_documents(unseen).rows.collect()} == {(True, 4, 0, 0, 0.0, 0.0)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 50), max_size=80))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    assert (trie.elias_fano_values(np.frombuffer(trie.elias_fano(values), np.uint8)) == values).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 5)] * 3, st.integers(1, 3)), max_size=40), st.lists(st.tuples(*[st.integers(0, 7)] * 3), max_size=20))
def test_trie_of_small_numbers(entries, asked):
    p1 = lambda w: 1 / (w + 2.0)
    cell, u, w, n = np.array(entries or np.zeros((0, 4)), np.int64).reshape(-1, 4).T
    found = trie.Trie(trie.build(cell, u, w, n, p1)).score(*np.array(asked or np.zeros((0, 3)), np.int64).reshape(-1, 3).T, p1)
    model = Plain([])
    model.p1 = p1
    for c, a, b, k in entries:
        model.c3[a, c, b] += k
    for (a, c, b), k in model.c3.items():
        model.c2[c, b] += k
        model.nv[c] += k
        model.nuv[a, c] += k
        model.tuv[a, c] += 1
    model.tv = Counter(c for c, _ in model.c2)
    assert found.tolist() == [model.steps(a, c, b) for c, a, b in asked]


def test_parts_do_not_change_scores(spark):
    """Words, pairs and starts beyond the limit of a cell score as in the plain model, whatever the limit is."""
    rows = [*make(300, longest=40), *[(5000 + k, "the same words for everyone and the the " + str(k % 9), 1, "s", 2) for k in range(300)]]
    found, _ = check(spark, rows, cell_tokens=20, shard_tokens=500, chunk_tokens=900)
    assert found.tries.count() > 10


def test_messages_are_shuffled_once(spark):
    """The exchange of counts between the shards reads the shuffle that the tries are built from."""
    docs = spark.createDataFrame(make(200), SCHEMA)
    limits = ngrams.Limits(cell_tokens=20, shard_tokens=500)
    chunked = ngrams.chunks(docs, ~ngrams.held_out(), limits)
    model = ngrams.vocabulary(chunked, 200, limits)
    found = ngrams._answered(ngrams.ngrams(chunked, model, 8), ngrams.replace(model, numbers=None), 8)
    assert model.parted() and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert "ReusedExchange" in final and final.count("_sent") <= 1 and final.count("FlatMapCoGroupsInArrow") == 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=9), min_size=1, max_size=9))
def test_steps_within_runs(runs):
    values = np.concatenate([np.sort(np.array(r, np.int64)) for r in runs])
    first = np.cumsum([0, *map(len, runs)])[:-1]
    assert (ngrams.without_steps(ngrams.within(values, first), first) == values).all()


def test_words_before_are_sent_as_steps():
    """A word that follows many others costs less than two bytes for each of these."""
    n = 20000
    chunk = ngrams._Chunk()
    chunk.add((0, 0, 1, 1), 0, [x for k in np.random.default_rng(3).permutation(n) for x in (b"%d" % k, b"the", b"end")], 0)
    row = chunk.row(0)
    model = ngrams.Vocabulary(None, np.array([0, 2]), np.array([n, 1]), 3 * n, n + 2, 1, ngrams.Limits())
    numbers = np.arange(len(chunk.words)) + 1
    sent = [ngrams.unpack(m[3]) for m in ngrams._sent(row, [ngrams.pack(numbers)], model, 1) if m[1] == ngrams._NGRAMS]
    assert len(sent) == 1 and len(ngrams.pack(sent[0][2])) < 1.5 * len(sent[0][2])
    cell, u, w, learnt = ngrams._entries(sent)
    assert len(cell) == len(np.unique(np.stack([cell, u, w]), axis=1).T) and learnt.sum() == 3 * n
    assert (np.lexsort((w, u, cell)) == np.arange(len(cell))).all()
