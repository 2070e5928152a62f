"""Pairs of near lines: counts by hash, the exact bound, and lines near a large group."""

import random

import numpy as np

from wherescore.llm import lines


def test_parities_are_an_exact_bound_and_counts_by_hash_are_exact():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=draw.randrange(1, 9))) for _ in range(400)]
    first = [" ".join(draw.choices(words, k=draw.randrange(1, 90))) for _ in range(300)]
    second = [" ".join(draw.choice(words) if draw.random() < 0.04 * (k % 4) else w for w in x.split()) for k, x in enumerate(first)]
    expected = [lines.jaccard(x, y) >= lines.SIMILARITY for x, y in zip(first, second, strict=True)]
    assert lines.similar(first, second).tolist() == expected and 50 < sum(expected) < 250
    sets = [[{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in group] for group in (first, second)]
    bits = np.bitwise_count((lines.parities(first) ^ lines.parities(second)).view(np.uint64)).sum(axis=1)
    assert all(b <= len(s ^ t) for b, s, t in zip(bits, *sets, strict=True))


def test_lines_near_a_large_group_are_not_tried_in_pairs(spark, monkeypatch):
    """Lines that miss the similarity to a family by little are compared with few of its lines, and all are placed rightly."""
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    base = draw.choices(words, k=60)
    edited = lambda n: " ".join(draw.choice(words) if k in places else w for places in [set(draw.sample(range(60), n))] for k, w in enumerate(base))
    rows = [(k, edited(1 if k < 120 else 6)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tried = []
    real = lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, texts: tried.append(pairs.count()) or real(pairs, texts))
    found = {r.doc_id: r.keep_doc_id for r in lines.line_components(docs).collect()}
    root = {k: k for k, _ in rows}
    for a in range(200):
        for b in range(a):
            if lines.jaccard(rows[a][1], rows[b][1]) >= lines.SIMILARITY and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert found == root and 1 < len(set(root.values())) and sum(tried) < 1000
