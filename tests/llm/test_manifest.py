"""Merkle manifest against a plain construction: nulls, repeated rows and ids, spread ids, several passes, tampering."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wherescore.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx string, tree int, size int"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5])


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


def siblings(tree, k):
    for nodes in tree[:-1]:
        run = k - k % 3
        yield nodes[run:k], nodes[k + 1 : run + 3]
        k //= 3


def plain(rows, change):
    """Rows of the manifest: doc_id, leaf, subroot, root, digest of the proof, folded root."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted(((r[0] is not None, r[0] or 0), leaf(r), r) for r in rows if r[1] == s) for s in sources} if rows else {}
    trees = {s: levels([x[1] for x in of[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for place, s in enumerate(sources):
        for k, (_, own, row) in enumerate(of[s]):
            proof = [*siblings(trees[s], k), *siblings(top, place)]
            folded = leaf((*row[:4], change(row)))
            for before, after in proof:
                folded = digest([*before, folded, *after])
            yield row[0], own, trees[s][-1][0], top[-1][0], digest(x for b, a in proof for x in b + a), folded


def of_spark(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = manifest.manifest(docs, tampered=F.replace("text", F.lit("x"), F.lit("")))
    shown = found.select("doc_id", "leaf", "subroot", "root", manifest.proof(), manifest.folded("seen"))
    return sorted(map(str, map(tuple, shown.collect())))


def expected(rows, change=lambda r: r[4] and r[4].replace("x", "")):
    return sorted(map(str, plain(rows, change)))


def make(n, ids, sources, seed=1):
    draw = random.Random(seed)
    return [(ids(draw), draw.choice(sources), None, draw.choice([None, 3]), draw.choice([None, "", "x y", "é"]), "c", 1, 2) for _ in range(n)]


@pytest.mark.parametrize(
    "ids",
    [
        lambda d: d.randrange(900),
        lambda d: d.choice([None, 5, 5, 5, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, d.randrange(-70, 70)]),
        lambda d: d.getrandbits(64) - (1 << 63),
    ],
    ids=["dense", "null and repeated", "spread"],
)
def test_equals_plain_construction(spark, ids):
    rows = make(1500, ids, [None, "", "a", "a", "a", "é", "B"])
    assert of_spark(spark, rows) == expected(rows)


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SLOTS", 9)
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "RADIX", 2)
    rows = [(k, f"s{k % 100 if k % 3 else 0}", None, None, None, "c", 1, 2) for k in range(600)]
    nodes = spark.createDataFrame([("=" + r[1], r[0], leaf(r)) for r in rows], "tree string, id long, digest string")
    found = {(r.tree, r.idx): (r.id, r.size) for r in manifest.placed(nodes).collect()}
    of_hot = [r[0] for r in rows if r[1] == "s0"]
    assert [found["=s0", k] for k in range(len(of_hot))] == [(i, len(of_hot)) for i in of_hot]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 729, 730, 2200])
def test_sizes_of_a_source(spark, n):
    rows = [(k * 7, "a", "en", 1, str(k), "c", 1, 2) for k in range(n)]
    assert of_spark(spark, rows) == expected(rows)


def test_tampering_shows(spark):
    rows = make(300, lambda d: d.randrange(10_000), ["a", "b"])
    docs = spark.createDataFrame(rows, SCHEMA)
    found = manifest.manifest(docs, tampered=F.concat("text", F.when(F.col("doc_id") % 2 == 0, "!").otherwise("")))
    shown = found.select("doc_id", (manifest.folded("seen") == F.col("root")).alias("ok"), manifest.folded("leaf") == F.col("root"))
    texts = {(r[0], r[4]) for r in rows}
    for doc_id, ok, untouched in shown.collect():
        assert untouched and (ok or doc_id % 2 == 0)
        assert not ok or doc_id % 2 or (doc_id, None) in texts


def test_empty_table(spark):
    assert of_spark(spark, make(0, None, [])) == []
