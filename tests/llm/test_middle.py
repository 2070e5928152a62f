"""Fill in the middle: conversions of the sparse index, cuts against plain slicing, exact round trips, defined cases."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wherescore.llm import middle

TEXT = st.text(st.sampled_from("ab Z9<>PSM\n.éßд中😀"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_index_of_exceptions(text):
    index = middle.Exceptions(np.frombuffer(text.encode(), np.uint8))
    assert len(index.places) == sum(len(c.encode()) > 1 for c in text)
    for k in range(len(text) + 1):
        at = len(text[:k].encode())
        assert index.to_chars(at) == k and index.to_bytes(k) == at


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 1 << 32), st.integers(0, 1 << 32))
def test_cuts_equal_plain_slices(text, first, second):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((first % (len(tokens) + 1), second % (len(tokens) + 1)))
    prefix, upto = "".join(tokens[:a]), "".join(tokens[:b])
    expected = (len(tokens), len(prefix.encode()), len(upto.encode()), len(prefix), len(upto))
    assert middle.cuts(text.encode(), first, second) == expected


def test_token_starts_over_blocks(monkeypatch):
    text = ("word 中 " * 50_000 + "x" * 200_000 + "é!").encode()
    tokens = middle.Tokens(np.frombuffer(text, np.uint8))
    starts = [m.start() for m in re.finditer(rb"[A-Za-z]+|[^A-Za-z\x80-\xff]|[\xc0-\xff][\x80-\xbf]*", text)]
    assert len(tokens) == len(starts) and tokens.start(len(starts)) == len(text)
    assert all(tokens.start(k) == starts[k] for k in range(0, len(starts), 997))


def test_rows(spark):
    texts = ["", None, "a <P> b", "x<S>", "<M>", "né " * 40_000, "ordinary text, with é and 中 and 😀."] + ["abc <S x P> 12 é"] * 60
    rows = [(None if k == 6 else k, t, "x", 1) for k, t in enumerate(texts)] + [(8, texts[8], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string, n int")
    found = middle.fill_in_middle(docs).withColumn("back", middle.restored()).collect()
    assert len(found) == len(rows)
    given_texts = {r[0]: r[1] or "" for r in rows}
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        text = given_texts[r.doc_id]
        assert r.back == text and r.n == len(re.findall("[A-Za-z]+|[^A-Za-z]", text))
        digest = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        assert r.form == ("plain" if plain else "spm" if h[3] % 100 < 20 else "psm")
        if plain:
            assert r.output == text and r.prefix_chars is None and r.middle_chars is None
            continue
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        a, b = sorted((h[0] % (r.n + 1), h[1] % (r.n + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
        assert (r.prefix_chars, r.middle_chars) == (len(p), len(m))
    assert middle.fill_in_middle(docs.limit(0)).collect() == []


def test_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    forms = {r.form: r["count"] for r in middle.fill_in_middle(docs, 30, 50).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 1200) < 150 and abs(forms["spm"] - 1400) < 150 and abs(forms["psm"] - 1400) < 150
