"""Registered queries of the training-data operators against SQL or a plain version, over whole small tables."""

import collections
import hashlib
import html
import os
import re

import duckdb
import pytest
import xxhash

import __spark_entry__ as entry
from wherescore.llm import oracles, queries
from wherescore.llm.lines import jaccard

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def run(spark, name, sf_dir=SF_DIR):
    return entry.queries()[name](spark, sf_dir)


def texts(spark, sf_dir=SF_DIR):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_each_operator_has_a_query():
    names = set(queries.registered())
    assert {re.match(r"op(\d+)_|pipeline", n)[1] for n in names} == {*map(str, range(1, 14)), None}
    assert set(oracles.sql()) <= names <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracles.sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cursor = con.execute(oracles.sql()[name])
    columns = [d[0] for d in cursor.description]
    found = run(spark, name)
    assert sorted(found.columns) == sorted(columns)
    expected = sorted(map(str, cursor.fetchall()))
    assert expected and sorted(str(tuple(r)) for r in found.select(columns).collect()) == expected


def simhash(text, width):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def groups(nodes, linked):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


def test_simhash_equals_all_pairs(spark):
    fps = {i: simhash(t, 4) for i, t in texts(spark).items()}
    ids = sorted(fps)
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    expected = groups(ids, near)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op2_simhash").collect()}
    assert found == {i: (f"{fps[i]:016x}", expected[i]) for i in ids} and near


def test_suffix_dedup_equals_all_strings(spark):
    seen, expected = {}, {}
    for i, t in sorted(texts(spark).items()):
        data = t.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if seen.setdefault(data[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        expected[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    found = {r.doc_id: tuple(r)[1:] for r in run(spark, "op3_suffix_dedup").collect()}
    assert found == expected and any(x[1] for x in expected.values())


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_plain_expressions(spark):
    expected = {i: base_spans(t) for i, t in texts(spark).items()}
    for r in run(spark, "op6_personal_data").collect():
        spans = expected[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert set(spans) <= set(r.spans.split(","))
    assert any(expected.values())


def test_main_text_equals_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in run(spark, "op7_main_text").collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = (html.unescape(re.sub(r"</?b>|<br>", "", b)) for b in re.split(r"</?(?:p|h1)>", article))
        expected = "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        assert (r.text, r.n_chars) == (expected, len(expected))


def test_fuzzy_lines_equal_all_pairs(spark):
    places, every = {}, []
    for i, t in sorted(texts(spark).items()):
        for k, line in enumerate(t.split("\n")):
            every.append((i, k, line))
            if line.strip():
                places.setdefault(line, (i, k))
    sets = {x: {x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in places}
    by_shingle = collections.defaultdict(set)
    for x, s in sets.items():
        for g in s:
            by_shingle[g].add(x)
    linked = []
    for x, s in sets.items():
        rarest = sorted(s, key=lambda g: len(by_shingle[g]))[: len(s) - -(-len(s) * 8 // 10) + 1]
        near = set().union(*(by_shingle[g] for g in rarest))
        linked += [(places[x], places[y]) for y in near if x != y and jaccard(x, y) >= 0.8]
    root = groups(places.values(), linked)
    found = {(r.doc_id, r.line): ((r.keep_doc_id, r.keep_line), r.kept) for r in run(spark, "op10_fuzzy_lines").collect()}
    expected = {(i, k): root[places[x]] if x.strip() else (i, k) for i, k, x in every}
    assert found == {p: (to, to == p) for p, to in expected.items()} and linked


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = run(spark, "op9_toxicity", sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    rows = found.where("held_out and toxic is not null").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_mix_reaches_targets(spark):
    from wherescore.llm.mixing import TARGETS

    found = run(spark, "op8_mix").collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(found) == len(langs) and all(r.rate >= 0 for r in found)
    total = sum(r.tokens for r in found)
    for d, share in TARGETS.items():
        assert sum(r.rate * r.tokens * r[f"p_{d}"] for r in found) == pytest.approx(share * total, rel=0.01)
    best = [max(TARGETS, key=lambda d, r=r: r[f"p_{d}"]) == langs[r.doc_id] for r in found if r.tokens > 20]
    assert sum(best) > 0.95 * len(best)
