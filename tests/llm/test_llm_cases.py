"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for each operator and stage."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wherescore.llm import components, decontaminate, exact, html, lines, mixing, pii, sharding, simhash, suffix, toxicity

PASSAGE = "zeta quorum brindle foxtrot amber lattice quiver mossy tundra velvet harbor signal copper meadow drift"
OTHER = "plain lines about the weather in the north and the rain that came over the hills in the early spring"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard string, bytes long, fp long, score double, rate double, component_id long, label long, seed long, item_id long, kind int, word string"


def rows_of():
    long_text = " ".join(f"word{i}" for i in range(30_000))
    data = [
        (1, PASSAGE, "en"),
        (2, PASSAGE, "en"),
        (2, PASSAGE, "en"),
        (3, "", "de"),
        (4, None, None),
        (None, OTHER, "en"),
        (None, None, None),
        (5, OTHER + "\n" + PASSAGE, "fr"),
        (6, long_text, "es"),
        (7, "  \n\t \n", "en"),
        (8, "ünï cödé 😀 text", "de"),
    ]
    return [(i, t, lang, "s", 1, True, "x", 7, 9, 0.1, 2.0, 3, 4, 5, 6, 7, "w") for i, t, lang in data]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (None, None), (2, "too short"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 1), (5, 0, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")


def test_exact(docs, none):
    found = exact.exact_dedup(docs).collect()
    assert len(found) == 11 and exact.exact_dedup(none).count() == 0
    passage = [r for r in found if r.text_sha256 == hashlib.sha256(PASSAGE.encode()).hexdigest()]
    assert [(r.keep_id, r.group_size) for r in passage] == [(2, 3)] * 3 and sum(r.kept for r in passage) == 1
    empty = [r for r in found if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {(r.doc_id, r.keep_id, r.kept) for r in empty} == {(3, 4, False), (4, 4, True), (None, 4, False)}


def test_exact_filter_loses_nothing(spark):
    rows = spark.range(2_000).select((F.col("id") % 700).alias("n_bytes"), F.lit(1).alias("prefix"), "id")
    keys = rows.where("n_bytes < 350").select("n_bytes", "prefix").distinct()
    found = exact.surviving(rows, keys, bits=1 << 16)
    assert found.where("n_bytes < 350").count() == rows.where("n_bytes < 350").count()
    assert found.count() < 1.2 * rows.where("n_bytes < 350").count()


def test_shards(docs, none):
    found = sharding.assign_shards(docs, 400).collect()
    assert len(found) == 11 and sharding.assign_shards(none, 400).count() == 0
    sizes = {}
    for r in found:
        sizes.setdefault(r.shard, []).append(r.bytes)
    for r in found:
        assert (sum(sizes[r.shard]), len(sizes[r.shard])) == (r.shard_bytes, r.shard_docs)
        assert r.shard_bytes <= 400 or r.shard_docs == 1


def test_shards_of_one_large_key(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 1_500, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 40).alias("text"))
    found = sharding.assign_shards(rows, 1_000)
    assert found.count() == 3_000 and found.where("shard_bytes > 1000").count() == 0
    pages = found.where("shard like '%+%'")
    assert pages.count() == 1_500 and 60 <= pages.select("shard").distinct().count() <= 121  # at least half full
    names = [r.shard for r in found.where("shard not like '%+%'").select("shard").distinct().collect()]
    assert not any(a != b and b.startswith(a) for a in names for b in names)


def test_written_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, 400, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 11 and back.select("shard").distinct().count() > 2


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 11 and simhash.near_duplicates(none).count() == 0
    blank = [r for r in found if r.fp == 0]
    assert {r.component_id for r in blank} == {3} and len(blank) == 4
    assert {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "8", "None"]
    assert simhash.keep_one(none).count() == 0


def test_simhash_links_of_a_dense_family(spark):
    base = 0x123456789ABCDEF0
    values = sorted({base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(1, 64, 5)} | {0, 15, 31})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    expected = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert len(found) == len(expected) and {(r.a, r.b) for r in found} == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (None, 4), (5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix(docs, none):
    found = suffix.remove_repeats(docs).collect()
    assert len(found) == 11 and suffix.remove_repeats(none).count() == 0
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    n = len(PASSAGE)
    assert [r.n_removed for r in by_id[1]] == [0] and [r.n_removed for r in by_id[2]] == [n, n]
    assert bytes(by_id[5][0].kept).decode() == OTHER + "\n"
    assert sorted(r.n_removed for r in by_id[None]) == [0, len(OTHER)]  # the row without an id is last
    assert by_id[4][0].n_bytes == 0 and by_id[6][0].n_removed == 0


def test_suffix_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1 << 9)
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(900))
    rows = spark.createDataFrame([(1, text), (2, "ab" * 30 + text[700:2900] + "cd" * 40), (3, "ab" * 200)], "doc_id long, text string")
    found = {r.doc_id: r for r in suffix.remove_repeats(rows).collect()}
    assert found[1].n_removed == 0 and bytes(found[2].kept) == b"ab" * 30 + b"cd" * 40
    assert found[3].n_removed == 400


def test_decontamination(docs, none, benchmark, spark):
    found = {(r.doc_id, tuple(r["items"])) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(1, (1,)), (2, (1,)), (5, (1,))}
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 7
    swapped = PASSAGE.split()
    swapped[4], swapped[9] = "other", "words"
    few = [(1, "x " + " ".join(swapped) + " y"), (2, " ".join(swapped[:7] + ["n"] * 9)), (3, PASSAGE.upper().replace(" ", ", "))]
    assert {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(few, "doc_id long, text string"), benchmark).collect()} == {1, 3}


def test_personal_data(spark, docs, none):
    assert pii.personal_data(docs).count() == 11 and pii.personal_data(none).count() == 0
    text = (
        "mail a.b@c.d_e@f.gh at 1.2.3.4.5.6.7.8 or 999.1.1.1, card 4111 1111 1111 1111 and 4111111111111112; "
        "call +1 (415) 555-0100 or phone 415-555-0199, 212-555-0100; IBAN GB82 WEST 1234 5698 7654 32, GB83WEST12345698765432; "
        "social security 219-09-9999 or 219-09-9998 😀 x@y.z"
    )
    r = pii.personal_data(spark.createDataFrame([(1, text), (2, "7" * 120_000 + "@" + "a" * 60_000)], "doc_id long, text string")).collect()[0]
    value = lambda kind: [s.value for s in r[kind]]
    assert value("email") == ["a.b@c.d", "_e@f.gh", "x@y.z"] and value("ip") == ["1.2.3.4", "5.6.7.8"]
    assert "4111 1111 1111 1111" in value("card") and value("phone") == ["+1 (415) 555-0100"]
    assert value("iban") == ["GB82 WEST 1234 5698 7654 32"] and "219-09-9999" in value("ssn")
    assert "415-555-0199" in value("tel") and "415) 555-0100" not in str(value("tel"))
    assert all(text[s.start : s.end] == s.value for k in pii.BASE + pii.MORE for s in r[k.name])
    assert next(s.score for s in r["phone"]) > 0.5  # "call" stands before it


def test_personal_data_of_many_matches(spark):
    """Places and context words over many runs of matches, with characters of several bytes between them."""
    plain = "".join(f"é{'mail' if i % 3 else 'xx'} {'—' * (i % 60)} user{i}@host.example 10.0.{i % 300}.1; " for i in range(1000))
    found = pii.personal_data(spark.createDataFrame([(1, plain)], "doc_id long, text string")).first()
    emails = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain)]
    assert [(s.start, s.end, s.value) for s in found.email] == emails
    context = [bool(re.search("mail|contact|write|@", plain[max(0, a - 40) : a].lower())) for a, _, _ in emails]
    assert [s.score > 0.9 for s in found.email] == context and 0 < sum(context) < 1000
    assert len(found.ip) == sum(i % 300 <= 255 for i in range(1000))


def test_main_text(spark):
    page = (
        "<html><head><title>x</title></head><body class='has-sidebar'><header>Site</header><ul class='menu'><li>a<li>b</ul>"
        "<div id='cookie-notice'>We use cookies " + "c " * 60 + "</div><div class='content'><h1>T&amp;T</h1><p>Hello &lt;b&gt;\n world " + "x " * 60 + "</p>"
        "<p>more<br>text<script>if (a < b) {}</script></div><section class='comments'><p>Nice " + "y " * 60 + "</p></section><footer>&copy;</footer>"
    )
    pages = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "plain < text &am"), (4, "u", "<p>" * 20_000 + "<b>" * 20_000 + "end")]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[1] == "T&T\nHello <b> world " + " ".join("x" * 60) + "\nmore text"
    assert found[2] == found[3] == "" and found[None] == "plain < text &am" and found[4] == "end"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing(docs, none, spark):
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    found = mixing.rates(docs, labelled, mixing.TARGETS).collect()
    assert len(found) == 10 and sum(r.copies for r in found) == 11  # two rows are the same
    assert all(r.rate >= 0 for r in found)
    assert mixing.rates(none, none.select("doc_id", F.col("lang").alias("domain")), mixing.TARGETS).count() == 0
    grown = mixing.resample(docs, mixing.rates(docs, labelled, mixing.TARGETS, least=1.0, grow=True))
    assert grown.columns == docs.columns and grown.distinct().count() == docs.distinct().count()


def test_toxicity(docs, none, labels, spark):
    model = toxicity.fit(docs, labels)
    found = toxicity.score_documents(docs, model).collect()
    assert len(found) == 11 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_documents(none, model).count() == 0
    assert toxicity.fit(none, labels.limit(0)).score("anything") == pytest.approx(0.25)
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_swapped_terms_lower_the_weight_of_mentions(spark):
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        mention = "women" if toxic and i % 3 else "people"
        rows.append((i, f"{mention} are {'vermin' if toxic else 'there'} today number {'abcdefghij'[i % 10]}"))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    plain, fair = (toxicity.fit(docs, labels, fairness=f) for f in (0.0, 100.0))
    gap = lambda m: abs(m.score("women are here") - m.score("men are here"))
    assert plain.score("women are here") > fair.score("women are here") and gap(fair) < 0.5 * gap(plain)
    assert fair.score("people are vermin") > 0.5 > fair.score("people are there")


def test_lines(docs, none):
    found = lines.line_components(docs).collect()
    assert lines.line_components(none).count() == 0
    passage = [r for r in found if (r.keep_doc_id, r.keep_line) == (1, 0)]
    assert sorted((r.doc_id, r.line, r.kept) for r in passage) == [(1, 0, True), (2, 0, False), (2, 0, False), (5, 1, False)]
    assert [r.keep_doc_id for r in found if r.doc_id is None] == [5, None]  or [r.keep_doc_id for r in found if r.doc_id is None] == [None, 5]
    assert all(r.kept for r in found if r.doc_id == 7)
    back = lines.drop_lines(docs)
    assert back.columns == docs.columns and back.count() == 11
    assert {(r.doc_id, r.text) for r in back.where("doc_id in (1, 2, 3, 5, 7)").collect()} == {
        (1, PASSAGE), (2, ""), (3, ""), (5, OTHER), (7, "  \n\t \n"),
    }


@pytest.fixture(scope="module")
def folder(docs, benchmark, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("number", range(5))
def test_stage(spark, docs, none, folder, number):
    stage = corpus_pipeline.STAGES[number][1]
    assert stage(spark, none, folder).count() == 0
    found = stage(spark, docs, folder)
    assert number == 4 or found.columns == docs.columns
    assert set(found.select("doc_id").distinct().collect()) <= set(docs.select("doc_id").distinct().collect())


def test_stages_follow_each_other(spark, folder):
    sf_dir = "/root/testdata/sf0.001"
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in found} < set(given) and all(given[r.doc_id] == r.text for r in found)
    leaking = {r.doc_id for r in decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert leaking and not leaking & {r.doc_id for r in found}
    fps = sorted({simhash.fingerprint(r.text.encode(), corpus_pipeline.WIDTH) & ((1 << 64) - 1) for r in found})
    assert all((a ^ b).bit_count() > corpus_pipeline.MAX_BITS for a in fps for b in fps if a < b)
