import base64
import random

import pytest
from pyspark.sql import functions as F

from wherescore.functions import text

RESPONSES = [
    ("REASONING: x\nCOUNTRY: Japan", "Japan"),
    ("country:   uk.", "United Kingdom"),
    ("COUNTRY:\n\n  Japan \nmore", "Japan"),
    ("REASONING: The country: maybe Laos.\nCOUNTRY: Thailand", "Maybe Laos"),
    ("**COUNTRY:** Japan", "** Japan"),
    ("COUNTRY: U.K.", "U.K"),
    ("COUNTRY: u.s.a", "U.S.A"),
    ("COUNTRY: US.", "United States"),
    ("COUNTRY: Japan (Tokyo)", "Japan (Tokyo)"),
    ("COUNTRY: Japan. ,", "Japan."),
    ("COUNTRY: ...", ""),
    ("COUNTRY:   ", "PARSE_ERROR"),
    ("COUNTRY:", "PARSE_ERROR"),
    ("COUNTRY:\n\n", "PARSE_ERROR"),
    ("no answer", "PARSE_ERROR"),
    ("IMAGE_NOT_FOUND", "PARSE_ERROR"),
    ("", "PARSE_ERROR"),
    (None, "PARSE_ERROR"),
    ("COUNTRY: Guinea-Bissau", "Guinea-Bissau"),
    ("COUNTRY: Côte d'Ivoire", "Ivory Coast"),
    ("COUNTRY: côte d’ivoire", "Côte D’Ivoire"),
    ("COUNTRY: Korea ", "South Korea"),
    ("COUNTRY: Japan\r\nfoo", "Japan"),
    ("COUNTRY: Japan foo", "Japan Foo"),
    ("COUNTRY: the Netherlands", "Netherlands"),
    ("COUNTRY: democratic republic of the congo", "Democratic Republic Of The Congo"),
    ("COUNTRY: Czech Republic", "Czechia"),
    ("x COUNTRY: India COUNTRY: Nepal", "India Country: Nepal"),
    ("COUNTRY: 3rd world", "3Rd World"),
    ("COUNTRY: UNITED STATES (ALASKA)", "United States"),
    ("COUNTRY:\x1cJapan\x1f", "Japan"),
    ("COUNTRY:\nCOUNTRY: Japan", "Country: Japan"),
]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_parser_corpus(spark):
    assert column(spark, [r for r, _ in RESPONSES], text.parse_country) == [e for _, e in RESPONSES]


def test_parser_corpus_with_lookup_join(spark):
    from wherescore.operators.score import add_prediction

    rows = spark.createDataFrame(
        [(i, r) for i, (r, _) in enumerate(RESPONSES)], "i int, raw_response string"
    )
    found = add_prediction(rows).orderBy("i").select("predicted_country").collect()
    assert [r[0] for r in found] == [e for _, e in RESPONSES]


def test_without_aliases(spark):
    assert column(spark, ["COUNTRY: uk"], lambda c: text.parse_country(c, {})) == ["Uk"]


def test_title_case_like_python(spark):
    words = ["guinea-bissau", "u.k", "o'neill's", "3rd world", "日本x y", "ǆabc", "", "ÉCOLE été", "straße", "a1b c_d"]
    assert column(spark, words, text.title_case) == [w.title() for w in words]


def test_strip_like_python(spark):
    pads = [" x　", "\x1c\n x y \t\x1f", "​x", "", "  ", " a\u0085"]
    assert column(spark, pads, text.strip) == [p.strip() for p in pads]


def test_has_digit_like_python(spark):
    lines = ["abc", "a1", "x²", "٣", "", "Ⅷ"]
    assert column(spark, lines, text.has_digit) == [any(c.isdigit() for c in s) for s in lines]


def test_parse_bool(spark):
    words = ["TRUE", "1", "Yes", "t", "y", "0", "False", "", None]
    assert column(spark, words, text.parse_bool) == [True, True, True] + [False] * 6
    assert column(spark, [True, False, None], text.parse_bool, "boolean") == [True, False, False]


def test_matches(spark):
    rows = spark.createDataFrame(
        [
            ("Japan", " japan ", "East Asia", True, True),
            ("South Korea", "Japan", "east asia", False, True),
            ("PARSE_ERROR", "PARSE_ERROR", "East Asia", False, False),
            ("Atlantis", "Japan", "", False, False),
            ("Atlantis", "Japan", "  ", False, False),
            ("Czechia", "Czechia", "Eastern Europe", True, False),
            ("", "Japan", "East Asia", False, False),
            ("Japan", None, None, False, False),
        ],
        "p string, t string, r string, c boolean, rc boolean",
    )
    found = rows.select("c", text.country_match("p", "t"), "rc", text.region_match("p", "r")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in found), found


def test_primary_cue(spark):
    rows = spark.createDataFrame(
        [
            ("Linguistic", "", "linguistic"),
            ("Infrastructural", "L", "infrastructure"),
            ("Multi-Cue", "I/E", "infrastructure"),
            ("Multi-Cue", "E", "environmental"),
            ("Multi-Cue", "L / I", ""),
            ("Multi-Cue", "X/L", ""),
            ("Multi-Cue", "", "multi_cue"),
        ],
        "h string, n string, e string",
    )
    assert all(r[0] == r[1] for r in rows.select("e", text.primary_cue("h", "n")).collect())


def test_percent_like_python(spark):
    rng = random.Random(7)
    shares = [0.0, 1.0, 0.0625, 0.8135, 0.1875, 0.00049999, 0.0005, 0.0015, 0.9995, 0.99949999, -0.0625]
    shares += [k / n for n in (8, 16, 43, 203, 246, 1000, 2000, 4000, 16000) for k in range(0, n + 1, max(1, n // 97))]
    shares += [rng.random() for _ in range(2000)] + [rng.randrange(2001) / 2000 for _ in range(500)]
    assert column(spark, shares, text.percent_text, "double") == [f"{s:.1%}" for s in shares]
    assert column(spark, [None], lambda c: text.percent_text(c, "N/A"), "double") == ["N/A"]


def test_base64_has_no_line_breaks(spark):
    data = [bytes(range(256)) * 3, b""]
    assert column(spark, data, text.base64_text, "binary") == [base64.b64encode(d).decode() for d in data]


@pytest.mark.parametrize("country, path", [("Japan", "data/images/Japan/7.jpg"), (None, "data/images/7.jpg")])
def test_image_path(spark, country, path):
    expression = lambda c: text.image_path(c, F.lit(country) if country else None)
    assert column(spark, ["7"], expression) == [path]
