"""Text functions as column expressions: no Python runs per row."""

from __future__ import annotations

import sys
from collections.abc import Mapping
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from wherescore.functions.lookups import (
    COUNTRY_ALIASES,
    COUNTRY_REGIONS,
    CUE_HEADERS,
    CUE_LETTERS,
    MULTI_CUE_HEADER,
    PARSE_ERROR,
)

# All characters that Python strips; `\s` of a Java pattern covers fewer.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_ANSWER = rf"(?id)COUNTRY:[{WHITESPACE}]*(.+)"
_TAIL = r"[.\-,;]+$"
_CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
_WORD_START = f"(?<!{_CASED})(?={_CASED})"
# A noncharacter, then the blank after which initcap starts a new word.
_MARK = "\ufdd0 "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_literal(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])


def strip(c) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def title_case(c) -> Column:
    """Upper-case every cased letter that follows an uncased character, lower-case the others."""
    marked = F.regexp_replace(_col(c), _WORD_START, _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def extract_answer(raw) -> Column:
    """Text after the first ``COUNTRY:`` up to the end of its line; NULL if there is none."""
    answer = strip(F.regexp_extract(_col(raw), _ANSWER, 1))
    return F.nullif(answer, F.lit(""))


def clean_answer(c) -> Column:
    """Strip whitespace and one trailing run of ``. - , ;``."""
    return strip(F.regexp_replace(strip(c), _TAIL, ""))


def alias_key(clean) -> Column:
    return F.lower(_col(clean))


def normalize_country(c, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Column:
    """Canonical country name: alias by lower case, else title case."""
    clean = clean_answer(c)
    if not aliases:
        return title_case(clean)
    return F.coalesce(F.try_element_at(map_literal(aliases), alias_key(clean)), title_case(clean))


def parse_country(raw, aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Column:
    """Normalised country named in a response, or ``PARSE_ERROR``."""
    return F.coalesce(normalize_country(extract_answer(raw), aliases), F.lit(PARSE_ERROR))


def get_region(country, regions: Mapping[str, str] = COUNTRY_REGIONS) -> Column:
    """Region of a country, '' if unknown."""
    if not regions:
        return F.lit("")
    return F.coalesce(F.try_element_at(map_literal(regions), _col(country)), F.lit(""))


def country_match(predicted, truth) -> Column:
    """Case-insensitive equality; a parse error or a missing side never matches."""
    p, t = _col(predicted), _col(truth)
    same = F.lower(strip(p)) == F.lower(strip(t))
    return F.coalesce((p != PARSE_ERROR) & same, F.lit(False))


def regions_equal(predicted, predicted_region, true_region) -> Column:
    """Region equality once the region of the prediction is known."""
    truth = strip(true_region)
    same = F.lower(_col(predicted_region)) == F.lower(truth)
    return F.coalesce((_col(predicted) != PARSE_ERROR) & (truth != "") & same, F.lit(False))


def region_match(predicted, true_region, regions: Mapping[str, str] = COUNTRY_REGIONS) -> Column:
    """Is the predicted country in the true region? A blank true region never matches."""
    return regions_equal(predicted, get_region(predicted, regions), true_region)


def parse_bool(c) -> Column:
    """True for the spellings true / 1 / yes in any case, false for all else and NULL."""
    return F.coalesce(F.lower(_col(c).cast("string")).isin("true", "1", "yes"), F.lit(False))


@lru_cache(maxsize=1)
def _digit_pattern() -> str:
    others = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal())
    return rf"[\p{{Nd}}{others}]"


def has_digit(c) -> Column:
    """Does the text hold a digit of any script?"""
    return _col(c).rlike(_digit_pattern())


def split_words(c) -> Column:
    """Words between runs of whitespace, of a stripped text."""
    return F.split(_col(c), f"[{WHITESPACE}]+")


def primary_cue(header, notes) -> Column:
    """Cue of a list line: by header, or by the first note letter of a multi-cue line with notes."""
    letter = F.split(strip(notes), "/")[0]
    by_letter = F.coalesce(F.try_element_at(map_literal(CUE_LETTERS), letter), F.lit(""))
    by_header = F.coalesce(F.try_element_at(map_literal(CUE_HEADERS), _col(header)), F.lit(""))
    return F.when((_col(header) == MULTI_CUE_HEADER) & (_col(notes) != ""), by_letter).otherwise(by_header)


def rename(c, renames: Mapping[str, str]) -> Column:
    """Mapped value, or the value itself."""
    if not renames:
        return _col(c)
    return F.coalesce(F.try_element_at(map_literal(renames), _col(c)), _col(c))


def image_path(image_id, country=None, root: str = "data/images") -> Column:
    """Relative path of an image file, with or without its country folder."""
    if country is None:
        return F.concat(F.lit(f"{root}/"), _col(image_id), F.lit(".jpg"))
    return F.concat(F.lit(f"{root}/"), _col(country), F.lit("/"), _col(image_id), F.lit(".jpg"))


def base64_text(content) -> Column:
    """Base64 without the line breaks that Spark inserts."""
    return F.translate(F.base64(_col(content)), "\r\n", "")


def data_url(b64, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), _col(b64))


def percent_text(c, missing: str | None = None) -> Column:
    """Share as a percentage with one decimal, rounded on the exact binary value, ties to even.

    ``round`` and ``format_string`` work on the shortest decimal form, which moves a value such as
    81.35 (stored below the tie) upwards. The fraction is scaled by 2**59, where it is a whole
    number, and rounded with integer arithmetic.
    """
    value = _col(c) * F.lit(100.0)
    size = F.abs(value)
    whole = F.floor(size)
    scaled = ((size - whole) * F.lit(float(1 << 59))).cast("bigint") * F.lit(10)
    digit = F.shiftright(scaled, 59)
    rest = scaled.bitwiseAND(F.lit((1 << 59) - 1))
    half = F.lit(1 << 58)
    up = (rest > half) | ((rest == half) & (digit % 2 == 1))
    tenths = whole * 10 + digit + up.cast("bigint")
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(tenths / 10).cast("string"),
        F.lit("."),
        (tenths % 10).cast("string"),
        F.lit("%"),
    )
    return text if missing is None else F.coalesce(text, F.lit(missing))
