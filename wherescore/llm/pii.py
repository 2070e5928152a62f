"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their score.

DataFrame operations only. A pattern's matches are found together with the text between them, so that their places
follow by adding up lengths, and the last characters read are carried along as context. Places are counted in code
points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherescore.llm.common import whole_text

#: Characters before a span that are searched for context words, and the score a proposed span needs.
CONTEXT = 40
THRESHOLD = 0.5
_RUN = 128
_SPAN = "array<struct<start:int,end:int,score:double,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _ip(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).try_cast("int") <= 255))


def _card(m: Column) -> Column:
    return F.when(_between(F.length(_digits(m)), 13, 19), F.call_function("luhn_check", _digits(m))).otherwise(False)


def mod_97(account: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 test: country and check digits last, letters as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _iban(m: Column) -> Column:
    account = F.replace(m, F.lit(" "), F.lit(""))
    return F.when(_between(F.length(account), 15, 34), mod_97(account)).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """A pattern, the test of a match, its score, and what context words add to it."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    bonus: float = 0.4


_ANY = lambda m: F.lit(True)
#: A run is tried at its start or after the last match only and not given back: same matches, no repeated or deep search.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _ANY, 0.6, "mail|contact|write|@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.5, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.5, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _between(F.length(_digits(m)), 9, 15), 0.5, "call|phone|tel|fax|mobile"),
)
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _iban, 0.8, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), 0.3, "ssn|social|security|insurance"),
    Kind("tel", r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", _ANY, 0.2, "call|phone|tel|fax|mobile"),
)


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, kind: Kind) -> Column:
    """Valid leftmost matches that do not overlap: array of (start, end, score, value)."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    parts = F.zip_with(F.split(text, kind.pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        read = F.concat(done["tail"], x["gap"])
        before = F.lower(F.right(read, F.lit(CONTEXT)))
        scored = F.lit(kind.score) + F.when(before.rlike(kind.words), kind.bonus).otherwise(0.0)
        span = F.struct(start.alias("start"), end.alias("end"), scored.alias("score"), x["m"].alias("value"))
        valid = F.when(x["m"].isNotNull(), kind.valid(x["m"])).otherwise(False)
        tail = F.right(F.concat(read, F.coalesce(x["m"], F.lit(""))), F.lit(CONTEXT))
        spans = F.when(valid, F.array_append(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.alias("at"), tail.alias("tail"), spans.alias("spans"))

    def run(done: Column, chunk: Column) -> Column:
        begin = F.struct(done["at"], done["tail"], F.array().cast(_SPAN).alias("spans"))
        joined = lambda r: F.struct(r["at"], r["tail"], F.array_append(done["spans"], r["spans"]).alias("spans"))
        return _given(F.aggregate(chunk, begin, step), joined)

    # Arrays are copied to append to them: runs of matches keep that from growing with the square of their number.
    count = F.floor((F.size(found) + _RUN) / _RUN).cast("int")
    runs = _given(parts, lambda all_parts: F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(all_parts, k * _RUN + 1, _RUN)))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    spans = F.aggregate(runs, empty, run, lambda done: F.flatten(done["spans"]))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, and an array of spans (start, end, score, value) for each kind.

    Spans of the base kinds stay whatever their score. Of the others (account numbers that pass mod 97, social security
    and local telephone numbers) those stay whose score with its context words reaches the threshold and that do not
    overlap a span of a base kind. Null and empty texts have none; an empty table gives no rows.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("*", *[matches(F.col("text"), k).alias(k.name) for k in BASE])
    base = F.flatten(F.array(*[F.col(k.name) for k in BASE]))
    rows = rows.withColumn("_base", base)

    def stays(span: Column) -> Column:
        apart = ~F.exists("_base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
        return (span["score"] >= THRESHOLD) & apart

    more = [F.filter(matches(F.col("text"), k), stays).alias(k.name) for k in MORE]
    return rows.select("doc_id", *[k.name for k in BASE], *more)


def places(kinds: tuple[Kind, ...]) -> Column:
    """All spans as kind:start:end, by kind, then start, joined by commas."""

    def named(kind: Kind) -> Column:
        return F.transform(kind.name, lambda s: F.concat_ws(":", F.lit(kind.name), s["start"], s["end"]))

    return F.array_join(F.flatten(F.array(*[named(k) for k in kinds])), ",")
