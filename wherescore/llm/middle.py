"""Fill in the middle: cut texts at token boundaries and put the middle last, without moving texts through Python and back.

Cuts are drawn in tokens, reported in characters and made in bytes. A sparse index of exceptions converts between the last
two: it holds the positions of multibyte characters only, with the bytes they have in excess, so that a text of mostly ASCII
has a small index, and a cut in an ASCII span is a subtraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wherescore.llm.common import whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, so many stay plain and so many of the others have their suffix first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
_STEP = 1 << 16


class Exceptions:
    """Multibyte characters of a UTF-8 text: byte position of each, and excess bytes up to and with it."""

    def __init__(self, text: np.ndarray) -> None:
        self.places = np.flatnonzero(text >= 0xC0)
        lead = text[self.places]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.chars = self.places - self.excess[:-1]

    def to_chars(self, at: int) -> int:
        """Code points before a byte position that starts a character."""
        return int(at - self.excess[np.searchsorted(self.places, at)])

    def to_bytes(self, at: int) -> int:
        """Bytes before a code point."""
        return int(at + self.excess[np.searchsorted(self.chars, at)])


class Tokens:
    """Starts of the tokens ``[A-Za-z]+|[^A-Za-z]`` of a UTF-8 text: a flag per byte, counted by blocks."""

    def __init__(self, text: np.ndarray) -> None:
        letter = ((text | 0x20) >= ord("a")) & ((text | 0x20) <= ord("z"))
        self.first = (text & 0xC0) != 0x80
        self.first[1:] &= ~(letter[1:] & letter[:-1])
        blocks = np.add.reduceat(self.first, np.arange(0, len(text), _STEP), dtype=np.int64) if len(text) else []
        self.before = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.before[-1])

    def start(self, k: int) -> int:
        """Byte position of the k-th token; the end of the text for the number of tokens."""
        if k >= len(self):
            return len(self.first)
        block = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.flatnonzero(self.first[block * _STEP : (block + 1) * _STEP])
        return block * _STEP + int(inside[k - self.before[block]])


def cuts(text: bytes | memoryview, first: int, second: int) -> tuple[int, int, int, int, int]:
    """Number of tokens, and where prefix and middle end, in bytes and in code points.

    The cuts lie after ``first`` and ``second`` modulo the number of tokens plus one, the smaller one first.
    """
    data = np.frombuffer(text, np.uint8)
    tokens, exceptions = Tokens(data), Exceptions(data)
    a, b = sorted((first % (len(tokens) + 1), second % (len(tokens) + 1)))
    a, b = tokens.start(a), tokens.start(b)
    return len(tokens), a, b, exceptions.to_chars(a), exceptions.to_chars(b)


_CUTS = ("n", "prefix_bytes", "middle_end", "prefix_chars", "middle_end_chars")


@F.arrow_udf(StructType([StructField(c, LongType()) for c in _CUTS]))
def _cut(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    drawn = zip(text, first.to_pylist(), second.to_pylist(), strict=True)
    rows = [cuts(t.as_buffer(), a, b) for t, a, b in drawn]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_CUTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_CUTS))


def drawn(part: int) -> Column:
    """The ``part``-th number (from 0) that the row's id draws: 32 bits of a SHA-256. A null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle), or plain, where ``output`` is the text and the
    lengths are null: for empty and null texts, for texts that hold one of the marks, and for the share that is drawn.
    Draws depend on the id alone, so repeated rows give equal rows. An empty table gives no rows; columns other than
    doc_id and text are not looked at. Python sees each text once and returns five numbers; Spark cuts the bytes.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (drawn(2) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(drawn(3) % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), _cut(F.col("text").cast("binary"), drawn(0), drawn(1)).alias("cut"))

    def piece(start: Column, length: Column) -> Column:
        return F.substr(F.col("text").cast("binary"), (start + 1).cast("int"), length.cast("int")).cast("string")

    a, b = F.col("cut.prefix_bytes"), F.col("cut.middle_end")
    prefix = F.concat(F.lit(PREFIX), piece(F.lit(0), a))
    suffix = F.concat(F.lit(SUFFIX), piece(b, F.octet_length("text") - b))
    middle = F.concat(F.lit(MIDDLE), piece(a, b - a))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
        .otherwise(F.concat(prefix, suffix, middle))
    )
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(cut, F.col("cut.prefix_chars")).alias("prefix_chars"),
        F.when(cut, F.col("cut.middle_end_chars") - F.col("cut.prefix_chars")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text that an output was made of. Marks cannot arise at the seams, as no part of one ends another."""
    text = F.col(output)
    body = F.substr(text, F.lit(4))
    second = F.when(F.col(form) == "spm", PREFIX).otherwise(SUFFIX)
    first_part = F.split_part(body, second, F.lit(1))
    rest = F.split_part(body, second, F.lit(2))
    second_part, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    spm = F.concat(second_part, middle, first_part)
    psm = F.concat(first_part, middle, second_part)
    return F.when(F.col(form) == "plain", text).when(F.col(form) == "spm", spm).otherwise(psm)
