"""Repeated passages removed byte by byte, by bucket-pointer refinement of the positions of all texts.

The order of all suffixes is needed only to 50 bytes, and only where two documents agree. Positions start in the bucket of
a q-gram; buckets that hold one context are finished; the others are refined by identifiers of the text around them, until
positions share a bucket exactly if their 50 bytes are the same. The identifiers are hashes of whole stretches, so there is
one step of refinement for stretches and one for strings, where the textbook method numbers buckets and goes on recursively.

1. Each 50-byte string is represented by its least q-gram (an anchor). The strings of one anchor are neighbours, so
   one record with the anchor's bucket and the identifier of the whole stretch of text stands for all of them.
2. Records of one stretch that several documents have are decided at once: all but the smallest document's are covered.
3. Where a bucket holds several stretches (ends of a repeated passage), the 50-byte strings of its first records are
   refined one by one to buckets of their own.

Identifiers are 64-bit hashes. Spark deals the buckets out; numpy sorts within them. Records of a stretch are combined
before they are sent, so a passage that every document has is a few records for each task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherescore.llm.common import ROW_KEY, row_key, whole_text
from wherescore.llm.exact import marked
from wherescore.operators.joins import spread_join
from wherescore.sources.scratch import settle

LENGTH = 50
#: Bytes of the q-grams of the first buckets.
GRAM = 20
#: Bytes of text that a task holds at a time; about 100 bytes of memory for each.
CHUNK = 1 << 21
#: Bytes of text for each bucket of the exchanges, and the least number of buckets.
BUCKET_BYTES = 1 << 23
LEAST_BUCKETS = 1 << 10
_NULL_ID = np.iinfo(np.int64).max  # of rows without an id: larger than all others
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
_OUT = "bucket int, payload binary, _row_id long, _row_hash long, kind int, first int, last int"
_BLOB, _COVERED, _OPEN = 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bytes, and powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return (
        mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)),
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _BASE)])),
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, inverse)])),
    )


class Chunk:
    """Pieces of texts one after the other, with running sums from which any stretch's hash follows."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.row = np.array([r for r, _, _ in pieces], np.int64)
        self.offset = np.array([o for _, o, _ in pieces], np.int64)
        sizes = np.array([len(b) for _, _, b in pieces], np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        data = np.frombuffer(b"".join(b for _, _, b in pieces), np.uint8)
        self.size = len(data)
        codes, power, self.inverse = _powers(CHUNK + LENGTH)
        self.sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(codes[data] * power[: self.size], out=self.sums[1:])

    def hashes(self, at: np.ndarray | slice, to: np.ndarray | slice) -> np.ndarray:
        """Hashes of the stretches from ``at`` to ``to``."""
        return mixed((self.sums[to] - self.sums[at]) * self.inverse[: self.size + 1][at])

    def stretches(self) -> tuple[np.ndarray, ...]:
        """Of each anchor: its hash, its stretch's hash, and the first and last of its 50-byte strings (places in here)."""
        n = self.size - LENGTH + 1
        if n <= 0:
            return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        grams = self.hashes(slice(0, self.size - GRAM + 1), slice(GRAM, None))
        least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)  # the first of equal ones
        width, full = 1, LENGTH - GRAM + 1
        while width < full:
            step = min(width, full - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        own = np.flatnonzero(np.arange(LENGTH, n + LENGTH) <= np.repeat(self.end, self.end - self.begin)[:n])
        anchor = (least[own] & _LOW).astype(np.int64)
        new = np.ones(len(own), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1] + 1)
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(own))[: len(firsts)] - 1
        first, last, anchor = own[firsts], own[lasts], anchor[firsts]
        shape = ((last - first) * 64 + anchor - first).astype(np.uint64)
        return grams[anchor], mixed(self.hashes(first, last + LENGTH) + shape * _BASE), first, last

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place within its text of places in here."""
        piece = np.searchsorted(self.end, at, "right")
        return self.row[piece], at - self.begin[piece] + self.offset[piece]


def pieces(row: int, text: bytes, size: int = CHUNK) -> Iterator[tuple[int, int, bytes]]:
    """A text in pieces that overlap so that each 50-byte string is in one of them, once."""
    for k in range(0, max(1, len(text) - LENGTH + 1), size):
        yield row, k, text[k : k + size + LENGTH - 1]


def _chunks(texts: Iterator[tuple[int, bytes]]) -> Iterator[Chunk]:
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for row, text in texts:
        for piece in pieces(row, text):
            if held and total + len(piece[2]) > CHUNK + LENGTH:
                yield Chunk(held)
                held, total = [], 0
            held.append(piece)
            total += len(piece[2])
    if held:
        yield Chunk(held)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return struct.pack(f"<{len(arrays)}I", *map(len, arrays)) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    head = 4 * len(kinds)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[head:]), np.uint8)
    out, at = [], 0
    for kind, n in zip(kinds, struct.unpack(f"<{len(kinds)}I", payload[:head]), strict=True):
        size = np.dtype(kind).itemsize * n
        out.append(np.ascontiguousarray(planes[at : at + size].reshape(-1, n).T).view(kind).ravel())
        at += size
    return out


def _joined(first: np.ndarray, last: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered byte ranges (exclusive ends) of strings that start from ``first`` to ``last``; neighbours become one."""
    order = np.lexsort((first, row))
    first, end, row = first[order], last[order] + LENGTH, row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] > end[:-1])
    at = np.flatnonzero(new)
    return first[at], np.maximum.reduceat(end, at) if len(at) else end, row[at]


def _smaller(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and for each record in that order whether a smaller owner has its key."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return order, np.empty(0, bool)
    least = np.minimum.reduceat(owner, at)
    return order, owner > np.repeat(least, np.diff(np.append(at, len(keys))))


class _Rows:
    """Output of a task, as record batches."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, buckets: int):
        self.ids, self.row_hash, self.buckets = ids, hashes, buckets

    def ranges(self, kind: int, first: np.ndarray, last: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        n = len(row)
        ids = np.where(self.ids[row] == _NULL_ID, 0, self.ids[row])
        bucket = (mixed(self.ids[row].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int32)
        columns = [bucket, pa.nulls(n, pa.binary()), ids, self.row_hash[row], np.full(n, kind, np.int32), first.astype(np.int32), last.astype(np.int32)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in _OUT.split(", ")])

    def blobs(self, key: np.ndarray, row: np.ndarray, *fields: np.ndarray) -> pa.RecordBatch:
        """Records by bucket of ``key``: the rows' ids and hashes, the record's row, and the other fields."""
        bucket = (key % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, row, fields = bucket[order], row[order], [f[order] for f in fields]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
        payloads = []
        for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True):
            known, index = np.unique(row[a:b], return_inverse=True)
            payloads.append(_pack(self.ids[known], self.row_hash[known], index.astype(np.uint32), *[f[a:b] for f in fields]))
        n = len(at)
        empty, zero = pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[at]), pa.array(payloads, pa.binary()), empty, empty, zero, zero, zero],
            [c.split()[0] for c in _OUT.split(", ")],
        )


def _identified(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    return ids, batch.column("_row_hash").to_numpy(zero_copy_only=False)


def _first_buckets(buckets: int):
    """Step 1: records of anchors, combined within the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(*_identified(batch), buckets)
            texts = batch.column("text").cast(pa.large_binary())
            for chunk in _chunks((k, t.as_py()) for k, t in enumerate(texts)):
                anchor, stretch, first, last = chunk.stretches()
                row, place = chunk.places(first)
                span = last - first
                order, covered = _smaller(stretch, out.ids[row])
                gone, kept = order[covered], np.sort(order[~covered])
                yield out.ranges(_COVERED, *_joined(place[gone], place[gone] + span[gone], row[gone]))
                low = np.uint64(0xFFFFFFFF)
                yield out.blobs(
                    anchor[kept],
                    row[kept],
                    (anchor[kept] >> np.uint64(32)).astype(np.uint32),
                    (stretch[kept] & low).astype(np.uint32),
                    place[kept].astype(np.uint32),
                    span[kept].astype(np.uint8),
                )

    return run


def _gathered(table: pa.Table, *kinds: str) -> tuple[_Rows | None, np.ndarray, list[np.ndarray]]:
    """All records of a bucket: their rows, row of each record, other fields."""
    found, base = [], 0
    for payload in table.column("payload").to_pylist():
        if payload is not None:
            parts = _unpack(payload, "i8", "i8", "u4", *kinds)
            parts[2] = parts[2].astype(np.int64) + base
            base += len(parts[0])
            found.append(parts)
    if not found:
        return None, np.empty(0, np.int64), []
    ids, hashes, row, *fields = (np.concatenate(x) for x in zip(*found, strict=True))
    return _Rows(ids, hashes, 1), row, fields


def _passed(table: pa.Table) -> pa.Table:
    return table.filter(pc.is_null(table.column("payload")))


def _refine_stretches(table: pa.Table) -> pa.Table:
    """Step 2: covered ranges of one bucket of anchors, and the string ranges that stay open."""
    out, row, fields = _gathered(table, "u4", "u4", "u4", "u1")
    parts = [_passed(table)]
    if out:
        anchor, stretch, first, span = (f.astype(np.int64) for f in fields)
        key = (anchor.astype(np.uint64) << np.uint64(32)) | stretch.astype(np.uint64)
        order, covered = _smaller(key, out.ids[row])
        gone, left = order[covered], order[~covered]
        parts.append(pa.Table.from_batches([out.ranges(_COVERED, *_joined(first[gone], first[gone] + span[gone], row[gone]))]))
        # An anchor is open if different stretches of different documents have it.
        anchors, ids = anchor[left], out.ids[row[left]]
        new = np.append(True, anchors[1:] != anchors[:-1])[: len(left)]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        still = (np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at))[group]
        some = left[still]
        parts.append(pa.Table.from_batches([out.ranges(_OPEN, first[some], first[some] + span[some], row[some])]))
    return pa.concat_tables(parts)


def _strings(buckets: int):
    """Step 3: a record for each 50-byte string of the open ranges, combined within the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Rows(*_identified(batch), buckets)
            texts = batch.column("text").cast(pa.large_binary())
            bounds = [(np.array(o.as_py()["first"]), np.array(o.as_py()["last"])) for o in batch.column("open")]
            for chunk in _chunks((k, t.as_py()) for k, t in enumerate(texts)):
                places = []
                for row, offset, begin, end in zip(chunk.row, chunk.offset, chunk.begin, chunk.end, strict=True):
                    first, last = bounds[row]
                    first, last = np.maximum(first, offset), np.minimum(last, offset + end - begin - LENGTH)
                    first, count = first[last >= first], (last - first + 1)[last >= first]
                    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    places.append(np.repeat(first, count) + within - offset + begin)
                at = np.concatenate(places)
                key = chunk.hashes(at, at + LENGTH)
                row, place = chunk.places(at)
                order, covered = _smaller(key, out.ids[row])
                gone, kept = order[covered], np.sort(order[~covered])
                yield out.ranges(_COVERED, *_joined(place[gone], place[gone], row[gone]))
                yield out.blobs(key[kept], row[kept], key[kept], place[kept].astype(np.uint32))

    return run


def _refine_strings(table: pa.Table) -> pa.Table:
    """Strings of one bucket that a smaller document has too."""
    out, row, fields = _gathered(table, "u8", "u4")
    parts = [_passed(table)]
    if out:
        order, covered = _smaller(fields[0], out.ids[row])
        gone = order[covered]
        first = fields[1].astype(np.int64)[gone]
        parts.append(pa.Table.from_batches([out.ranges(_COVERED, *_joined(first, first, row[gone]))]))
    return pa.concat_tables(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept, sizes, gone = [], [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.large_binary()), batch.column("ranges"), strict=True):
            text, own = text.as_py(), ranges.as_py()
            merged: list[list[int]] = []
            for first, last in sorted((x["first"], x["last"]) for x in own) if own else ():
                if merged and first <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            bounds = [0, *(x for pair in merged for x in pair), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            spans.append([{"start": a, "end": b} for a, b in merged])
            sizes.append(len(text))
            gone.append(len(text) - len(kept[-1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (start, end in bytes), kept (the bytes that stay).

    Each byte goes that a 50-byte string covers which also starts in a row with a smaller doc_id. A null id is larger
    than all others; rows of equal ids do not cover each other. Null texts are empty, texts under 50 bytes stay whole.
    An empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    # Only rows of repeated or missing ids need more than their id to be told apart; zeros take no room in the records.
    repeated = given.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    row_id, row_hash = row_key()
    alone = ~F.col("_maybe") & F.col("doc_id").isNotNull()
    own_hash = F.when(alone, F.lit(0)).otherwise(row_hash).alias("_row_hash")
    rows = marked(given, settle(repeated)).select(row_id, own_hash, "doc_id", "text")
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    anchors = rows.select("_row_hash", "doc_id", "text").mapInArrow(_first_buckets(buckets), _OUT)
    decided = settle(anchors.groupBy("bucket").applyInArrow(_refine_stretches, _OUT).select(*ROW_KEY, "kind", "first", "last"))
    ranges = F.collect_list(F.struct("first", "last"))  # of one text: as many as it has bytes at most
    firsts, lasts = F.collect_list("first").alias("first"), F.collect_list("last").alias("last")
    still = decided.where(F.col("kind") == _OPEN).groupBy(*ROW_KEY).agg(F.struct(firsts, lasts).alias("open"))
    strings = spread_join(rows, still, ROW_KEY, "inner").select("_row_hash", "doc_id", "text", "open")
    refined = strings.mapInArrow(_strings(buckets), _OUT).groupBy("bucket").applyInArrow(_refine_strings, _OUT)
    covered = decided.where(F.col("kind") == _COVERED).unionByName(refined.select(*ROW_KEY, "kind", "first", "last"))
    of_row = covered.groupBy(*ROW_KEY).agg(ranges.alias("ranges"))
    joined = spread_join(rows, of_row, ROW_KEY, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")
