"""Near-equal lines by MinHash: character shingles, banding, exact Jaccard similarity, components, one line of each.

One permutation is cut into bins; the least shingle hash of each bin is the signature, and empty bins borrow from the
next one. Bands of bins propose pairs. A 64-bit sketch of the signature and the number of shingles turn down pairs that
are far apart before any text is fetched. Lines are tried with the middle of each group first; parities of the shingles, an
exact bound, turn down most other pairs. The exact similarity of the rest decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherescore.llm.common import ROW_KEY, packed, row_key, whole_text
from wherescore.llm.components import components
from wherescore.llm.exact import surviving
from wherescore.llm.ngrams import pack, unpack
from wherescore.llm.suffix import mixed
from wherescore.llm.trie import starts_of
from wherescore.operators.joins import spread_join
from wherescore.sources.scratch import settle

SHINGLE = 5
SIMILARITY = 0.8
#: 14 bands of 5 bins find a pair of similarity 0.8 with a chance of 0.996, one of 0.9 with 0.99999.
BANDS, ROWS = 14, 5
#: Of 64 sketch bits, a pair of similarity 0.8 differs in 6.4 on average, with a deviation of 2.4 (more for short lines);
#: unrelated lines that share a band differ in 29, with a deviation of 4.
SKETCH_BITS = 19
#: Bits of the parities of a line's shingles; lines of 500 shingles that are not similar are told apart down from 0.785.
PARITY_BITS = 2048
#: Bands in a shard, as expected of balanced hashing, and lines of a task whose bands are sent together.
SHARD_BANDS = 1 << 20
_MESSAGE_LINES = 1 << 16
_VALUE_BITS = 43
#: Characters that are worked on at a time, so that the arrays stay in the processor's cache.
_SLICE = 1 << 17
_SLICE_LINES = 1 << 10
_NONE = np.uint64((1 << 64) - 1)


def _shingles(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle of some lines, repeats included, and the line it is in. Shorter lines are one shingle."""
    sizes = np.array([len(x) for x in lines], np.int64)
    padded = np.maximum(sizes, shingle)
    codes = np.zeros(int(padded.sum()), np.uint64)
    begin = np.cumsum(padded) - padded
    inside = np.arange(len(codes)) - np.repeat(begin, padded) < np.repeat(sizes, padded)
    codes[inside] = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint64(1)
    count = len(codes) - shingle + 1
    values = np.zeros(max(0, count), np.uint64)
    for k in range(shingle):
        values = values * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + count]
    line = np.repeat(np.arange(len(lines), dtype=np.uint64), padded)[: len(values)]
    whole = np.arange(len(values)) + shingle <= np.repeat(begin + padded, padded)[: len(values)]
    return mixed(values[whole]), line[whole]


def _different(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def signatures(lines: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each line (lines x bins) and its number of different shingles. Shorter lines are one shingle."""
    bins, n = BANDS * ROWS, len(lines)
    values, line = _shingles(lines, shingle)
    keys = (line << np.uint64(50)) | ((values >> np.uint64(48)) % np.uint64(bins) << np.uint64(_VALUE_BITS))
    keys = _different(keys | (values & np.uint64((1 << _VALUE_BITS) - 1)))
    cell = (keys >> np.uint64(_VALUE_BITS)).astype(np.int64)
    different = np.bincount(cell >> 7, minlength=n)
    first = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
    out = np.full((n, bins), _NONE)
    out[cell[first] >> 7, cell[first] & 127] = keys[first] & np.uint64((1 << _VALUE_BITS) - 1)
    while (empty := out == _NONE).any():
        out = np.where(empty, np.roll(out, -1, axis=1), out)
        borrowed = empty & (out != _NONE)
        out[borrowed] += np.uint64(1 << _VALUE_BITS)  # a borrowed value tells how far it comes from
    return out, different


def parities(lines: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """For each of PARITY_BITS slots whether an odd number of a line's different shingles fall in it (lines x words of 64 bits).

    Two lines differ in at most as many bits as there are shingles that only one of them has.
    """
    values, line = _shingles(lines, shingle)
    keys = _different((line << np.uint64(50)) | (values >> np.uint64(14)))
    slot = (keys >> np.uint64(50)) * np.uint64(PARITY_BITS) + keys % np.uint64(PARITY_BITS)
    odd = np.bincount(slot.astype(np.int64), minlength=PARITY_BITS * len(lines)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(lines), PARITY_BITS // 64)


def _slices(lines: list[str], size: int = _SLICE) -> Iterator[list[str]]:
    begin = total = 0
    for k, line in enumerate(lines):
        if total and (total + len(line) > size or k - begin >= _SLICE_LINES):
            yield lines[begin:k]
            begin, total = k, 0
        total += len(line) + 1
    if begin < len(lines):
        yield lines[begin:]


def _folded(values: np.ndarray) -> np.ndarray:
    """Hash of each band of some signatures (lines x bands)."""
    out = np.zeros((len(values), BANDS), np.uint64)
    for k in range(ROWS):
        out = mixed(out + values[:, k::ROWS])
    return (out >> np.uint64(32)).astype(np.uint32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch, number of shingles and hashes of the bands of each line; a line that is null has none."""
    for batch in batches:
        full = batch.column("line").is_valid().to_numpy(zero_copy_only=False)
        found = [signatures(part) for part in _slices(batch.column("line").drop_null().to_pylist())]
        values = np.concatenate([np.empty((0, BANDS * ROWS), np.uint64), *(f[0] for f in found)])
        mixed_values = mixed(values + np.uint64(1))
        sketch, different = np.zeros(len(full), np.int64), np.zeros(len(full), np.int32)
        bits = (mixed_values[:, :64] & np.uint64(1)).astype(np.uint8)
        sketch[full] = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
        different[full] = np.concatenate([np.empty(0, np.int64), *(f[1] for f in found)])
        ends = np.append(0, np.cumsum(full) * (4 * BANDS)).astype(np.int32)
        bands = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(_folded(mixed_values).tobytes())])
        columns = [batch.column(c) for c in ("_id", "_row_hash", "at", "hash")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sketch, mask=~full), pa.array(different, mask=~full), bands],
            ["_id", "_row_hash", "at", "hash", "sketch", "n", "bands"],
        )


def split_lines(docs: DataFrame) -> DataFrame:
    """Lines of all rows: _id, _row_hash, at (from 0), line, hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), row_key()[1], whole_text().alias("_text"))
    found = rows.select("_id", "_row_hash", F.posexplode_outer(F.split("_text", "\n")).alias("at", "line"))
    return found.withColumn("hash", F.xxhash64("line"))


def _dealt(shards: int):
    """Bands of the lines of some batches by shard, each a message of sorted bands and the hashes of their lines.

    A band is its hash and its number; shards are ranges of the hashes.
    """

    def message(hashes: list[np.ndarray], folded: list[np.ndarray]) -> pa.RecordBatch:
        line, first = np.unique(np.concatenate(hashes), return_index=True)
        bands = (np.concatenate(folded)[first].astype(np.int64) << 4) | np.arange(BANDS)
        order = np.argsort(bands, axis=None, kind="stable")
        bands, line = bands.ravel()[order], line[order // BANDS]
        cuts = np.searchsorted(bands, [-(-(k << 36) // shards) for k in range(shards + 1)])
        some = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
        payloads = [pack(bands[cuts[k] : cuts[k + 1]], line[cuts[k] : cuts[k + 1]]) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(payloads, pa.binary())], ["shard", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, folded, held = [], [], 0
        for batch in batches:
            hashes.append(batch.column("hash").to_numpy(zero_copy_only=False))
            joined = b"".join(batch.column("bands").to_pylist())
            folded.append(np.frombuffer(joined, "<u4").reshape(-1, BANDS))
            held += len(batch)
            if held >= _MESSAGE_LINES:
                yield message(hashes, folded)
                hashes, folded, held = [], [], 0
        if held:
            yield message(hashes, folded)

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Bands of a shard that several different lines have, and these lines."""
    sent = [unpack(p) for p in table.column("payload").to_pylist()]
    band, line = (np.concatenate([x[k] for x in sent]) for k in (0, 1))
    order = np.lexsort((line, band))
    band, line = band[order], line[order]
    new = np.append(True, (band[1:] != band[:-1]) | (line[1:] != line[:-1]))
    band, line = band[new], line[new]
    first = starts_of(band)
    several = np.repeat(sizes := np.diff(np.append(first, len(band))), sizes) > 1
    return pa.table({"band": band[several], "hash": line[several]})


def _starred(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of each line of a band and the band's middle: the line whose sketch is nearest to what most sketches have."""
    band, line, sketch, n = (table.column(c).to_numpy() for c in ("band", "hash", "sketch", "n"))
    order = np.lexsort((line, band))
    band, line, sketch, n = band[order], line[order], sketch[order].view(np.uint64), n[order]
    first = starts_of(band)
    sizes = np.diff(np.append(first, len(band)))
    middle = np.zeros(len(first), np.uint64)
    for k in range(64):
        ones = np.add.reduceat(((sketch >> np.uint64(k)) & np.uint64(1)).astype(np.int64), first)
        middle |= (2 * ones > sizes).astype(np.uint64) << np.uint64(k)
    group = np.repeat(np.arange(len(first)), sizes)
    away = np.bitwise_count(sketch ^ middle[group])
    star = np.lexsort((line, away, group))[first][group]
    near = np.bitwise_count(sketch ^ sketch[star]) <= SKETCH_BITS
    near &= np.minimum(n, n[star]) >= SIMILARITY * np.maximum(n, n[star])
    some = (line != line[star]) & near
    return pa.table({"a": np.minimum(line, line[star])[some], "b": np.maximum(line, line[star])[some]})


def _close(a: str, b: str) -> str:
    """Condition on two rows: sketches and sizes allow the similarity."""
    sizes = f"least({a}.n, {b}.n) >= {SIMILARITY} * greatest({a}.n, {b}.n)"
    return f"bit_count({a}.sketch ^ {b}.sketch) <= {SKETCH_BITS} and {sizes}"


def jaccard(a: str, b: str, shingle: int = SHINGLE) -> float:
    first, second = ({x[i : i + shingle] for i in range(max(1, len(x) - shingle + 1))} for x in (a, b))
    both = len(first & second)
    return both / (len(first) + len(second) - both)


def similar(xs: list[str], ys: list[str]) -> np.ndarray:
    """Whether the lines of each pair have the similarity. Shingles are counted by hashes; where a few decide, they are compared."""
    lines = [x for pair in zip(xs, ys, strict=True) for x in pair]
    values, line = _shingles(lines, SHINGLE)
    keys = _different((line << np.uint64(50)) | (values >> np.uint64(14)))
    line = keys >> np.uint64(50)
    n = np.bincount(line.astype(np.int64), minlength=len(lines))
    keys = np.sort((line >> np.uint64(1) << np.uint64(50)) | (keys & np.uint64((1 << 50) - 1)))
    twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(50)
    both = np.bincount(twice.astype(np.int64), minlength=len(xs))
    either = n[::2] + n[1::2] - both
    found = both >= SIMILARITY * either
    for k in np.flatnonzero(np.abs(both - SIMILARITY * either) <= 3):
        found[k] = jaccard(xs[k], ys[k]) >= SIMILARITY
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        found, begin, total = [], 0, 0
        for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
            if total and total + len(x) + len(y) > _SLICE:
                found.append(similar(xs[begin:k], ys[begin:k]))
                begin, total = k, 0
            total += len(x) + len(y) + 32
        found.append(similar(xs[begin:], ys[begin:]))
        yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(found), pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of line hashes whose lines are similar; ``texts`` (hash, line) has these lines."""
    named = lambda h, t: texts.select(F.col("hash").alias(h), F.col("line").alias(t))
    both = spread_join(spread_join(pairs, named("a", "x"), ["a"], "inner"), named("b", "y"), ["b"], "inner")
    return both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


_PARITIES = [f"p{k}" for k in range(PARITY_BITS // 64)]
_FOLDS = [f"c{k}" for k in range(BANDS)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parities and hashes of the bands of each line."""
    for batch in batches:
        parts = list(_slices(batch.column("line").to_pylist()))
        odd = np.concatenate([np.empty((0, len(_PARITIES)), np.int64), *map(parities, parts)])
        values = np.concatenate([np.empty((0, BANDS * ROWS), np.uint64), *(signatures(x)[0] for x in parts)])
        folded = _folded(mixed(values + np.uint64(1))).view(np.int32)
        columns = [*(pa.array(c) for c in odd.T), *(pa.array(c) for c in folded.T)]
        yield pa.RecordBatch.from_arrays([batch.column("hash"), *columns], ["hash", *_PARITIES, *_FOLDS])


def _with_partner(rows: DataFrame, more: str) -> DataFrame:
    """Lines of bands for which some other line of the band may be similar and meets the condition ``more``."""
    apart = F.expr(f"a.band = b.band and a.hash <> b.hash and {_close('a', 'b')} and {more}")
    return rows.alias("a").join(rows.alias("b"), apart, "left_semi")


def _united(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (hash, component) after further links (a, b) between components; only components are linked anew."""
    for end in more.columns:
        own = labels.select(F.col("hash").alias(end), F.col("component").alias("_of"))
        more = spread_join(more, own, [end], "left").withColumn(end, F.coalesce("_of", end)).drop("_of")
    roots = settle(components(more))
    every = labels.unionByName(roots.select(F.col("node").alias("hash"), F.col("node").alias("component"))).distinct()
    named = roots.select(F.col("node").alias("component"), F.col("component").alias("_root"))
    return spread_join(every, named, ["component"], "left").select("hash", F.coalesce("_root", "component").alias("component"))


def _untried(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines that share a band but no component and may be similar, each pair once.

    Parities are an exact bound: pairs that differ in more bits than their sizes allow are not similar. So lines that are
    near the others of a large group, but not near enough, give few pairs. A pair comes from the first band that it shares.
    """
    labelled = spread_join(members, labels, ["hash"], "left").withColumn("component", F.coalesce("component", "hash"))
    left = settle(_with_partner(settle(labelled), "a.component <> b.component"))
    wanted = spread_join(texts, left.select("hash").distinct(), ["hash"], "left_semi").select("hash", "line")
    schema = ", ".join(["hash long", *(f"{c} long" for c in _PARITIES), *(f"{c} int" for c in _FOLDS)])
    rows = settle(spread_join(left, wanted.mapInArrow(_features, schema), ["hash"], "inner"))
    bits = " + ".join(f"bit_count(a.{c} ^ b.{c})" for c in _PARITIES)
    # 0.8 of all shingles in both leave at most a ninth of the sum of sizes in one only
    alike = f"9 * ({bits}) <= a.n + b.n"
    earlier = " and ".join(f"((a.band & 15) <= {k} or a.{c} <> b.{c})" for k, c in enumerate(_FOLDS))
    found = rows.alias("a").join(
        rows.alias("b"), F.expr(f"a.band = b.band and a.hash < b.hash and a.component <> b.component and {_close('a', 'b')} and {alike} and {earlier}")
    )
    return found.select(F.col("a.hash").alias("a"), F.col("b.hash").alias("b"))


def line_components(docs: DataFrame) -> DataFrame:
    """One row per line of ``docs``: doc_id, line (from 0), keep_doc_id, keep_line, kept, and the row's hash.

    Lines are alike if the sets of their five-character shingles have a Jaccard similarity of 0.8; a line stays if no line
    of its component comes before it by doc_id (null last), hash of the text and place. Equal lines are alike. Rows with
    equal id and text count as one. Blank lines are no one's copies and stay; a null or empty text is one blank line.

    Links within a group of a band are tried to its middle; all other pairs of the group are tried only if these have not
    joined them yet and an exact bound does not rule them out, so a large group of copies does not give all its pairs.
    """
    lines = split_lines(docs)
    blank = F.trim(F.translate("line", "\t\r\u000b\u000c", "    ")) == ""
    every = settle(
        lines.withColumn("line", F.when(~blank, F.col("line"))).mapInArrow(
            _signed, "_id long, _row_hash long, at int, hash long, sketch long, n int, bands binary"
        )
    )
    signed = every.where("n is not null")
    shards = max(1, -(-signed.count() * BANDS // SHARD_BANDS))
    sent = signed.select("hash", "bands").mapInArrow(_dealt(shards), "shard long, payload binary")
    shared = settle(sent.groupBy("shard").applyInArrow(_shared, "band long, hash long"))
    distinct = signed.groupBy("hash").agg(F.min("sketch").alias("sketch"), F.min("n").alias("n"))
    members = settle(_with_partner(settle(spread_join(shared, distinct, ["hash"], "inner")), "true"))
    by_band = members.groupBy(F.pmod(F.xxhash64("band"), F.lit(shards)))
    pairs = by_band.applyInArrow(_starred, "a long, b long").distinct()
    texts = settle(surviving(lines.select("hash", "line"), members.select("hash").distinct()).dropDuplicates(["hash"]))
    links = settle(_verified(pairs, texts))
    labels = settle(components(links).select(F.col("node").alias("hash"), "component"))
    more = settle(_verified(settle(_untried(members, labels, texts)), texts))
    return _decisions(signed, every, _united(labels, more))


def _decisions(signed: DataFrame, lines: DataFrame, labels: DataFrame) -> DataFrame:
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row_hash", "at")
    firsts = signed.groupBy("hash").agg(F.min(place).alias("first"))
    labelled = spread_join(firsts, labels, ["hash"], "left").withColumn("component", F.coalesce("component", "hash"))
    keeps = labelled.groupBy("component").agg(F.min("first").alias("keep"))
    of_hash = spread_join(labelled.select("hash", "component"), keeps, ["component"], "inner").select("hash", "keep")
    every = lines.select("_id", "_row_hash", "at", "hash")
    joined = spread_join(every, of_hash, ["hash"], "left")
    kept = F.col("keep").isNull() | place.eqNullSafe(F.col("keep"))
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.col("at").alias("line"),
        F.when(F.col("keep").isNull(), F.col("_id")).otherwise(F.col("keep._id")).alias("keep_doc_id"),
        F.coalesce("keep.at", "at").alias("keep_line"),
        kept.alias("kept"),
        "_row_hash",
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of each text that stay; a text of which no line stays is empty. Null texts become empty."""
    kept = line_components(docs).where("kept").select("doc_id", "_row_hash", F.col("line").alias("at")).distinct()
    places = kept.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_row_id"), "_row_hash").agg(
        F.sort_array(F.collect_set("at")).alias("places")
    )  # lines of one text
    joined = spread_join(packed(docs), places, ROW_KEY, "left")
    lines = F.split(F.coalesce("_row.text", F.lit("")), "\n")
    rebuilt = F.coalesce(F.array_join(F.transform("places", lambda k: F.get(lines, k)), "\n"), F.lit(""))
    return joined.select(*[rebuilt.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
