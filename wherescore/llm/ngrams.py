"""Language-model scores of texts by an n-gram trie that is learnt from the texts themselves and dealt out in shards.

Texts become chunks of bounded size. Words are numbered by their counts in training texts; a table of the different counts
tells the count of a number. Each chunk sends its n-grams to the shards that their contexts belong to, a shard builds the
trie of all that it gets (see trie.py), answers for each n-gram, and the answers are added up by text. Contexts that are too
frequent for one shard are dealt out in parts; shards exchange the counts of these first, so scores do not depend on the parts.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherescore.llm.common import whole_text
from wherescore.llm.trie import GRID, PART_BITS, Trie, build, grid, starts_of, totals
from wherescore.operators.joins import spread_join
from wherescore.operators.prefix import running_sums
from wherescore.sources.scratch import settle

FOLDS, HELD_OUT = 7, 2


@dataclass(frozen=True)
class Limits:
    """Sizes of what one task holds; all but the first two are expectations of balanced hashing. Results do not depend on them."""

    chunk_tokens: int = 1 << 20  # a chunk ends after them
    piece_bytes: int = 1 << 20  # a piece of a text ends at the next white space after them
    vocabulary_words: int = 1 << 20  # different words of each chunk, in a shard of the vocabulary
    shard_tokens: int = 1 << 20  # n-grams in a shard of the trie
    cell_tokens: int = 1 << 18  # n-grams with the same word before the predicted one, beyond which they are parted


_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_END = b""  # no word is empty
_PIECE = ("row", "doc_id", "has_id", "train", "tokens", "lead", "mark")
_TRIE, _SUMS, _PIECES, _NGRAMS, _PARTED, _WHOLE = range(6)
_LEVEL = 6  # of compression


def held_out() -> Column:
    """Rows that nothing is learnt from: crc32 of the id's digits, modulo 7, is 2. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers, as steps if they do not fall: their bytes in planes without leading zeros, compressed."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        raw = np.ascontiguousarray(a).astype("<i8").view("<u8")
        steps = len(raw) > 1 and bool((raw[1:] >= raw[:-1]).all())
        if steps:
            raw = np.diff(raw, prepend=np.uint64(0))
        width = -(-int(raw.max()).bit_length() // 8) if len(raw) else 0
        parts += [struct.pack("<QBB", len(raw), width, steps), raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, found = 1, []
    for _ in range(raw[0]):
        n, width, steps = struct.unpack_from("<QBB", raw, at)
        at += 10
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        values = full.view("<u8").ravel()
        found.append((np.cumsum(values, dtype=np.uint64) if steps else values).view("<i8"))
        at += n * width
    return found


def within(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values that rise within each run, as steps from the value before; a run's first one stays. ``first``: where runs begin."""
    steps = np.diff(values, prepend=0)
    steps[first] = values[first]
    return steps


def without_steps(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values that ``within`` has made steps of."""
    total = np.cumsum(steps)
    return total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(steps))))


def _pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Lower-case words of a text, a bounded stretch at a time."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


class _Chunk:
    """Texts of one task, up to a number of tokens: numbers of their words, and the pieces they are in."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.numbers: list[np.ndarray] = []
        self.pieces: list[tuple[int, ...]] = []
        self.n = 0

    def add(self, row: tuple[int, ...], lead: int, words: list[bytes], mark: int) -> None:
        self.numbers.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self.pieces.append((*row, len(words), lead, mark))
        self.n += len(words)

    def row(self, chunk: int) -> dict[str, object]:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbers = np.concatenate(self.numbers)
        tokens = place[numbers]
        often = np.argsort(-np.bincount(numbers, minlength=len(order)), kind="stable")  # small numbers compress better
        rank = np.empty(len(order), np.int64)
        rank[often] = np.arange(len(order))
        pieces = [np.array(c, np.int64) for c in zip(*self.pieces, strict=True)]
        train, length, lead = (pieces[_PIECE.index(c)] for c in ("train", "tokens", "lead"))
        at = np.arange(len(tokens)) - np.repeat(np.cumsum(length) - length, length)
        learnt = np.repeat(train, length) * (at >= np.repeat(lead, length))
        counts = np.bincount(tokens, learnt, len(order)).astype(np.int64)
        return {
            "chunk": chunk,
            "words": len(order),
            "length": self.n,
            "hashes": pack(hashes[order].view(np.int64)),
            "counts": pack(counts),
            "tokens": pack(rank[numbers], place[often]),
            "pieces": pack(*pieces),
        }


_CHUNK = "chunk long, words long, length long, hashes binary, counts binary, tokens binary, pieces binary"


def chunks(docs: DataFrame, train: Column, limits: Limits) -> DataFrame:
    """Chunks of the texts of ``docs`` (doc_id, text); ``train`` tells the rows that are learnt from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, done, chunk = TaskContext.get().partitionId() << 33, 0, 0, _Chunk()
        names = ("chunk", "words", "length", "hashes", "counts", "tokens", "pieces")

        def flushed() -> pa.RecordBatch:
            row = chunk.row(part + done)
            types = [pa.int64()] * 3 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], list(names))

        for batch in batches:
            for doc_id, learnt, text in zip(*(batch.column(c) for c in range(3)), strict=True):
                raw = text.as_py()
                mark = xxhash.xxh64_intdigest(raw) >> 2
                row = (part + rows, doc_id.as_py() or 0, int(doc_id.is_valid), int(learnt.as_py()))
                rows += 1
                last: list[bytes] = []
                for words in _pieces(raw, limits.piece_bytes):
                    chunk.add(row, len(last), last + words, mark)
                    last = (last + words)[-2:]
                    if chunk.n >= limits.chunk_tokens:
                        yield flushed()
                        done, chunk = done + 1, _Chunk()
                chunk.add(row, len(last), [*last, _END], mark)
        if chunk.n:
            yield flushed()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("_train"), whole_text().cast("binary").alias("_text"))
    return settle(given.mapInArrow(run, _CHUNK))


def _binary_rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


@dataclass
class Vocabulary:
    """Numbers of the words by chunk, and what tells a word's count: words are numbered from the most frequent on."""

    numbers: DataFrame | None
    starts: np.ndarray  # first number of each count, ascending
    counts: np.ndarray  # descending
    tokens: int  # of the training texts
    words: int  # different ones; the number of a word that is not among them, and the next one stands for a text's start
    texts: int  # training texts
    limits: Limits

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words by number; the different counts are at most the root of twice the tokens, so the table is small."""
        if not len(self.starts):
            return np.zeros(len(numbers), np.int64)
        found = self.counts[np.searchsorted(self.starts, numbers, "right") - 1]
        return np.where(numbers < self.words, found, np.where(numbers == self.words + 1, self.texts, 0))

    def parts(self, numbers: np.ndarray) -> np.ndarray:
        """Parts that the n-grams after a word are dealt out in."""
        return -(-self.count(numbers) // self.limits.cell_tokens)

    def parted(self) -> bool:
        """Whether any word has several parts."""
        return max(self.texts, *self.counts[:1]) > self.limits.cell_tokens if len(self.counts) else False

    def alone(self) -> Callable[[np.ndarray], np.ndarray]:
        """Probability of words without context: counts plus one."""
        return lambda numbers: (self.count(numbers) + 1) / (self.tokens + self.words + 1)


def _vocabulary_shard(key: tuple, table: pa.Table) -> pa.Table:
    """Counts of a shard's words over all chunks, handed back by chunk, and how many words have each count."""
    lists = [unpack(p) for p in table.column("payload").to_pylist()]
    words, which = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
    counts = np.bincount(which, np.concatenate([x[1] for x in lists]), len(words)).astype(np.int64)
    order = np.lexsort((words, -counts))
    first = starts_of(counts[order])
    sizes = np.diff(np.append(first, len(order)))
    nth = np.empty(len(words), np.int64)
    nth[order] = np.arange(len(order)) - np.repeat(first, sizes)
    at, rows, shard = 0, [], key[0].as_py()
    for chunk, (own, _) in zip(table.column("chunk").to_pylist(), lists, strict=True):
        mine = which[at : at + len(own)]
        rows.append((shard, chunk, pack(counts[mine], nth[mine]), None, None))
        at += len(own)
    rows += [(shard, None, None, int(c), int(n)) for c, n in zip(counts[order][first], sizes, strict=True) if c]
    return _binary_rows(rows, [("shard", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary()), ("count", pa.int64()), ("n", pa.int64())])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of a chunk's words in one vocabulary shard, plus one; 0 for words that no training text has."""
    for batch in batches:
        found = []
        for payload, classes in zip(batch.column("payload"), batch.column("classes").to_pylist(), strict=True):
            counts, nth = unpack(payload.as_py())
            known = np.array([(0, 0), *sorted((c["count"], c["first"]) for c in classes or [])], np.int64)
            first = known[np.searchsorted(known[:, 0], counts), 1]
            found.append(pack(np.where(counts > 0, first + nth + 1, 0)))
        columns = [batch.column("chunk"), batch.column("shard"), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "numbers"])


def vocabulary(chunked: DataFrame, texts: int, limits: Limits) -> Vocabulary:
    """Numbers of all words. Shards of the vocabulary are ranges of hashes, so a chunk's words of a shard are one stretch."""
    total = chunked.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // limits.vocabulary_words))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([k * (1 << 64) // shards for k in range(1, shards)], np.uint64)
        for batch in batches:
            for chunk, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes", "counts")), strict=True):
                (h,), (c,) = unpack(hashes), unpack(counts)
                cuts = [0, *np.searchsorted(h.view(np.uint64), bounds), len(h)]
                rows = [(k, chunk, pack(h[a:b], c[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                schema = [("shard", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())]
                yield from _binary_rows(rows, schema).to_batches()

    sent = chunked.select("chunk", "hashes", "counts").mapInArrow(send, "shard long, chunk long, payload binary")
    merged = settle(
        sent.groupBy("shard").applyInArrow(_vocabulary_shard, "shard long, chunk long, payload binary, count long, n long")
    )
    classes = settle(merged.where("count is not null").select("shard", "count", "n"))
    upto = settle(running_sums(classes, [], [F.col("count").desc(), "shard"], {"upto": "n"}))
    firsts = upto.select("shard", "count", (F.col("upto") - F.col("n")).alias("first"))
    steps = firsts.groupBy("count").agg(F.min("first").alias("first")).toPandas().sort_values("first")
    words, tokens = (int(x or 0) for x in classes.agg(F.sum("n"), F.sum(F.col("count") * F.col("n"))).first())
    by_shard = firsts.groupBy("shard").agg(F.collect_list(F.struct("count", "first")).alias("classes"))
    answers = spread_join(merged.where("chunk is not null").select("shard", "chunk", "payload"), by_shard, ["shard"], "left")
    numbers = answers.select("chunk", "shard", "payload", "classes").mapInArrow(_numbered, "chunk long, shard long, numbers binary")
    starts, counts = (steps[c].to_numpy(np.int64) for c in ("first", "count"))
    return Vocabulary(numbers, starts, counts, tokens, words, texts, limits)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Hash of whole numbers, not negative."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def cells(v: np.ndarray, u: np.ndarray, mark: np.ndarray, model: Vocabulary) -> np.ndarray:
    """Cell of each n-gram: the word v before w, and a part of v's n-grams.

    A word of more than ``cell_tokens`` tokens has parts: by the word u before it, and where u is as frequent too, by the
    text's hash, so that no word, pair of words or passage, however frequent, is in one place. Parts follow from counts alone;
    shards add their counts up over the parts (see _parted), so that scores are those of the undivided word.
    """
    parts = model.parts(v)
    both = np.minimum(model.parts(u), parts)
    part = (_mixed(u) + mark % np.maximum(both, 1)) % np.maximum(parts, 1)
    return (v << PART_BITS) | part


def _sent(chunk: dict, numbers: list[bytes], model: Vocabulary, shards: int) -> Iterator[tuple]:
    """N-grams of a chunk by shard, and what its pieces add up to without them."""
    tokens, place = unpack(chunk["tokens"])
    pieces = dict(zip(_PIECE, unpack(chunk["pieces"]), strict=True))
    word = np.concatenate([unpack(n)[0] for n in numbers]) - 1
    word = np.where(word < 0, model.words, word)
    names = np.unique(np.append(word, [model.words, model.words + 1]))  # chunk's words by number
    own = np.searchsorted(names, word)[place][tokens]
    start = len(names) - 1
    n, length = len(own), pieces["tokens"]
    piece = np.repeat(np.arange(len(length)), length)
    at = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    v, u = np.full(n, start), np.full(n, start)
    v[1:], u[2:] = own[:-1], own[:-2]
    v[at == 0] = start
    u[at <= 1] = start
    counted = at >= pieces["lead"][piece]
    often = model.count(names)
    alone = model.alone()(names)
    size = len(length)
    sums = lambda x: np.bincount(piece[counted], x[own[counted]], size)
    unseen = counted & (names[v] == model.words)  # after a word that no training text has
    left = np.bincount(piece[unseen], grid(alone)[own[unseen]], size).astype(np.int64)
    known = sums((often > 0).astype(float)).astype(np.int64)
    count = np.bincount(piece[counted], minlength=size)
    base = sums(np.log10(alone))
    rows = pack(*(pieces[c] for c in ("row", "doc_id", "has_id", "train")), count, known, left, base.view(np.int64))
    yield (int(_mixed(np.array([chunk["chunk"]]))[0] % shards), _PIECES, chunk["chunk"], rows)

    keep = np.flatnonzero(counted & ~unseen)
    v, u, w, piece = v[keep], u[keep], own[keep], piece[keep]
    cell, which = np.unique(cells(names[v], names[u], pieces["mark"][piece], model), return_inverse=True)
    shard = _mixed(cell) % shards
    parted = model.parts(cell >> PART_BITS) > 1
    order = np.lexsort((parted, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = (rank[which] << 42) | (u << 21) | w
    by = np.argsort(key, kind="stable")
    first = starts_of(key[by])
    occurrences = np.diff(np.append(first, len(by)))
    learnt = np.add.reduceat(pieces["train"][piece[by]], first) if len(first) else first
    key, piece = key[by][first], piece[by]
    cell_of, u, w = key >> 42, names[(key >> 21) & ((1 << 21) - 1)], names[key & ((1 << 21) - 1)]
    runs = np.append(starts_of(shard[order][cell_of], parted[order][cell_of]), len(key))
    ends = np.append(0, np.cumsum(occurrences))
    for a, b in zip(runs[:-1], runs[1:], strict=True):
        here = starts_of(cell_of[a:b])
        of_cell = cell[order][cell_of[a:b][here]]
        pairs = starts_of(cell_of[a:b], u[a:b])
        payload = pack(
            of_cell, np.diff(np.append(here, b - a)),
            within(u[a:b][pairs], np.searchsorted(pairs, here)), np.diff(np.append(pairs, b - a)),
            w[a:b], learnt[a:b], occurrences[a:b], piece[ends[a] : ends[b]],
        )
        yield (int(shard[order][cell_of[a]]), _PARTED if parted[order][cell_of[a]] else _NGRAMS, chunk["chunk"], payload)


_MESSAGE = [("shard", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())]
_MESSAGE_SCHEMA = "shard long, kind int, chunk long, payload binary"


def ngrams(chunked: DataFrame, model: Vocabulary, shards: int) -> DataFrame:
    """Messages to the shards (shard, kind, chunk, payload): the different n-grams of each chunk with training counts and places."""
    known = replace(model, numbers=None)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = right.sort_by("shard").column("numbers").to_pylist()
        rows = [x for chunk in left.to_pylist() for x in _sent(chunk, numbers, known, shards)]
        return _binary_rows(rows, _MESSAGE)

    own = chunked.select("chunk", "tokens", "pieces").groupBy("chunk")
    return own.cogroup(model.numbers.groupBy("chunk")).applyInArrow(run, _MESSAGE_SCHEMA)


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in ("kind", "chunk", "payload")), strict=True)


def _entries(sent: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Cell, u, w and training count of all n-grams of some messages."""
    first = lambda m: np.searchsorted(np.cumsum(m[3]) - m[3], np.cumsum(m[1]) - m[1])  # noqa: E731  pair that a cell begins with
    cell = np.concatenate([np.repeat(m[0], m[1]) for m in sent])
    u = np.concatenate([np.repeat(without_steps(m[2], first(m)), m[3]) for m in sent])
    return cell, u, *(np.concatenate([m[k] for m in sent]) for k in (4, 5))


def _dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(to, kind="stable")
    cuts = np.append(starts_of(to[order]), len(to))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(to[order[a]]), pack(*(c[order[a:b]] for c in columns))


def _parted(model: Vocabulary, groups: int):
    """Counts that a shard has of parted words: of each successor w, and where u is as frequent too, of each (u, w).

    They are dealt out by (u, v, w) to be added up; a u of -1 stands for any word.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows, shard = [], key[0].as_py()
        sent = [unpack(payload) for kind, _, payload in _rows(table) if kind == _PARTED]
        if sent:
            cell, u, w, learnt = _entries(sent)
            hot = model.parts(u) > 1
            twice = lambda x, y: np.concatenate([x, y[hot]])
            (cell, u, w), (n,), _ = totals((twice(cell, cell), twice(np.full(len(u), -1), u), twice(w, w)), (twice(learnt, learnt),))
            to = _mixed(_mixed(_mixed(cell >> PART_BITS) + u) + w) % groups
            rows = [(group, _PARTED, shard, payload) for group, payload in _dealt(to, cell, u + 1, w, n)]
        return _binary_rows(rows, _MESSAGE)

    return run


def _whole(model: Vocabulary, shards: int):
    """Sums over all shards: of each n-gram, for the shards that have it, and of each context, for all of its parts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = [(source, *unpack(payload)) for _, source, payload in _rows(table)]
        cell, u, w, n = (np.concatenate([x[k] for x in lists]) for k in (1, 2, 3, 4))
        u = u - 1
        (v, own_u, _), (sums,), which = totals((cell >> PART_BITS, u, w), (n,))
        rows, at = [], 0
        for source, mine, *_ in lists:
            some = at + np.flatnonzero(sums[which[at : at + len(mine)]])
            at += len(mine)
            rows.append((source, _WHOLE, None, pack(cell[some], u[some] + 1, w[some] + 1, sums[which[some]], np.ones(len(some), np.int64))))
        some = sums > 0
        (v, own_u), (n, followers), _ = totals((v[some], own_u[some]), (sums[some], np.ones(some.sum(), np.int64)))
        parts = model.parts(v)
        spread = np.where(own_u < 0, parts, np.minimum(model.parts(own_u), parts))  # as in cells()
        of = np.repeat(np.arange(len(v)), spread)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(spread) - spread, spread)
        part = np.where(own_u[of] < 0, nth, (_mixed(own_u[of]) + nth) % parts[of])
        cell = (v[of] << PART_BITS) | part
        columns = (cell, own_u[of] + 1, np.zeros(len(of), np.int64), n[of], followers[of])
        rows += [(shard, _WHOLE, None, payload) for shard, payload in _dealt(_mixed(cell) % shards, *columns)]
        return _binary_rows(rows, _MESSAGE)

    return run


def _shard(model: Vocabulary):
    """Builds a shard's trie from the training counts of all chunks, and answers each chunk from it."""

    def run(key: tuple, table: pa.Table, others: pa.Table | None = None) -> pa.Table:
        shard, rows, chunk_of, sent = key[0].as_py(), [], [], []
        for kind, chunk, payload in _rows(table):
            if kind == _PIECES:
                rows.append((shard, kind, chunk, payload))
            else:
                chunk_of.append(chunk)
                sent.append(unpack(payload))
        if sent:
            whole = None
            if others is not None and len(others):
                cell, u, w, n, followers = (np.concatenate(x) for x in zip(*(unpack(p) for _, _, p in _rows(others)), strict=True))
                (cell, u, w), (n, followers), _ = totals((cell, u - 1, w - 1), (n, followers))
                whole = (cell, u, w, n, followers)
            cell, u, w, learnt = _entries(sent)
            sent = [(len(m[4]), m[6].astype(np.int32), m[7].astype(np.int32)) for m in sent]
            some = learnt > 0
            blob = build(cell[some], u[some], w[some], learnt[some], model.alone(), whole)
            del some, learnt, whole
            answers = Trie(blob).score(cell, u, w, model.alone())
            rows.append((shard, _TRIE, None, zstandard.ZstdCompressor(level=3).compress(blob)))
            at = 0
            for chunk, (n, occurrences, piece) in zip(chunk_of, sent, strict=True):
                mine = np.repeat(answers[at : at + n], occurrences)
                at += n
                touched, where = np.unique(piece, return_inverse=True)
                rows.append((shard, _SUMS, chunk, pack(touched, np.bincount(where, mine, len(touched)).astype(np.int64))))
        return _binary_rows(rows, _MESSAGE)

    return run


def _answered(messages: DataFrame, model: Vocabulary, shards: int) -> DataFrame:
    """Tries and answers of the shards. What they exchange before comes from the same shuffle of the messages, which Spark reuses."""
    run = _shard(model)
    if not model.parted():
        return messages.groupBy("shard").applyInArrow(lambda key, table: run(key, table), _MESSAGE_SCHEMA)
    groups = -(-shards // 4)  # less than a quarter of what the shards get
    counts = messages.groupBy("shard").applyInArrow(_parted(model, groups), _MESSAGE_SCHEMA)
    whole = counts.groupBy("shard").applyInArrow(_whole(model, shards), _MESSAGE_SCHEMA)
    return messages.groupBy("shard").cogroup(whole.groupBy("shard")).applyInArrow(run, _MESSAGE_SCHEMA)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of a chunk's pieces over all shards."""
    parts = list(zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True))
    row, doc_id, has_id, train, count, known, left, base = next(unpack(p) for k, p in parts if k == _PIECES)
    total = left.copy()
    for kind, payload in parts:
        if kind == _SUMS:
            touched, sums = unpack(payload)
            total[touched] += sums
    columns = [row, pa.array(doc_id, mask=has_id == 0), train == 0, count, known, base.view(np.float64), total]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], list(_SCORED))


_SCORED = ("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "steps")
_SCORED_SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, steps long"


@dataclass
class Scored:
    """``rows``: one for each row of the input; ``tries``: the model, a compressed trie for each shard (shard, payload)."""

    rows: DataFrame
    tries: DataFrame


def score_documents(docs: DataFrame, train: Column | None = None, limits: Limits = Limits()) -> Scored:
    """Learn from the rows of ``docs`` that ``train`` holds for (default: all that are not held out) and score all rows.

    Rows: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts are lower-cased in A-Z and split at ASCII
    white space; an end follows, so null, empty and blank texts have one token. ``base_score`` is the sum of log10 of
    smoothed word probabilities, ``score`` that of the trie's, kept in steps of 1 / GRID. Repeated rows keep a row each, null ids
    are kept. An empty table gives no rows; without training rows all words are unknown and both scores 0.
    Columns other than doc_id and text are not looked at. Words are told apart by 64-bit hashes.
    """
    learnt = ~held_out() if train is None else train
    chunked = chunks(docs, learnt, limits)
    texts = docs.where(learnt).count()
    model = vocabulary(chunked, texts, limits)
    known = replace(model, numbers=None)
    total = chunked.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // limits.shard_tokens))
    answered = settle(_answered(ngrams(chunked, model, shards), known, shards))
    sums = answered.where(F.col("kind").isin(_SUMS, _PIECES)).groupBy("chunk").applyInArrow(_added, _SCORED_SCHEMA)
    per_row = sums.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in _SCORED[3:]])
    rows = per_row.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        (-F.col("steps") / GRID).alias("score"),
    )
    return Scored(rows, answered.where(F.col("kind") == _TRIE).select("shard", "payload"))
