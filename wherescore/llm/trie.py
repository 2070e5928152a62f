"""Compact n-gram trie of one shard: Elias-Fano levels under monotone pointers, probabilities on a fixed grid.

A cell is a word v (with a part number, where v is too frequent for one shard) that precedes the predicted word w; u is the
word before v. The levels are the cells, the successors w of each cell, the words u before each cell, and the successors
of each (u, cell), which are written as ranks among the successors of the cell: small numbers, whose search starts from the
place that the level above has found.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from dataclasses import dataclass

import numpy as np

#: Subtracted from each count; its mass goes to the shorter context.
DISCOUNT = 0.75
#: Probabilities are kept as -log10 in steps of 1 / GRID.
GRID = 64
PART_BITS = 24


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    if not width or not len(values):
        return b""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)]
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    raw = np.zeros((n, 8), np.uint8)
    found = np.packbits(bits, axis=1, bitorder="little")
    raw[:, : found.shape[1]] = found
    return raw.view("<u8").ravel().astype(np.int64)


def elias_fano(values: np.ndarray) -> bytes:
    """Non-decreasing whole numbers: low bits as they are, high parts in unary; about 2 + log2(range / n) bits each."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = np.zeros((top >> low) + n, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    ones, lows = np.packbits(high, bitorder="little").tobytes(), pack_bits(values, low)
    return struct.pack("<QQQB", n, len(high), len(ones), low) + ones + lows


def elias_fano_values(data: np.ndarray) -> np.ndarray:
    n, length, size, low = struct.unpack_from("<QQQB", data)
    ones = np.unpackbits(data[25 : 25 + size], count=length, bitorder="little")
    high = np.flatnonzero(ones) - np.arange(n)
    return (high << low) + unpack_bits(data[25 + size :], n, low)


def grid(p: np.ndarray) -> np.ndarray:
    """Probabilities as steps of -log10."""
    return np.rint(-np.log10(p) * GRID).astype(np.int64)


def codes(values: np.ndarray) -> bytes:
    width = int(values.max()).bit_length() if len(values) else 0
    return struct.pack("<QB", len(values), width) + pack_bits(values, width)


def code_values(data: np.ndarray) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    return unpack_bits(data[9:], n, width)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal values in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    changed = np.zeros(len(columns[0]), bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def rising(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Values that rise within each range, shifted by range so that they rise throughout."""
    full = pointers[:-1] < pointers[1:]
    tops = np.zeros(len(full), np.int64)
    tops[full] = values[pointers[1:][full] - 1] + 1
    shift = np.concatenate([[0], np.cumsum(tops)[:-1]]) if len(tops) else np.zeros(0, np.int64)
    return values + np.repeat(shift, np.diff(pointers))


@dataclass
class Level:
    """Ranges of a level, and how to find a value within one of them."""

    pointers: np.ndarray
    values: np.ndarray

    def find(self, ranges: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted value in its range, -1 if it is not there or the range is -1: successor search."""
        if not len(self.values):
            return np.full(len(wanted), -1)
        first = self.pointers[ranges]
        shift = np.where(first > 0, self.values[first - 1] + 1, 0)
        at = np.searchsorted(self.values, wanted + shift)
        inside = (ranges >= 0) & (at < self.pointers[ranges + 1])
        at = np.minimum(at, len(self.values) - 1)
        return np.where(inside & (self.values[at] == wanted + shift), at, -1)


_SECTIONS = ("cells", "cell_bow", "w_at", "w", "w_p", "u_at", "u", "u_bow", "r_at", "r", "r_p")


def totals(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...], given: int = 0) -> tuple[list, list, np.ndarray]:
    """Different keys in order, the sum of each one's values, and the group of each row; the values of a key among the
    first ``given`` rows are its sums already."""
    order = np.lexsort(keys[::-1])  # stable, so given rows come first
    first = starts_of(*[k[order] for k in keys])
    at = order[first]
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    sums = [np.where(at < given, v[at], np.add.reduceat(v[order], first)) if len(first) else v for v in values]
    return [k[at] for k in keys], sums, group


def build(cell: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, p1, whole: tuple[np.ndarray, ...] | None = None) -> bytes:
    """The trie of counted (u, cell, w); ``p1`` gives the probability of words without context.

    Interpolated absolute discounting: p(w | cell) from the cell's counts and p1, p(w | u, cell) from those and p(w | cell).
    ``whole`` (cell, u, w, count, followers) has what holds in place of the sums of these rows, for contexts of which other
    shards have counts too; a u of -1 stands for any word before, a w of -1 for all successors, and followers are the different ones.
    """
    cell0, u0, w0, n0, t0 = whole or [np.zeros(0, np.int64)] * 5

    def merged(some: np.ndarray, keys: tuple, values: tuple, own_keys: tuple, own_values: tuple) -> tuple[list, list, np.ndarray]:
        """Totals, and the group of each own row."""
        joined = lambda given, own: tuple(np.concatenate([g[some], o]) for g, o in zip(given, own, strict=True))
        given = int(some.sum())
        found, sums, group = totals(joined(keys, own_keys), joined(values, own_values), given)
        return found, sums, group[given:]

    def pointers(group: np.ndarray, n: int) -> np.ndarray:
        return np.append(0, np.cumsum(np.bincount(group, minlength=n)))

    (cell, u, w), (count,), _ = merged((u0 >= 0) & (w0 >= 0), (cell0, u0, w0), (n0,), (cell, u, w), (count,))
    (pair_cell, pair_w), (pair_count,), pair = merged((u0 < 0) & (w0 >= 0), (cell0, w0), (n0,), (cell, w), (count,))
    one = np.ones(len(pair_cell), np.int64)
    (cells,), (total, followers), per_pair = merged((u0 < 0) & (w0 < 0), (cell0,), (n0, t0), (pair_cell,), (pair_count, one))
    w_at = pointers(per_pair, len(cells))
    cell_bow = DISCOUNT * followers / total
    w_p = (pair_count - DISCOUNT) / total[per_pair] + cell_bow[per_pair] * p1(pair_w)

    one = np.ones(len(cell), np.int64)
    (context_cell, context_u), (seen, followers), per_entry = merged(
        (u0 >= 0) & (w0 < 0), (cell0, u0), (n0, t0), (cell, u), (count, one)
    )
    r_at = pointers(per_entry, len(seen))
    u_at = pointers(np.searchsorted(cells, context_cell), len(cells))
    u_bow = DISCOUNT * followers / seen
    r_p = (count - DISCOUNT) / seen[per_entry] + u_bow[per_entry] * w_p[pair]
    ranks = pair - w_at[np.searchsorted(cells, cell)] if len(cells) else pair

    parts = (
        elias_fano(cells), codes(grid(cell_bow)),
        elias_fano(w_at), elias_fano(rising(pair_w, w_at)), codes(grid(w_p)),
        elias_fano(u_at), elias_fano(rising(context_u, u_at)), codes(grid(u_bow)),
        elias_fano(r_at), elias_fano(rising(ranks, r_at)), codes(grid(r_p)),
    )
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class Trie:
    """A trie read from a file that is mapped into memory and has no name, so that nothing is left behind."""

    def __init__(self, blob: bytes) -> None:
        with tempfile.TemporaryFile() as file:
            file.write(blob)
            file.flush()
            self._map = mmap.mmap(file.fileno(), len(blob), access=mmap.ACCESS_READ)
        sizes = struct.unpack_from(f"<{len(_SECTIONS)}Q", self._map)
        at, data, self._parts = 8 * len(_SECTIONS), np.frombuffer(self._map, np.uint8), {}
        for name, size in zip(_SECTIONS, sizes, strict=True):
            self._parts[name] = data[at : at + size]
            at += size

    def _monotone(self, name: str) -> np.ndarray:
        return elias_fano_values(self._parts[name])

    def _codes(self, name: str) -> np.ndarray:
        return np.append(code_values(self._parts[name]), 0)  # the last one is for places of -1

    def score(self, cell: np.ndarray, u: np.ndarray, w: np.ndarray, p1) -> np.ndarray:
        """Steps of -log10 p(w | u, cell). Levels are unpacked one after the other, each once for all questions."""
        cells = self._monotone("cells")
        at = np.minimum(np.searchsorted(cells, cell), max(0, len(cells) - 1))
        known = cells[at] == cell if len(cells) else np.zeros(len(cell), bool)
        ranges = np.where(known, at, -1)
        successors = Level(self._monotone("w_at"), self._monotone("w"))
        pair = successors.find(ranges, w)
        short = self._codes("w_p")[pair] + np.where(pair < 0, self._codes("cell_bow")[ranges] + grid(p1(w)), 0)
        rank = pair - successors.pointers[ranges]
        del successors
        context = Level(self._monotone("u_at"), self._monotone("u")).find(ranges, u)
        full = Level(self._monotone("r_at"), self._monotone("r")).find(np.where(pair < 0, -1, context), rank)
        return np.where(full >= 0, self._codes("r_p")[full], self._codes("u_bow")[context] + short)
