"""Byte-level tokenising and hashing of Arrow text batches with numpy.

Every function works on one *block*: some whole documents laid end to end in one uint8 array, with
``offsets`` (len = documents + 1) marking where each begins. Blocks are a few hundred kB, so the
temporary arrays stay in cache; only a document longer than that makes a larger block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_U = np.uint64


def _class_table(ranges: list[tuple[int, int]], member: bool) -> np.ndarray:
    table = np.full(256, not member)
    for lo, hi in ranges:
        table[lo : hi + 1] = member
    return table


#: [^\x20\x09-\x0D]+
NON_SPACE = _class_table([(0x09, 0x0D), (0x20, 0x20)], False)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased
ALNUM = _class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], False)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of an Arrow string array; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from zero) for runs of rows of about ``size`` bytes."""
    data, offsets = text_bytes(column)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of the words, and where each document's words begin (len docs + 1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. keep: the class table the words were cut with."""
    if not len(start):
        return np.zeros(0, np.uint64)
    value = np.where(keep, _BYTE, _U(0))[data[start[0] :]]
    place = np.arange(start[0], len(data))
    place -= np.repeat(start, np.diff(start, append=len(data)))
    value *= _PLACE[place & 255]
    return mix(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of words i .. i+k-1 at i; len(h) - k + 1 of them (documents are not told apart)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _GRAM[j & 63]
    return mix(out)


def gram_ok(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the gram_hashes lie within one document."""
    n = max(n_words - k + 1, 0)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:n] == doc[k - 1 : k - 1 + n] if n else np.zeros(0, bool)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i:i+w] at i; len(x) - w + 1 values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[w - span : w - span + n])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its part) with the same connected parts as the edges a-b; roots left out."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        was = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        root = root[root]
        if (root == was).all() and (root[x] == root[y]).all():
            break
    node = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[node], nodes[root[node]]
