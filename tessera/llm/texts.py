"""Words, shingles and lines of whole texts as numpy arrays, straight from Arrow's buffers.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. It is known by a 64-bit hash of its bytes: the sum of
its 8-byte pieces, each mixed with its place. So two different words of one corpus are confused with a chance of about
(distinct words)^2 / 2^65, however they are structured.
Nothing here is a Python object per word: a block of texts is a byte array, and every step is one array operation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 19
_GOLDEN, _MUL_A, _MUL_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> U(30))) * _MUL_A
    x = (x ^ (x >> U(27))) * _MUL_B
    return x ^ (x >> U(31))


def chain(state: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hash of a sequence that is one item longer."""
    return mix(state * _GOLDEN + item + U(0x632BE59BD9B4E019))


def numbers(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * _GOLDEN + U(seed))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z count as a-z
#: Masks of the bytes that are left in a word's last piece.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
END = int(mix(np.array([0xE0D], dtype=U))[0])  # the token after a text's last word; no word has a reserved hash


@dataclass
class Block:
    """Whole texts of neighbouring rows. bounds: where each text starts, and the end of the last."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    hash: np.ndarray
    row: np.ndarray  # row in the block, not decreasing
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray  # words per row


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """A text column in blocks of about `most` bytes, a longer text alone; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, len(column))
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def _spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]. An empty span is a piece without bytes."""
    if not len(start):
        return np.zeros(0, dtype=U)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    pieces = np.maximum(1, -(-size // 8))
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    place = np.arange(pieces.sum()) - np.repeat(first, pieces)
    at = np.repeat(start, pieces) + 8 * place
    piece = eight[at] & _LEFT[np.minimum(np.repeat(end, pieces) - at, 8)]
    sums = np.add.reduceat(mix(piece ^ mix(place.astype(U) + _MUL_A)), first)
    return mix(sums + size.astype(U) * _GOLDEN)


def words(block: Block, lower: bool = True) -> Words:
    n = len(block.data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[block.data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = block.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges + 1]
    ends[edges - 1] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(block.bounds, start, side="right") - 1
    return Words(_spans_hash(_LOWER[block.data] if lower else block.data, start, end), row, start, end, np.bincount(row, minlength=block.rows))


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line between \\n: its row, its hash (case and spaces count), and whether it has a word."""
    breaks = np.flatnonzero(block.data == 10)
    start = np.sort(np.concatenate([block.bounds[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, block.bounds[1:]]))
    per_row = np.bincount(np.searchsorted(block.bounds, breaks, side="right") - 1, minlength=block.rows) + 1
    row = np.repeat(np.arange(block.rows), per_row)
    visible = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(~_SPACE[block.data], out=visible[1:])
    return row, _spans_hash(block.data, start, end), visible[end] > visible[start]


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words inside a text, and the index of its first word."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    key = np.full(len(at), size, dtype=U)
    for k in range(size):
        key = chain(key, w.hash[at + k])
    return key, at


def shingles(w: Words, size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (row, hash), sorted by both; a text with fewer words gives its whole sequence as one."""
    key, at = windows(w, size)
    row = w.row[at]
    first = np.concatenate([[0], np.cumsum(w.count)])[:-1]
    for n in range(1, size):
        short = np.flatnonzero(w.count == n)
        whole = np.full(len(short), n, dtype=U)
        for k in range(n):
            whole = chain(whole, w.hash[first[short] + k])
        key, row = np.concatenate([key, whole]), np.concatenate([row, short])
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[new], key[new]


def by_row(row: np.ndarray, rows: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Counts (or sums) per row as 64-bit integers."""
    return np.bincount(row, weights=weight, minlength=rows).astype(np.int64)


def byte_counts(block: Block, table: np.ndarray) -> np.ndarray:
    """Bytes of each row for which the table of 256 truth values holds."""
    total = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(table[block.data], out=total[1:])
    return total[block.bounds[1:]] - total[block.bounds[:-1]]


def repeated_words(w: Words, size: int, rows: int) -> np.ndarray:
    """Words of each text that lie in a window of `size` words found twice or more in it."""
    key, at = windows(w, size)
    if not len(key):
        return np.zeros(rows, dtype=np.int64)
    key = mix(key + w.row[at].astype(U) * _GOLDEN)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(w.hash), dtype=bool)
    for k in range(size):
        covered[at[again] + k] = True
    return by_row(w.row[covered], rows)


def distinct_in_row(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """How many different keys each row has."""
    _, index = np.unique(mix(key + row.astype(U) * _GOLDEN), return_index=True)
    return by_row(row[index], rows)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64)
