"""Words of many texts at once: byte arrays instead of a Python loop per word.

A block is a run of whole texts of about ``BLOCK_BYTES`` (one longer text is a block of its own). Its bytes
are classified by one table look-up, word edges come from where the class changes, and every word gets
a 64-bit polynomial fingerprint from one running sum, so cost follows bytes and memory follows a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


#: A byte that UTF-8 never has.
APART = 255


def split_table(delimiters: bytes, lower: bool) -> np.ndarray:
    """For every byte: APART if it parts words, else the byte itself (A-Z as a-z if ``lower``)."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(delimiters)] = APART
    return table


#: Words are runs without space and \x09-\x0D.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Words are runs of digits, lower-cased ASCII letters and everything beyond ASCII.
NOT_ALNUM = bytes(x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown to the longest block seen."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_SYMBOLS = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprints(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each stretch ``symbols[start:end]`` of a byte array."""
    n = len(symbols)
    up, down = _POWERS.get(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_SYMBOLS[symbols] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Block:
    """Texts ``first`` .. ``first + len(offsets) - 2`` of a column."""

    first: int
    raw: np.ndarray
    symbols: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray  # number of the first word of every text, then the number of words

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        return fingerprints(self.symbols, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.word_at))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return np.diff(total[self.offsets])

    def word_sums(self, flags: np.ndarray) -> np.ndarray:
        """How many words of each text are flagged."""
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return np.diff(total[self.word_at])

    def word(self, i: int) -> bytes:
        return self.symbols[self.starts[i] : self.ends[i]].tobytes()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, and where each text begins (then the end)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def block_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, first: int = 0) -> Block:
    symbols = table[raw]
    n = len(symbols)
    inside = symbols != APART
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return Block(first, raw, symbols, offsets, starts, ends, np.searchsorted(starts, offsets))


def blocks(column: pa.Array, table: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column without nulls, in order, in blocks of whole texts."""
    raw, offsets = column_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield block_of(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, i)
        i = j
