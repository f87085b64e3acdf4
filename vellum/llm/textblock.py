"""Byte-level numpy kernels shared by the corpus operators.

Arrow string columns are read without copying: a block is a run of rows whose texts together hold about
``BLOCK_BYTES`` bytes (one longer text forms a block of its own), so temporaries stay small whatever the batch.
All word and line rules used by the operators separate on ASCII bytes only, so they can be applied to UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITESPACE)] = True
NOT_SPACE = ~IS_SPACE
#: digits, lower-case ASCII letters and every non-ASCII byte; apply after LOWER
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True


def power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base ("up") or of its inverse ("down") modulo 2**64."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES), _BASE if kind == "up" else _INVERSE, U)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection that spreads every input bit over the word."""
    z = z ^ (z >> U(30))
    z = z * U(0xBF58476D1CE4E5B9)
    z = z ^ (z >> U(27))
    z = z * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


class Block:
    """Consecutive texts: ``buf`` holds their bytes end to end, text i is ``buf[offs[i]:offs[i + 1]]``."""

    def __init__(self, first: int, buf: np.ndarray, offs: np.ndarray):
        self.first, self.buf, self.offs, self.n = first, buf, offs, len(offs) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes where inside holds, never across texts: starts, ends, and each text's first run (n + 1)."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offs] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        st = np.flatnonzero(start)
        return st, np.flatnonzero(end) + 1, np.searchsorted(st, self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines as cut at every newline: starts, ends, and each text's first line; an empty text has one empty line."""
        nl = np.flatnonzero(self.buf == 10)
        st = np.concatenate([self.offs[:-1], nl + 1])
        key = np.concatenate([np.arange(self.n), np.searchsorted(self.offs, nl, "right") - 1])
        order = np.lexsort((st, key))
        st, key = st[order], key[order]
        first = np.searchsorted(key, np.arange(self.n + 1))
        en = np.empty_like(st)
        en[:-1] = st[1:] - 1
        if self.n:
            en[first[1:] - 1] = self.offs[1:]
        return st, en, first

    def prefix(self, buf: np.ndarray | None = None) -> np.ndarray:
        """Running polynomial sums from which ``cut`` takes the hash of any byte range."""
        buf = self.buf if buf is None else buf
        out = np.zeros(len(buf) + 1, U)
        np.cumsum(_BYTE[buf] * power("up", len(buf)), out=out[1:])
        return out


def cut(prefix: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
    return mix((prefix[en] - prefix[st]) * power("down", len(prefix))[st] + (en - st).astype(U) * U(0xD6E8FEB86659FD93))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A null text counts as an empty one."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def words(block: Block, inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that ``inside`` marks: starts, ends, each text's first run, hashes (of the lower-cased bytes)."""
    buf = LOWER[block.buf] if lower else block.buf
    st, en, first = block.spans(inside[buf])
    return st, en, first, cut(block.prefix(buf), st, en)


_PLACE = [U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(first: np.ndarray, hashes: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a text with fewer words than size has its whole sequence as one."""
    n = len(hashes) - size + 1
    if n > 0:
        total = hashes[:n] * _PLACE[0]
        for j in range(1, size):
            total = mix(total) + hashes[j : n + j] * _PLACE[j % 5]
        total = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(total[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.array([b - a], U)
            for k in range(a, b):
                h = mix(h * _PLACE[1] + hashes[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out
