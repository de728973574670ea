"""Word and shingle hashes of whole Arrow text columns, in numpy, a bounded block at a time.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are folded to a-z, every other byte counts as it is.
A null text is an empty one. The hash of a word joins polynomials over its bytes modulo 2**64 and modulo two primes, so that all words of
a block come from running sums; words that are made to collide modulo 2**64 differ modulo the primes. Texts longer than a block are cut
between words, never shortened.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
#: Primes below 2**31 with a base of each.
_PRIMES = ((2_147_483_647, 1_316_830_717), (2_147_483_629, 707_106_781))
#: Bytes whose values times powers below 2**31 a sum of 64 bits holds.
_SUMMED = 1 << 24
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


_kept: dict[object, object] = {}


def kept(owner: object, make) -> object:
    """What this worker keeps for an operator with its model from task to task; it is made once, and that of another owner is dropped."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


def tidy(owner: object = None) -> None:
    """At the end of a task: drops what is kept for others than owner and hands unused memory back to the system."""
    for other in [k for k in _kept if k != owner]:
        del _kept[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class WordTable:
    """Numbers for words, by their hashes, in sorted arrays: 17 bytes a word. An owner keeps what it knows of a word under its number.

    Beyond `limit` words those met in one block only are forgotten, or all if too few are.
    """

    def __init__(self, limit: int):
        self.limit, self.keys, self.slots, self.again = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of sorted, different keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = np.where(self.keys[at] == keys, self.slots[at], -1)
        self.again[found[found >= 0]] = True
        return found

    def add(self, keys: np.ndarray) -> np.ndarray:
        """New numbers for sorted, unknown keys, counting on from the last."""
        slots = len(self.again) + np.arange(len(keys))
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.slots = every[order], np.concatenate([self.slots, slots])[order]
        self.again = np.concatenate([self.again, np.zeros(len(keys), bool)])
        return slots

    def full(self, more: int) -> np.ndarray | None:
        """Before adding more words than fit: forgets some, and gives the old numbers of the others in the order of their new ones."""
        if len(self.keys) + more <= self.limit:
            return None
        some = np.flatnonzero(self.again) if self.again.sum() < self.limit // 2 else np.zeros(0, np.int64)
        new = np.full(len(self.again), -1)
        new[some] = np.arange(len(some))
        stay = new[self.slots] >= 0
        self.keys, self.slots, self.again = self.keys[stay], new[self.slots[stay]], np.zeros(len(some), bool)
        return some


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def _prime_power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of a prime and of its inverse, by doubling."""
    if f"up{k}" not in _powers or len(_powers[f"up{k}"]) < n:
        prime, base = _PRIMES[k]
        for name, x in (("up", base), ("down", pow(base, -1, prime))):
            powers = np.ones(1, np.uint64)
            while len(powers) < max(n, BLOCK + 1):
                powers = np.concatenate([powers, powers * np.uint64(pow(x, len(powers), prime)) % np.uint64(prime)])
            _powers[f"{name}{k}"] = powers[: max(n, BLOCK + 1)].astype(np.uint32)
    return _powers[f"up{k}"], _powers[f"down{k}"]


def _residues(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The polynomials of words modulo a prime."""
    prime = np.uint64(_PRIMES[k][0])
    up, down = _prime_power(k, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    for a in range(0, len(values), _SUMMED):
        b = min(a + _SUMMED, len(values))
        np.multiply(values[a:b], up[a:b], out=total[a + 1 : b + 1])
        total[a + 1] += total[a] % prime
        np.cumsum(total[a + 1 : b + 1], out=total[a + 1 : b + 1])
    return (total[ends] % prime + prime - total[starts] % prime) % prime * down[starts] % prime


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; nulls are empty."""
    column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _piece(data: np.ndarray, breaks: np.ndarray, cut: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one piece; no word crosses a break. cut(data, starts, ends) may cut words in two."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    after[inner - 1] = True
    ends = np.flatnonzero(after & ~space) + 1
    if cut is not None:
        inside = cut(data, starts, ends)
        two = inside < ends
        at = np.arange(len(starts)) + np.cumsum(two) - two
        parts = np.zeros((2, len(starts) + int(two.sum())), np.int64)
        parts[0, at], parts[1, at] = starts, inside
        parts[0, at[two] + 1], parts[1, at[two] + 1] = inside[two], ends[two]
        starts, ends = parts
    values = _LOWER[data].astype(np.uint64) + np.uint64(1)
    primes = _residues(values, starts, ends, 0) | (_residues(values, starts, ends, 1) << np.uint64(32))
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.multiply(values, up[: len(data)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mix(h ^ mix(primes)), starts, ends


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows [a, b) with the bytes [p, q) to treat at once: whole rows up to BLOCK bytes, or a part of one long row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1
        if b > a:
            yield a, b, int(offsets[a]), int(offsets[b])
            a = b
            continue
        p, end = int(offsets[a]), int(offsets[a + 1])
        while p < end:
            q = min(p + BLOCK, end)
            if q < end:
                spaces = np.flatnonzero(_SPACE[data[p:q]])
                while not len(spaces) and q < end:
                    last, q = q, min(q + BLOCK, end)
                    spaces = np.flatnonzero(_SPACE[data[last:q]]) + (last - p)
                q = p + int(spaces[-1]) + 1 if len(spaces) and q < end else q
            yield a, a + 1, p, q
            p = q
        a += 1


def words(column: pa.Array, spans: bool = False, cut: Callable | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray] | tuple]:
    """For blocks of rows: first row, hashes of their words, and where each row's words begin (one entry more than rows).

    With spans, also the words' first byte and end in the row's own UTF-8 text. With cut, a function of a block's bytes and its words' starts and
    ends that gives a place in each word (or its end), words are cut there in two.
    """
    data, offsets = utf8(column)
    held: list[tuple] = []

    def joined(a: int) -> tuple:
        h, s, e = (np.concatenate([x[k] for x in held]) for k in range(3))
        held.clear()
        return (a, h, np.array([0, len(h)]), s, e) if spans else (a, h, np.array([0, len(h)]))

    row = 0
    for a, b, p, q in _pieces(data, offsets):
        h, s, e = _piece(data[p:q], offsets[a:b] - p if b > a + 1 or p == offsets[a] else np.zeros(0, np.int64), cut)
        if b == a + 1 and (p > offsets[a] or q < offsets[b]):
            held.append((h, s + (p - offsets[a]), e + (p - offsets[a])))
            if q == offsets[b]:
                yield joined(a)
        else:
            at = np.searchsorted(s, offsets[a : b + 1] - p)
            if spans:
                own = np.repeat(offsets[a:b] - p, np.diff(at))
                yield a, h, at, s - own, e - own
            else:
                yield a, h, at
        row = b
    for a in range(row, len(offsets) - 1):
        none = np.zeros(0, np.int64)
        yield (a, none.astype(np.uint64), np.array([0, 0]), none, none) if spans else (a, none.astype(np.uint64), np.array([0, 0]))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words that start at each word; the last size - 1 words start none."""
    n = len(h) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for j in range(size if n > 0 else 0):
        out = (out ^ h[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


def shingles(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's shingles, in text order with repeats, and where each row's begin.

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    n = np.diff(at)
    every = grams(h, size)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    index = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    out = np.zeros(to[-1], np.uint64)
    whole = np.repeat(n >= size, count)
    out[whole] = every[index[whole]]
    for k in range(1, size):
        if (rows := np.flatnonzero(n == k)).size:
            out[to[rows]] = grams(h, k)[at[rows]]
    return out, to
