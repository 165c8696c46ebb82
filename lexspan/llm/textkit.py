"""Vectorised text primitives for the Arrow operators: batch iteration, byte hashing, GPT-2 style pre-tokens."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa

#: Characters that one vectorised step handles; bounds the memory of a Python worker (about 150 bytes a character).
STEP_CHARS = 400_000
#: Powers that a worker keeps; a step of one longer text makes its own.
KEPT_POWERS = 1 << 20

_U64 = np.uint64
T = TypeVar("T")
_P = _U64(0x9E3779B97F4A7C15)
_P_INV = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: White space as the tokenizer libraries' \s has it (Unicode White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, other, white space; built once per worker."""
    global _classes
    if _classes is None:
        import unicodedata

        kinds = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        out[WHITE_SPACE] = SPACE
        _classes = out
    return _classes


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches cut so that a step holds about STEP_CHARS characters (one text at least); null texts become ''."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > STEP_CHARS:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
    batch = texts = None
    give_back()


def give_back() -> None:
    """Return the memory that a task freed to the system: workers stay for tasks of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps what it freed
        pass


_held: dict[str, Any] = {}


def held(name: str, build: Callable[[], T]) -> T:
    """What a worker keeps between tasks, made when first asked for; the one thing of another name goes."""
    if name not in _held:
        _held.clear()
        _held[name] = build()
    return _held[name]


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """names, each with underscores at its end until no column of that name is there already."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U64(30))
    h = h * _U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U64(27))
    h = h * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


_powers = _inverse = np.ones(1, _U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n, at least, of the polynomial's base and of its inverse."""
    global _powers, _inverse
    if len(_powers) > n:
        return _powers, _inverse
    size = max(n, KEPT_POWERS)
    powers, inverse = (np.cumprod(np.concatenate([np.ones(1, _U64), np.full(size, x, _U64)])) for x in (_P, _P_INV))
    if n <= KEPT_POWERS:
        _powers, _inverse = powers, inverse
    return powers, inverse


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of data: a polynomial by prefix sums, then mixed with the length."""
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93)))


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and the bounds of each."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=bounds[1:])
    return np.frombuffer(b"".join(raw), np.uint8), bounds


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts as public_tokenizers.PATTERN does: (bytes, token starts, token ends, index of each token's text).

    The pattern's alternatives reduce to rules on runs of one class: a run of letters, numbers or other signs
    takes one blank before it; a run of white space gives all but its last sign as one token when something
    follows; an apostrophe at a token's start splits off an English ending.
    """
    data, bounds = encode(texts)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    n = int(lengths.sum())
    if not n:
        none = np.zeros(0, np.int64)
        return data, none, none, none
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)  # a text's first character; the place after the last counts as one
    first[np.cumsum(lengths) - lengths] = True
    first[n] = True
    white = kind == SPACE
    start = np.empty(n, bool)
    start[0] = True
    changes = kind[1:] != kind[:-1]
    blank_before = points[:-1] == 32
    last_of_run = np.zeros(n, bool)  # white space that something else follows in the same text
    last_of_run[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    start[1:] = np.where(white[1:], ~white[:-1] | last_of_run[1:], changes & ~blank_before)
    start |= first[:n]
    quotes = np.flatnonzero((points == 39) & start)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        cut = np.concatenate([first, np.ones(3, bool)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside = ~cut[quotes + 1]
        short = inside & np.isin(one, [115, 116, 109, 100])
        long = inside & ~cut[quotes + 2] & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for found, width in ((quotes[short], 2), (quotes[long], 3)):
            start[found + 1] = False
            after = found + width
            start[after[after < n]] = True
    at = np.flatnonzero(start)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    begin = offset[at]
    end = np.append(begin[1:], offset[n])
    owner = np.searchsorted(bounds[1:], begin, side="right")
    return data, begin, end, owner


class PairTable:
    """A hash table from 64-bit keys to 32-bit values in numpy arrays: vectorised lookup, open addressing."""

    def __init__(self, capacity: int = 1 << 12):
        self._make(capacity)

    def _make(self, capacity: int) -> None:
        self.size, self.mask = 0, capacity - 1
        self.keys, self.values = np.zeros(capacity, _U64), np.full(capacity, -1, np.int32)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        """The values of keys (0 is no key)."""
        out = np.full(len(keys), missing, np.int32)
        rest, slot = np.arange(len(keys)), (mix(keys) & _U64(self.mask)).astype(np.int64)
        while len(rest):
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            go = ~hit & (there != 0)
            rest, slot = rest[go], (slot[go] + 1) & self.mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not in the table."""
        if (self.size + len(keys)) * 2 > self.mask:
            used = self.keys != 0
            old, had = self.keys[used], self.values[used]
            self._make(1 << int(np.ceil(np.log2((self.size + len(keys)) * 4 + 16))))
            self._add(old, had)
        self._add(keys, values)

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.size += len(keys)
        rest, slot = np.arange(len(keys)), (mix(keys) & _U64(self.mask)).astype(np.int64)
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[rest[free]]
            won = self.keys[slot] == keys[rest]
            self.values[slot[won]] = values[rest[won]]
            rest, slot = rest[~won], (slot[~won] + 1) & self.mask


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1 for all i, end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift
