"""Distinct word n-grams of whole texts as 64-bit hashes, over the bytes of an Arrow column.

Words are runs without ASCII white space, A-Z is lower-cased.  Everything is
array arithmetic over blocks of bytes, so the cost of a text is that of its
bytes and not of its words as Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once; a block ends at a row's end, or inside a longer row.
BLOCK = 1 << 17
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(first: int, count: int) -> np.ndarray:
    """Fixed pseudo-random numbers, by place."""
    with np.errstate(over="ignore"):
        return mix((np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * _M)


def _byte_table() -> np.ndarray:
    table = _numbers(1 << 40, 256)
    table[65:91] = table[97:123]
    table[[32, 9, 10, 11, 12, 13]] = 0  # white space adds nothing to a word
    return table


_BYTES, _PLACES = _byte_table(), _numbers(0, 256)
_SPACE = _BYTES == 0


def _weights(place: np.ndarray) -> np.ndarray:
    if len(place) and place.max() >= len(_PLACES):
        with np.errstate(over="ignore"):
            return mix((place.astype(np.uint64) + np.uint64(1)) * _M)
    return _PLACES[place]


def _words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, number of words before each row) for bytes and the rows' offsets in them.

    A word's hash sums a number per byte times a number per place.
    """
    hashes, starts, carry = [], [], 0  # carry: bytes of an unfinished word before this block
    for lo in range(0, max(len(data), 1), BLOCK):
        part = data[lo : lo + BLOCK]
        if not len(part):
            break
        space = _SPACE[part]
        first = ~space
        first[1:] &= space[:-1]
        inner = rows[(rows >= lo) & (rows < lo + len(part))] - lo
        first[inner] = ~space[inner]
        if carry and not space[0] and not (len(inner) and inner[0] == 0):
            first[0] = False
        else:
            carry = 0
        at = np.flatnonzero(first)
        head = at[0] if len(at) else len(part)  # bytes before the first word that begins here
        begin = np.zeros(len(part), np.int64)
        begin[at] = at
        place = np.arange(len(part)) - np.maximum.accumulate(begin)
        place[:head] = np.arange(carry, carry + head) if carry else 0
        with np.errstate(over="ignore"):
            value = _BYTES[part] * _weights(place)
            if carry:
                hashes[-1][-1] += value[:head].sum(dtype=np.uint64)
            if len(at):
                hashes.append(np.add.reduceat(value, at))
                starts.append(at + lo)
        if space[-1]:
            carry = 0
        else:
            carry = len(part) - at[-1] if len(at) else carry + len(part)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
    return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(starts), rows)


def _sets(data: np.ndarray, rows: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's sorted distinct n-grams; rows are offsets in data, with one more for the end."""
    h, begin = _words(data, rows)
    count = np.diff(begin)
    size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    offsets = np.r_[0, np.cumsum(size)]
    long = np.flatnonzero(count >= words)
    flat = np.empty(offsets[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(long):
            n = len(h) - words + 1
            gram = h[:n] + np.uint64(words)
            for i in range(1, words):
                gram = gram * _M + h[i : i + n]
            gram = mix(gram)
            inside = np.zeros(len(h) + 1, np.int64)
            np.add.at(inside, begin[:-1][long], 1)
            np.add.at(inside, begin[:-1][long] + size[long], -1)
            target = np.zeros(offsets[-1] + 1, np.int64)
            np.add.at(target, offsets[:-1][long], 1)
            np.add.at(target, offsets[:-1][long] + size[long], -1)
            flat[np.cumsum(target[:-1]) > 0] = gram[np.cumsum(inside[:n]) > 0]
        for r in np.flatnonzero((count > 0) & (count < words)).tolist():
            k = int(count[r])
            whole = h[begin[r] : begin[r] + 1] + np.uint64(k)
            for i in range(1, k):
                whole = whole * _M + h[begin[r] + i]
            flat[offsets[r]] = mix(whole)[0]
    bounds = offsets.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[offsets[:-1][size > 0]] = True
    kept = np.r_[0, np.cumsum(new)]
    return flat[new], kept[offsets]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, the rows' offsets in them) for runs of rows of a string column; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, raw = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK, "right")) - 1)
        yield lo, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of every row of a string column, in order; row i has hashes[offsets[i] : offsets[i + 1]]."""
    hashes, offsets, n = [], [np.zeros(1, np.int64)], 0
    for _, data, rows in _blocks(texts):
        h, begin = _words(data, rows)
        hashes.append(h)
        offsets.append(begin[1:] + n)
        n += len(h)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(offsets)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) for runs of rows of a string column.

    hashes[offsets[i] : offsets[i + 1]] are the sorted distinct n-grams of row
    first + i.  With fewer words than an n-gram has, the whole sequence is the
    one element; null texts and texts without words have none.
    """
    for lo, data, rows in _blocks(texts):
        yield lo, *_sets(data, rows, words)
