"""Words and word n-grams of whole Arrow text columns as 64-bit hashes, in numpy.

A text's bytes are read in place and hashed in pieces that fit the processor's cache, so the
memory beside a text is about that of its words' hashes, also for a very long text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# What runs on the executors travels with the job, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PIECE = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def lowered() -> np.ndarray:
    """Byte codes with A-Z as a-z."""
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    return codes


def spaced_words(lower: bool) -> np.ndarray:
    """Byte codes, 0 at white space: words are `[^\\x20\\x09-\\x0D]+`.

    A byte's code is one more than the byte, so a zero byte has a code of its own.
    """
    codes = (lowered() if lower else np.arange(256)).astype(np.uint16) + np.uint16(1)
    codes[[9, 10, 11, 12, 13, 32]] = 0
    return codes


def letters_and_digits() -> np.ndarray:
    """Byte codes, 0 at ASCII but a-z, A-Z (as a-z) and 0-9."""
    codes = lowered()
    other = np.ones(128, dtype=bool)
    other[48:58] = other[65:91] = other[97:123] = False
    codes[:128][other] = 0
    return codes


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a hash over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(of: int, n: int) -> np.ndarray:
    if of not in _powers or len(_powers[of]) < n:
        made = np.full(max(n, 2 * _PIECE), of, dtype=np.uint64)
        made[0] = 1
        _powers[of] = np.cumprod(made, dtype=np.uint64)
    return _powers[of][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end and where each begins, with the end; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def packed(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers that a binary column's values hold, end to end, copied once."""
    parts = [np.empty(0, kind)]
    for chunk in column.chunks:
        offset_kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        _, ends, data = chunk.buffers()
        if data is not None and len(chunk):
            offsets = np.frombuffer(ends, offset_kind)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind))
    return np.concatenate(parts)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22):
    """Batches cut so that a column's texts have about `size` bytes together."""
    for batch in batches:
        texts, done = batch.column(column), 0
        _, offsets = text_bytes(texts)
        while done < len(texts):
            upto = int(np.searchsorted(offsets, offsets[done] + size, "right")) - 1
            upto = min(max(upto, done + 1), len(texts))
            yield batch.slice(done, upto - done)
            done = upto


def _cut(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, end: int) -> int:
    """The first place from `end` on where no word is cut."""
    while end < len(data):
        after = offsets[np.searchsorted(offsets, end)] - end
        gaps = np.flatnonzero(codes[data[end : end + 4096]] == 0)
        stop = min(int(gaps[0]) if gaps.size else 4096, int(after))
        end += stop
        if stop < 4096:
            break
    return min(end, len(data))


def word_pieces(
    data: np.ndarray, offsets: np.ndarray, codes: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of all words with where they begin and end, piece by piece of the texts."""
    at = 0
    while at < len(data):
        end = _cut(data, offsets, codes, at + _PIECE)
        piece = codes[data[at:end]]
        word = piece != 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        low, high = np.searchsorted(offsets, [at, end], "right")
        begins = offsets[low:high] - at
        begins = begins[begins < end - at]
        first[begins] = word[begins]
        last[begins - 1] = word[begins - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * powers(_MULTIPLIER, len(piece)), out=sums[1:])
        made = (sums[stops] - sums[starts]) * powers(_INVERSE, len(piece))[starts]
        made += (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        yield mixed(made), starts + at, stops + at
        at = end


def words(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin, with the end."""
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for made, starts_, _ in word_pieces(data, offsets, codes):
        hashes.append(made)
        places.append(starts_)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, from every word that has n - 1 behind it in the array."""
    count = max(len(hashes) - n + 1, 0)
    made = np.zeros(count, np.uint64)
    for k in range(n if count else 0):
        made *= np.uint64(_MULTIPLIER)
        made += hashes[k : k + count]
    return mixed(made + np.uint64(n))


def starts(bounds: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the first `count` words have n words of their own text from there on."""
    own = np.repeat(bounds[1:], np.diff(bounds))[:count]
    return np.arange(count) + n <= own


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, sorted; the array itself is sorted on the way."""
    hashes.sort()
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    return hashes[first]


#: Keys that a task remembers as sent already, at most.
REMEMBERED = 1 << 22


def remember(seen: set, key) -> None:
    """Add a key to those a task has sent. A full set is emptied first: what is then sent again
    is a repeat, which the distinct behind it takes out."""
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(key)
