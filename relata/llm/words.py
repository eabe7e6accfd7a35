"""Words of whole texts as arrays, straight from Arrow's UTF-8 buffers.

A word is a run of ASCII letters, ASCII digits and non-ASCII bytes; A-Z count
as a-z. As every byte of a non-ASCII character is 0x80 or more, this needs no
decoding. Each word becomes a 64-bit hash that depends on its bytes alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once; a longer word extends its piece.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=4)
def _place_keys(n: int, seed: int) -> np.ndarray:
    """An odd number for each place in a word, without any relation between places."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


def keyed_word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """Another hash of the words that begin at `starts`: bytes times keys of their places in the word, summed.

    Powers of one base have pairs of words that clash under every base; keys without relation have none.
    """
    out = np.zeros(len(starts), np.uint64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
        n, at = lengths[first:last], starts[first:last]
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(before, n)
        keys = _place_keys(1 << max(6, int(n.max() - 1).bit_length()), seed)
        with np.errstate(over="ignore"):
            parts = (LOWER[data[place + np.repeat(at, n)]].astype(np.uint64) + np.uint64(1)) * keys[place]
            out[first:last] = mix(np.add.reduceat(parts, before) + n.astype(np.uint64) * _BASE) | np.uint64(1)
        first = last
    return out


def _cut(data: np.ndarray, at: int) -> int:
    """The end of the piece that begins at `at`: between words, PIECE bytes on if words allow."""
    end = at + PIECE
    if end >= len(data):
        return len(data)
    gaps = np.flatnonzero(~IN_WORD[data[at:end]])
    if len(gaps):
        return at + int(gaps[-1]) + 1
    while end < len(data):
        gaps = np.flatnonzero(~IN_WORD[data[end : end + PIECE]])
        if len(gaps):
            return end + int(gaps[0])
        end += PIECE
    return len(data)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte length of each word, and n + 1 offsets of the texts' words."""
    hashes, lengths, bounds, _ = placed_word_hashes(data, offsets)
    return hashes, lengths, bounds


def placed_word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `word_hashes`, and where each word begins."""
    hashes, lengths, at = [], [], 0
    firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts_all = []
    while at < len(data):
        end = _cut(data, at)
        piece = data[at:end]
        inside = IN_WORD[piece]
        begins = np.zeros(len(piece) + 1, bool)
        begins[firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, end)] - at] = True
        begins[-1] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | begins[1:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | begins[1:-1]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        if len(starts):
            up, down = _powers(max(PIECE, len(piece)))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
            n = (stops - starts).astype(np.uint64)
            hashes.append(mix((total[stops] - total[starts]) * down[starts] + n * _BASE) | np.uint64(1))
            lengths.append(n.astype(np.int64))
            starts_all.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.concatenate(lengths), np.searchsorted(starts, offsets), starts


def text_offsets(column: pa.Array) -> np.ndarray:
    """n + 1 offsets of the texts in bytes, without a copy of the texts; nulls count as empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def slices(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Consecutive ranges of texts with about `size` bytes each, one text at least."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), n)
        out.append((at, end))
        at = end
    return out
