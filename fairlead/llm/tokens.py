r"""Hashes of words and of word shingles over Arrow text columns, in numpy.

A word is a run of bytes that are no white space [\x20\x09-\x0D], with A-Z in
lower case. Texts are worked on in pieces that end between words, so memory
depends on the piece and not on the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KIND = np.zeros(256, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
for _n, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_c] = 1 << (4 + _n)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        full = np.full(max(n, PIECE), base, np.uint64)
        full[0] = 1
        _powers[base] = np.multiply.accumulate(full)
    return _powers[base][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches, rows: int = 1024):
    """The batches in parts, so that what is made of each stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pieces(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE):
    """(start, end) of pieces that end after white space or with a text."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + piece, n)
        if end < n:
            border = int(offsets[np.searchsorted(offsets, end)])
            while end < border:
                space = np.flatnonzero(_IS_SPACE[data[end : min(end + 4096, border)]])
                if len(space):
                    end += int(space[0]) + 1
                    break
                end = min(end + 4096, border)
        yield at, end
        at = end


def _piece_words(raw: np.ndarray, borders: np.ndarray, with_shapes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and shape (the kinds of bytes that occur, as bits) of each word."""
    inside = ~_IS_SPACE[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[borders] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[borders[borders > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[raw]] * _power(_BASE, len(raw)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, len(raw))[starts]
    # White space has no kind, so a word's bits end with it.
    shapes = np.bitwise_or.reduceat(_KIND[raw], starts) if with_shapes and len(starts) else np.zeros(0, np.uint64)
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, shapes


def words_of(column: pa.Array, with_shapes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of all words in order, and where each text's words begin (one more than texts)."""
    data, offsets = buffers(column)
    hashes, starts, shapes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, end in pieces(data, offsets):
        lo, hi = np.searchsorted(offsets, [at, end])
        borders = offsets[lo:hi] - at
        h, s, shape = _piece_words(data[at:end], borders, with_shapes)
        hashes.append(h)
        starts.append(s + at)
        shapes.append(shape)
    return np.concatenate(hashes), np.concatenate(shapes), np.searchsorted(np.concatenate(starts), offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin."""
    hashes, _, begins = words_of(column, with_shapes=False)
    return hashes, begins


def shingle_sets(column: pa.Array, k: int):
    """Per text the sorted distinct hashes of its k-word shingles; fewer words count as one shingle."""
    words, begins = word_hashes(column)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_INVERSE))
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * weights[j]
    rolled = mix(rolled)
    for b, e in zip(begins[:-1], begins[1:]):
        if e - b >= k:
            found = np.sort(rolled[b : e - k + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif e > b:
            yield mix(np.array([np.sum(words[b:e] * weights[: e - b]) + np.uint64(e - b)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def flag_words(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the 64-bit words that ``np.packbits`` would give for flags at these places."""
    places = np.unique(places)
    inside = places & np.uint64(7)
    byte = (places >> np.uint64(3)) & np.uint64(7)
    bits = (np.uint64(128) >> inside) << (byte << np.uint64(3))
    word = (places >> np.uint64(6)).astype(np.int64)
    if not len(word):
        return word, word
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    return word[starts], np.bitwise_or.reduceat(bits, starts).view(np.int64)


def window_hashes(data: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of the ``width`` bytes from every position that has as many."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(base, n), out=sums[1:])
    return mix((sums[width:] - sums[: n - width + 1]) * _power(pow(base, -1, 1 << 64), n)[: n - width + 1])


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per part."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
