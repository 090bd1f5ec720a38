"""Words of many texts at once, as 64-bit hashes in numpy. Used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_P, -1, 1 << 64)
#: bytes of text worked on at once; a longer single text is worked on alone
BATCH_BYTES = 2 << 20


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling; kept up to two batches."""
    known = _POWERS.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        factor = np.uint64(pow(base, done, 1 << 64))
        out[done : done + step] = out[:step] * factor
        done += step
    if n <= 2 * BATCH_BYTES:
        _POWERS[base] = out
    return out


def _letters() -> np.ndarray:
    """For each byte whether it belongs to a word: ASCII letters and digits, and all of UTF-8 beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = True
    return table


_WORD = _letters()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(texts: pa.Array, lower: bool = True, inside: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the first place of each text (one more than texts).

    Words are runs of letters and digits, in lower case, or of the bytes marked
    in ``inside``; null is empty. Two different words share a hash with
    probability about 2 ** -60.
    """
    if len(texts) == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string()) if texts.nbytes < (1 << 30) else texts
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = inside[data]
    # a word begins where a word byte follows none, or where a text begins
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    stops = ends[1:][ends[1:] > 0] - 1
    last[stops] = inside[stops]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # polynomial hash by a running sum: (S[end] - S[begin]) / P ** begin, all modulo 2 ** 64
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * _powers(_INVERSE, len(data))[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, ends).astype(np.int64)


def grams(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, text by text, and the first place of each text.

    A text of fewer than n words, but at least one, has one window: all its words.
    """
    counts = np.diff(starts)
    total = len(hashes)
    rolled = np.zeros(total, dtype=np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = starts[1:][owner] - np.arange(total)
    for k in range(n):
        shifted = np.zeros(total, dtype=np.uint64)
        if k < total:
            shifted[: total - k] = hashes[k:]
        shifted[left <= k] = 0
        rolled = rolled * np.uint64(_P) + shifted
    keep = (left >= n) | ((counts[owner] < n) & (np.arange(total) == starts[:-1][owner]))
    out = mix(rolled[keep])
    sizes = np.bincount(owner[keep], minlength=len(counts)) if total else np.zeros(len(counts), np.int64)
    return out, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def slices(batch: pa.RecordBatch, text: str):
    """Cut a batch into runs of rows of about ``BATCH_BYTES`` of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BATCH_BYTES:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < len(sizes):
        yield batch.slice(at, len(sizes) - at)
