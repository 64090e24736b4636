"""Word and shingle fingerprints of many texts at once, for use inside tasks."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes hashed in one go; a longer text is cut between words.
SLICE = 1 << 20
#: Texts are handled in runs of about this many bytes.
RUN_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all bits (the finaliser of a split-mix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_sets(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is part of a word, folded byte) per byte value.

    `blank`: words are runs without blanks and control breaks, case kept. `blank_fold`: the same with A-Z lowered.
    `letters`: words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lowered.
    """
    code = np.arange(256)
    keep = ~np.isin(code, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
    fold = code.copy()
    if kind != "blank":
        fold[65:91] += 32
    if kind == "letters":
        keep = (code >= 0x80) | ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    return keep, fold.astype(np.uint8)


def _slices(inside: np.ndarray) -> list[int]:
    """Bounds of slices that end between words."""
    bounds, n = [0], len(inside)
    while bounds[-1] < n:
        at = min(n, bounds[-1] + SLICE)
        while at < n and inside[at - 1]:
            gap = np.flatnonzero(~inside[at : at + 65536])
            at = at + int(gap[0]) + 1 if len(gap) else min(n, at + 65536)
        bounds.append(at)
    return bounds


def word_hashes(texts: list[bytes], kind: str = "blank") -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprint of every word of all texts, and the index of the first word of each text (and the end)."""
    keep, fold = byte_sets(kind)
    value = mix64(fold.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    value[~keep] = 0
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = keep[raw]
    base = np.uint64(0x9FB21C651E98DF25)
    power = np.ones(1, dtype=np.uint64)
    hashes, starts = [], []
    cuts = _slices(inside)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = inside[lo:hi]
        first = part.copy()
        first[1:] &= ~part[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            continue
        spans = np.diff(np.append(start, hi - lo))
        longest = int(spans.max())
        if longest > len(power):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(longest, base, dtype=np.uint64))))
        offset = np.arange(start[0], hi - lo) - np.repeat(start, spans)
        terms = value[raw[lo + start[0] : hi]] * power[offset]
        hashes.append(mix64(np.add.reduceat(terms, start - start[0])))
        starts.append(start + lo)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(begin), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every run of `width` words; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out + words[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix64(out)


def shingle_sets(texts: list[bytes], width: int, kind: str, whole: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingles per text. With `whole` a text of fewer words counts as one shingle."""
    words, at = word_hashes(texts, kind)
    every = grams(words, width)
    out = []
    for lo, hi in zip(at, at[1:], strict=False):
        n = hi - lo
        if n >= width:
            out.append(np.unique(every[lo : hi - width + 1]))
        elif n and whole:
            out.append(grams(words[lo:hi], int(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def runs(batches, column: str = "text", limit: int = RUN_BYTES):
    """(batch slice, texts as bytes with NULL as empty) over Arrow batches, in runs of bounded size."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            piece = texts.slice(lo, hi - lo).cast(pa.binary())
            yield batch.slice(lo, hi - lo), [t or b"" for t in piece.to_pylist()]
            lo = hi
