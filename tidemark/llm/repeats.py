"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of `LENGTH` bytes around it also starts in a document with a smaller id.

1. Documents are put into packs, written once, bucketed by pack, so that the later joins move only answers.
2. Every string (window) of LENGTH bytes is assigned to an anchor: the 16-byte gram in it with the smallest hash. Equal
   windows have equal anchors. Windows in a row with one anchor form a region. Packs ask which anchors occur elsewhere;
   an anchor of one document cannot repeat, and its windows are settled.
3. For the rest packs send each distinct region once, with its smallest document id, to the task of its anchor. Windows
   whose hash no other region of the task has are settled. The parts of regions that remain are dealt to shards; the
   transform of each shard is built, and the transforms are merged by refining their interleave symbol by symbol. A
   refinement also shows where common prefixes end; rows whose common prefix reaches LENGTH form the repeated intervals,
   and the smallest document of an interval is that of all its windows.
4. The packs get back, per region, the windows with a smaller document, and cut their texts.

An anchor of very many regions would bring them all to one task. Its windows get keys of their own instead. How many packs
have an anchor says little of that: a line that every pack has is one region in each.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import frozen_path, parts_for
from .words import mix64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 50
GRAM = 16
#: Bytes of text in a pack and in a bucket of packs; windows handled in one go.
PACK_BYTES, BUCKET_BYTES, WINDOWS = 4 << 20, 16 << 20, 1 << 17
#: Regions of an anchor, distinct ones of each pack, from which its windows get keys of their own: about 2 MB.
HOT = 1 << 15
#: Keys of a task are settled in so many goes.
GOES = 4
#: Bytes of regions whose transforms are merged in one go; the regions of one anchor stay together.
MERGED_BYTES = 2 << 20
SHARDS = 4
LOW32 = np.uint64((1 << 32) - 1)
SEVERAL = np.uint16(1 << 15)

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- regions of a pack ---------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every GRAM bytes, by doubling."""
    value = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))
    x, step, factor = value[raw], 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        x = x[:-step] * np.uint64(factor) + x[step:]
        factor, step = factor * factor % (1 << 64), step * 2
    return mix64(x)


def window_hashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the window at each place, from the grams that cover it."""
    out = grams[at]
    for k in (GRAM, 2 * GRAM, LENGTH - GRAM):
        out = (out * np.uint64(0xD6E8FEB86659FD93)) ^ (out >> np.uint64(29)) ^ grams[at + k]
    return mix64(out)


def window_runs(raw: np.ndarray, bounds: np.ndarray):
    """Regions of joined texts: (first window, last window, text, anchor hash, hash of the region) arrays.

    `bounds` are the offsets of the texts. The anchor is the leftmost of the smallest grams, compared by 32 bits of the
    hash; where two windows are equal, so are the places of their anchors.
    """
    out = []
    total = len(raw) - LENGTH + 1
    width = LENGTH - GRAM + 1
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for lo in range(0, max(0, total), WINDOWS):
        hi = min(total, lo + WINDOWS)
        hashes = gram_hashes(raw[lo : hi + LENGTH - 1])
        keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            keyed = np.minimum(keyed[:-reach], keyed[reach:])
            reach *= 2
        if reach < width:
            keyed = np.minimum(keyed[: len(keyed) - (width - reach)], keyed[width - reach :])
        at = (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = owner[lo:hi]
        # A window is inside a text if its first and its last byte are of the same one.
        valid = text == owner[lo + LENGTH - 1 : hi + LENGTH - 1]
        new = np.ones(hi - lo, dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
        stop = np.append(np.flatnonzero(new | ~valid), hi - lo)
        opens = valid[stop[:-1]] & new[stop[:-1]]
        first, last = stop[:-1][opens], stop[1:][opens] - 1
        if not len(first):
            continue
        # The windows at both ends cover a region, which is never longer than two windows.
        region = window_hashes(hashes, first) * np.uint64(0x9E3779B97F4A7C15) + window_hashes(hashes, last)
        region = mix64(region + (last - first).astype(np.uint64))
        out.append((first + lo, last + lo, text[first].astype(np.int64), hashes[at[first]], region))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def windows_of(raw: np.ndarray, runs):
    """The windows of the runs, each as a run of its own whose key is a hash of its bytes."""
    first, last, text = runs[:3]
    n = last - first + 1
    at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    key = np.zeros(len(at), dtype=np.uint64)
    for offset in range(0, LENGTH, 2):
        two = raw[at + offset].astype(np.uint64) * np.uint64(257) + raw[at + offset + 1]
        key = (key ^ two) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    key = mix64(key)
    return at, at, np.repeat(text, n), key, key


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def spread(hashes: np.ndarray) -> np.ndarray:
    """Hashes dealt evenly: an anchor is the smallest of its window, so the first bits of its own hash are mostly 0."""
    return mix64(hashes ^ np.uint64(0xA0761D6478BD642F))


def stretches(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return begin, np.append(begin[1:], len(sorted_values))


def pack_parts(row: dict):
    """Bytes, text bounds and ids of a pack; the windows of texts without an id are left out later."""
    raw = np.frombuffer(row["bytes"], dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.array(row["sizes"], dtype=np.int64))))
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], dtype=np.int64)
    known = np.array([i is not None for i in row["ids"]], dtype=bool)
    return raw, bounds, ids, known


def pack_anchors(runs, ids: np.ndarray, known: np.ndarray):
    """The distinct anchors of a pack in the order of their spread hashes.

    Returns these hashes; per anchor how many distinct regions it has, and SEVERAL with them if two documents have it;
    and per run the place of its anchor, -1 in a text without an id.
    """
    _, _, text, hashes, region = runs
    keep = np.flatnonzero(known[text])
    place = np.full(len(text), -1, dtype=np.int64)
    code = spread(hashes[keep])
    order = np.lexsort((region[keep], code))
    code, region, docs = code[order], region[keep][order], ids[text[keep]][order]
    begin, end = stretches(code)
    if not len(begin):
        return code, np.zeros(0, dtype=np.uint16), place
    place[keep[order]] = np.repeat(np.arange(len(begin)), end - begin)
    new = np.ones(len(code), dtype=np.int64)
    new[1:] = (code[1:] != code[:-1]) | (region[1:] != region[:-1])
    count = np.minimum(np.add.reduceat(new, begin), int(SEVERAL) - 1).astype(np.uint16)
    count[np.minimum.reduceat(docs, begin) != np.maximum.reduceat(docs, begin)] |= SEVERAL
    return code[begin], count, place


def asked(row: dict, parts: int):
    """The regions that a pack asks about.

    Returns its bytes, text bounds and ids; the first window, text and region number of every run; and per number the
    key, first window, last window, smallest and largest document. The same pack and answers always give
    the same numbers.
    """
    raw, bounds, ids, known = pack_parts(row)
    runs = window_runs(raw, bounds)
    code, _, place = pack_anchors(runs, ids, known)
    bounds_of = np.searchsorted(part_of(code, parts), np.arange(parts + 1))
    marks = {}
    for name in ("usual", "hot"):
        # The last one is for the runs without an anchor.
        marks[name] = np.zeros(len(code) + 1, dtype=bool)
        for a in row["shared"] or []:
            lo, hi = bounds_of[a["part"]], bounds_of[a["part"] + 1]
            marks[name][lo:hi] = np.unpackbits(np.frombuffer(a[name], dtype=np.uint8), count=hi - lo)
    usual, hot = marks["usual"][place], marks["hot"][place]
    kept = [x[usual] for x in runs]
    if hot.any():
        kept = [np.concatenate(pair) for pair in zip(kept, windows_of(raw, [x[hot] for x in runs]), strict=True)]
    first, last, text, key, region = kept
    both = mix64(key + np.uint64(1)) ^ region
    _, pick, number = np.unique(both, return_index=True, return_inverse=True)
    if len(pick):
        order = np.argsort(number, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(number))[:-1]))
        docs = ids[text][order]
        least, most = np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts)
    else:
        least = most = np.zeros(0, dtype=np.int64)
    return raw, bounds, ids, (first, text, number), (key[pick], first[pick], last[pick], least, most)


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[begin : begin + size] of all entries, joined."""
    return data[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]


# --- transforms ----------------------------------------------------------------------------------------------------


def shard_transform(strings: list[bytes], symbols_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform of a shard: (preceding symbol of every row, suffix of every row, suffix offset of every string).

    Two bytes make a symbol, so a string is two chains of symbols, from its even and its odd bytes; a suffix is a place
    in the string or one of two ends. Rows are all suffixes in order: by bytes, the end first, equal ones by place.
    Symbol 0 says that the suffix begins its chain.
    """
    size = np.array([len(s) for s in strings])
    base = np.concatenate(([0], np.cumsum(size + 2)))
    raw = np.frombuffer(b"".join(s + b"\0\0" for s in strings), dtype=np.uint8)
    n = len(raw)
    ends = np.zeros(n, dtype=bool)
    ends[base[1:] - 1] = ends[base[1:] - 2] = True
    left = np.repeat(base[1:] - 2, size + 2) - np.arange(n)
    # Prefix doubling from eight bytes on; bytes behind the end count as 0 and the shorter suffix comes first.
    padded = np.append(raw, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    word = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | np.where(left > k, padded[k : n + k], 0)
    order = np.lexsort((np.minimum(left, 8), word))
    rank = np.zeros(n, dtype=np.int64)
    step, longest = 8, int(size.max())
    change = (word[order[1:]] != word[order[:-1]]) | (np.minimum(left, 8)[order[1:]] != np.minimum(left, 8)[order[:-1]])
    rank[order] = np.concatenate(([0], np.cumsum(change)))
    while step < longest and rank[order[-1]] < n - 1:
        nxt = np.where(left > step, rank[np.minimum(np.arange(n) + step, n - 1)] + 1, 0)
        both = rank * np.int64(n + 2) + nxt
        order = np.argsort(both, kind="stable")
        rank[order] = np.concatenate(([0], np.cumsum(both[order[1:]] != both[order[:-1]])))
        step *= 2
    # Terminators stand first and in the order of their places.
    marks = np.flatnonzero(ends)
    suffix = np.concatenate((marks, order[~ends[order]]))
    before = np.zeros(n, dtype=np.uint32)
    symbol = symbols_of(raw, padded, left)
    begins = np.zeros(n, dtype=bool)
    begins[base[:-1]] = begins[base[:-1] + 1] = True
    at = np.arange(n)
    before[~begins] = symbol[at[~begins] - 2]
    return before[suffix], suffix, base


def two_byte_symbols(raw, padded, left) -> np.ndarray:
    """Number of the two bytes at every place, from 1."""
    second = np.where(left > 1, padded[1 : len(raw) + 1], 0)
    return (raw.astype(np.uint32) * 256 + second.astype(np.uint32) + 1).astype(np.uint32)


def back_steps(before: np.ndarray, chains: int) -> np.ndarray:
    """Row of the suffix that is one symbol longer, for every row whose suffix does not begin its chain."""
    out = np.full(len(before), -1, dtype=np.int64)
    inner = np.flatnonzero(before)
    out[inner[np.argsort(before[inner], kind="stable")]] = np.arange(chains, len(before))
    return out


def merge_transforms(transforms: list[np.ndarray], chains: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms by refining their interleave `depth` times.

    Returns the rows of all transforms (numbered through) in merged order, and for each whether its suffix differs from
    the row before within `depth` symbols. Each step deals the rows, in the order so far, by their preceding symbol:
    that orders all suffixes by one symbol more. Two neighbours differ if their symbols do, or if a difference lies
    between the rows they came from. Rows of one transform keep their order, so no suffix is sorted again.
    """
    sizes = np.array([len(t) for t in transforms])
    offset = np.cumsum(sizes) - sizes
    before = np.concatenate(transforms)
    # Symbols in few bits are dealt by counting.
    used = np.unique(before)
    before = np.searchsorted(used, before).astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
    step = np.concatenate([back_steps(t, c) + o for t, c, o in zip(transforms, chains, offset, strict=True)])
    ends = np.concatenate([np.arange(c) + o for c, o in zip(chains, offset, strict=True)])
    rows = np.concatenate((ends, *[np.arange(c, len(t)) + o for t, c, o in zip(transforms, chains, offset, strict=True)]))
    differs = np.zeros(len(rows), dtype=bool)
    differs[0] = True
    for _ in range(depth):
        symbols = before[rows]
        inner = np.flatnonzero(symbols)
        symbols = symbols[inner]
        order = np.argsort(symbols, kind="stable")
        classes = np.cumsum(differs)[inner][order]
        symbols = symbols[order]
        rows = np.concatenate((ends, step[rows[inner[order]]]))
        apart = np.ones(len(order), dtype=bool)
        apart[1:] = (symbols[1:] != symbols[:-1]) | (classes[1:] != classes[:-1])
        differs[len(ends) :] = apart
    return rows, differs


def least_documents(strings: list[bytes], docs: np.ndarray, shards: int = SHARDS) -> list[np.ndarray]:
    """For every string, the smallest document that has each of its windows, from the repeated intervals."""
    shards = max(1, min(shards, len(strings)))
    transforms, chains, place, owner = [], [], [], []
    for k in range(shards):
        own = np.arange(k, len(strings), shards)
        before, suffix, base = shard_transform([strings[i] for i in own], two_byte_symbols)
        text = np.searchsorted(base, suffix, side="right") - 1
        transforms.append(before)
        chains.append(2 * len(own))
        owner.append(own[text])
        place.append(suffix - base[text])
    rows, differs = merge_transforms(transforms, chains, LENGTH // 2)
    owner, place = np.concatenate(owner)[rows], np.concatenate(place)[rows]
    size = np.array([len(s) for s in strings])
    window = place + LENGTH <= size[owner]
    begin = np.flatnonzero(differs)
    value = np.where(window, docs[owner], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(value, begin), np.diff(np.append(begin, len(rows))))
    counts = size - LENGTH + 1
    flat = np.zeros(counts.sum(), dtype=np.int64)
    starts = np.cumsum(counts) - counts
    flat[starts[owner[window]] + place[window]] = least[window]
    return np.split(flat, starts[1:])


def settle(data: np.ndarray, begin: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Smallest document of every window of the regions data[begin : begin + size], region after region."""
    counts = size - LENGTH + 1
    raw = gathered(data, begin, size)
    owner = np.repeat(np.arange(len(size)), counts)
    at = np.arange(counts.sum()) + np.repeat((np.cumsum(size) - size) - (np.cumsum(counts) - counts), counts)
    flat = docs[owner]
    hashes = window_hashes(gram_hashes(raw), at)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if twice.any():
        edge = twice.copy()
        edge[1:] &= ~twice[:-1] | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge)
        ends = np.append(np.flatnonzero(edge | ~twice), len(at))
        last = ends[np.searchsorted(ends, first, side="right")] - 1
        joined = raw.tobytes()
        strings = [joined[a : b + LENGTH] for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)]
        flat[twice] = np.concatenate(least_documents(strings, docs[owner[first]]))
    return flat


# --- tasks ---------------------------------------------------------------------------------------------------------


def bucket_of(pack: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark's writer gives to each number, by its 32-bit Murmur hash."""
    turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    h = np.full(len(pack), 42, dtype=np.uint32)
    for half in (pack & 0xFFFFFFFF, pack >> 32):
        k = turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return np.mod(h.view(np.int32).astype(np.int64), buckets)


def _packs(buckets: int, tasks: int):
    """Packs of about PACK_BYTES; a longer text is a pack of its own.

    A task fills one bucket after the other, so that the texts need no shuffle before they are written; the number of a
    pack is the next one of the task that the writer puts into the bucket at hand. Numbers follow from the task and the
    order of its rows, so a task that runs again makes the same packs.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def packed(pack, held):
        texts = [t for _, t in held]
        columns = [[pack], [[i for i, _ in held]], [[len(t) for t in texts]], [b"".join(texts)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pack", "ids", "sizes", "bytes"])

    def number(least: int, bucket: int) -> int:
        while True:
            found = np.flatnonzero(bucket_of(np.arange(least, least + 2 * buckets, dtype=np.int64), buckets) == bucket)
            if len(found):
                return least + int(found[0])
            least += 2 * buckets

    def run(batches):
        task = TaskContext.get().partitionId()
        held, size, done, pack = [], 0, 0, (task << 32) - 1
        bucket = lambda: (task * buckets // tasks + done // BUCKET_BYTES) % buckets
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").encode("utf-8", "surrogatepass")
                if held and size + len(text) > PACK_BYTES:
                    yield packed(pack := number(pack + 1, bucket()), held)
                    held, size, done = [], 0, done + size
                held.append((doc_id, text))
                size += len(text)
        if held:
            yield packed(number(pack + 1, bucket()), held)

    return run


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _anchors(parts: int):
    """(part, pack, hashes, counts): the distinct anchors of a pack, by four bytes that tell them apart inside a part."""
    import pyarrow as pa

    def run(batches):
        for row in _rows(batches):
            raw, bounds, ids, known = pack_parts(row)
            code, count, _ = pack_anchors(window_runs(raw, bounds), ids, known)
            if not len(code):
                continue
            part, low = part_of(code, parts), (code & LOW32).astype("<u4")
            begin, end = stretches(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[begin], pa.int32()), pa.array([row["pack"]] * len(begin), pa.int64()),
                    pa.array([low[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
                    pa.array([count[a:b].astype("<u2").tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
                ],
                names=["part", "pack", "hashes", "counts"],
            )

    return run


def _shared(frame):
    """(pack, part, usual, hot): a bit for each anchor that a pack has sent, set if it occurs in a second document."""
    import pandas as pd

    sizes = frame["hashes"].map(len).to_numpy() // 4
    every = np.frombuffer(b"".join(frame["hashes"]), dtype="<u4")
    counts = np.frombuffer(b"".join(frame["counts"]), dtype="<u2")
    order = np.argsort(every, kind="stable")
    begin, end = stretches(every[order])
    counts = counts[order]
    regions = np.add.reduceat((counts & ~SEVERAL).astype(np.int64), begin)
    shared = (end - begin > 1) | (np.maximum.reduceat(counts, begin) >= SEVERAL)
    usual, hot = np.zeros(len(every), dtype=bool), np.zeros(len(every), dtype=bool)
    usual[order] = np.repeat(shared & (regions < HOT), end - begin)
    hot[order] = np.repeat(shared & (regions >= HOT), end - begin)
    ends = np.cumsum(sizes)
    rows = []
    for pack, part, a, b in zip(frame["pack"], frame["part"], ends - sizes, ends, strict=True):
        if usual[a:b].any() or hot[a:b].any():
            rows.append((int(pack), int(part), np.packbits(usual[a:b]).tobytes(), np.packbits(hot[a:b]).tobytes()))
    return pd.DataFrame(rows, columns=["pack", "part", "usual", "hot"])


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(blob, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


#: What a pack says of a region in front of its bytes: four bytes of the key, which tell the keys of a task apart.
ASKED = (("key", "<u4"), ("number", "<i4"), ("size", "u1"), ("least", "<i8"), ("more", "<i8"))


def _asks(parts: int):
    """(part, pack, n, size, asks): the distinct shared regions of a pack, compressed, with number, least and most document."""
    import pyarrow as pa

    def run(batches):
        for row in _rows(batches):
            raw, _, _, _, (key, first, last, least, most) = asked(row, parts)
            key = spread(key)
            part = part_of(key, parts)
            order = np.argsort(part, kind="stable")
            begin, end = stretches(part[order])
            sizes, blobs = [], []
            for a, b in zip(begin, end, strict=True):
                own = order[a:b]
                size = last[own] - first[own] + LENGTH
                # The span of the documents may be beyond 63 bits, but it wraps back.
                column = {"key": key[own] & LOW32, "number": own, "size": size, "least": least[own], "more": most[own] - least[own]}
                blob = b"".join([*(planes(column[n].astype(k)) for n, k in ASKED), gathered(raw, first[own], size).tobytes()])
                sizes.append(len(blob))
                blobs.append(pa.compress(blob, codec="zstd", asbytes=True))
            columns = [part[order][begin], [row["pack"]] * len(begin), end - begin, sizes, blobs]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in ASK.split(", ")])

    return run


ASK = "part int, pack long, n int, size long, asks binary"
SEGMENT = np.dtype([("number", "<i4"), ("lo", "<u2"), ("hi", "<u2"), ("least", "<i8")])


def region_codes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every region data[begin : end], from the eight-byte words at both ends."""
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    # Mixed, since a length that meets the first word as it is makes up for another first byte in a text with a period.
    out = mix64((end - begin).astype(np.uint64))
    # Six words reach 48 bytes from either end; no region has more than 2 * LENGTH - GRAM bytes.
    for k in range(6):
        for at in (begin + 8 * k, end - 8 * (k + 1)):
            out = (out ^ words[at]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return mix64(out)


def _settled(table):
    """(pack, segments): runs of windows of a region with the smallest document that has them."""
    import pyarrow as pa

    found = {n: [] for n, _ in ASKED} | {"pack": [], "data": []}
    for pack, n, size, asks in zip(*(table[c].to_pylist() for c in ("pack", "n", "size", "asks")), strict=True):
        blob, at = pa.decompress(asks, decompressed_size=size, codec="zstd", asbytes=True), 0
        for name, kind in ASKED:
            upto = at + n * np.dtype(kind).itemsize
            found[name].append(from_planes(blob[at:upto], kind))
            at = upto
        found["data"].append(np.frombuffer(blob, dtype=np.uint8)[at:])
        found["pack"].append(np.full(n, pack, dtype=np.int64))
    column = {n: np.concatenate(found.pop(n)) for n in list(found)}
    data, size = column.pop("data"), column.pop("size").astype(np.int64)
    column["most"] = column["least"] + column.pop("more")
    begin = np.cumsum(size) - size
    out, packs = [], []
    for go in range(GOES):
        own = np.flatnonzero(column["key"] % GOES == go)
        if len(own):
            got = settled_asks({n: x[own] for n, x in column.items()}, data, begin[own], size[own])
            out.append(got[0])
            packs.append(got[1])
    out, packs = np.concatenate(out), np.concatenate(packs)
    order = np.argsort(packs, kind="stable")
    out, packs = out[order], packs[order]
    begin, end = stretches(packs)
    blobs = [out[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
    return pa.table({"pack": pa.array(packs[begin], pa.int64()), "segments": pa.array(blobs, pa.binary())})


def settled_asks(column: dict, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and their packs of the regions data[begin : begin + size], all that there are of their keys."""
    code = region_codes(data, begin, begin + size)
    order = np.lexsort((code, column["key"]))
    key, code = column["key"][order], code[order]
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new = new_key.copy()
    new[1:] |= code[1:] != code[:-1]
    first = np.flatnonzero(new)
    docs = np.minimum.reduceat(column["least"][order], first)
    begin, size = begin[order[first]], size[order[first]]
    counts = size - LENGTH + 1
    base = np.cumsum(counts) - counts
    # The only region of an anchor is a repeated interval as a whole.
    flat = np.repeat(docs, counts)
    group = np.cumsum(new_key)[first]
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    at, upto = 0, np.cumsum(size[many])
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MERGED_BYTES)))
        while end < len(many) and group[many[end]] == group[many[end - 1]]:
            end += 1
        own = many[at:end]
        where = np.arange(counts[own].sum()) + np.repeat(base[own] - (np.cumsum(counts[own]) - counts[own]), counts[own])
        flat[where] = settle(data, begin[own], size[own], docs[own])
        at = end
    starts = np.zeros(len(flat), dtype=bool)
    starts[base] = True
    starts[1:] |= flat[1:] != flat[:-1]
    cut = np.flatnonzero(starts)
    of = np.searchsorted(base, cut, side="right") - 1
    low, high, value = cut - base[of], np.append(cut[1:], len(flat)) - 1 - base[of], flat[cut]
    begins = np.searchsorted(of, np.arange(len(first)))
    pieces = np.bincount(of, minlength=len(first))
    ask = np.cumsum(new) - 1
    n = pieces[ask]
    row = np.repeat(order, n)
    seg = np.arange(n.sum()) + np.repeat(begins[ask] - (np.cumsum(n) - n), n)
    useful = value[seg] < column["most"][row]
    row, seg = row[useful], seg[useful]
    out = np.zeros(len(row), dtype=SEGMENT)
    out["number"], out["lo"], out["hi"], out["least"] = column["number"][row], low[seg], high[seg], value[seg]
    return out, column["pack"][row]


def cut_texts(row: dict, parts: int):
    """(id, bytes, removed, spans, kept bytes) of every text of a pack."""
    found = b"".join(row["found"] or [])
    if found:
        raw, bounds, ids, (first, text, number), _ = asked(row, parts)
        segments = np.frombuffer(found, dtype=SEGMENT)
        segments = segments[np.argsort(segments["number"], kind="stable")]
        lo = np.searchsorted(segments["number"], number)
        n = np.searchsorted(segments["number"], number, side="right") - lo
        run = np.repeat(np.arange(len(number)), n)
        seg = segments[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]
        gone = seg["least"] < ids[text[run]]
        begin = first[run][gone] + seg["lo"][gone]
        end = first[run][gone] + seg["hi"][gone] + LENGTH
        cover = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(end, minlength=len(raw) + 1)
        removed = np.cumsum(cover[:-1]) > 0
    else:
        raw, bounds, _, _ = pack_parts(row)
        removed = np.zeros(len(raw), dtype=bool)
    for k, doc_id in enumerate(row["ids"]):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        mask = removed[lo:hi]
        spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
        yield doc_id, hi - lo, int(mask.sum()), spans, raw[lo:hi][~mask].tobytes()


def _cut(parts: int):
    import hashlib

    import pyarrow as pa

    def run(batches):
        for row in _rows(batches):
            rows = [(i, n, m, s, hashlib.sha256(kept).hexdigest()) for i, n, m, s, kept in cut_texts(row, parts)]
            kinds = [pa.int64()] * 4 + [pa.string()]
            names = [n.split()[0] for n in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Texts are UTF-8 bytes, NULL as empty; strings do not cross documents and are judged on the input. Rows with the same
    doc_id do not remove each other's strings. A NULL doc_id is smaller than none and loses nothing. Texts shorter than
    LENGTH stay whole. The documents are read as they lie in their table; freeze a frame that a shuffle made first.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(100_000, parts_for(total, BUCKET_BYTES, 6))
    parts = parts_for(total, BUCKET_BYTES, 6)
    name = f"packs_{uuid.uuid4().hex}"
    packed = _packs(buckets, max(1, slim.rdd.getNumPartitions()))
    packs = slim.mapInArrow(packed, "pack long, ids array<long>, sizes array<long>, bytes binary")
    packs.write.bucketBy(buckets, "pack").option("compression", "zstd").option("path", frozen_path(spark)).saveAsTable(name)
    packs = spark.table(name)

    anchors = packs.mapInArrow(_anchors(parts), "part int, pack long, hashes binary, counts binary")
    shared = anchors.groupBy("part").applyInPandas(_shared, "pack long, part int, usual binary, hot binary")
    path = frozen_path(spark)
    shared.write.parquet(path)
    shared = spark.read.schema(shared.schema).parquet(path)
    answers = shared.groupBy("pack").agg(F.collect_list(F.struct("part", "usual", "hot")).alias("shared"))
    known = packs.join(answers, "pack", "left").select("pack", "ids", "sizes", "bytes", "shared")

    asks = known.where("shared is not null").mapInArrow(_asks(parts), ASK)
    settled = asks.groupBy("part").applyInArrow(_settled, "pack long, segments binary")
    path = frozen_path(spark)
    settled.write.parquet(path)
    settled = spark.read.schema(settled.schema).parquet(path)
    found = settled.groupBy("pack").agg(F.collect_list("segments").alias("found"))
    return known.join(found, "pack", "left").mapInArrow(_cut(parts), OUT)
