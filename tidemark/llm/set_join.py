"""Similarity join of word shingle sets by T-occurrence search (DivideSkip).

1. Every text becomes the set of its distinct word shingles; texts with equal sets are one node from here on.
2. Routing. Two linked sets differ in at most `slack` shingles. A set is dealt into `slack + 1` or more parts by the
   hash of its shingles, so that at least one part must be equal on both sides; equal parts meet by their hash. What
   meets is only kept if the histograms of both sets are near enough, which a link implies. No link is lost here. Nodes
   that meet, directly or over others, form a bundle.
3. Search. The sets of a bundle get an inverted list per shingle. Each set asks which sets occur on T of its lists: its
   short lists are merged, the few that occur on T less the number of long lists are looked up in the long lists by
   binary search, and those that reach the required overlap are links. A bundle too large for a task is cut into blocks, a
   task per pair of blocks, and every set asks every block.
4. A task returns how many documents each set is linked with and a spanning forest of its links; the components of all
   forests are the classes.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, rows_with_bit
from .components import components
from .frames import freeze, parts_for
from .near_dedup import set_key
from .words import mix64, runs, shingle_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members of a meeting above which they form a bundle without a look at their histograms.
MEETING_ROWS = 4_000
#: Shingles and sets that one block of a bundle may hold; sets count since every set asks every block.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 500
#: Bins of a histogram.
BINS = 32
#: Cost of a binary search step against that of a merged list entry; more means fewer long lists.
STEP = 1.0

SKETCH = "doc_id long, mark long, n_shingles long, node long, bins binary, keys array<long>"


def size_classes(largest: int, part: int, whole: int) -> list[int]:
    """Upper bounds of the size classes, each at most 1.5 times the last and wide enough to hold a neighbour's partners."""
    bounds = [max(1, slack_free(part, whole))]
    while bounds[-1] < largest:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2, bounds[-1] * whole // part + 1))
    return bounds


def slack(size: int, part: int, whole: int) -> int:
    """Most shingles in which two linked sets of at most this size differ.

    The overlap o of linked sets reaches part * (a + b) / (part + whole), so a + b - 2 o is at most
    (a + b) * (whole - part) / (whole + part).
    """
    return 2 * size * (whole - part) // (whole + part)


def slack_free(part: int, whole: int) -> int:
    """Largest size at which linked sets must be equal."""
    n = 0
    while n < 10_000 and slack(n + 1, part, whole) == 0:
        n += 1
    return n


def parts_of(bound: int, part: int, whole: int) -> tuple[int, int]:
    """(parts, spare) of a size class: spare parts beyond the slack and one, so that few sets need their empty parts."""
    least = slack(bound, part, whole) + 1
    spare = 1 + least // 32
    return least + spare, spare


def meeting_keys(sets: list[np.ndarray], part: int, whole: int) -> list[np.ndarray]:
    """Hashes of the parts of every set.

    Of `least + spare` parts at least `1 + spare` are equal between linked sets. If one of them has no more than
    `spare` empty parts, some equal part is not empty; only sets with more empty parts hand in those too. A set takes
    part in its own size class and, if a partner can be there, in the next one; the pair meets in that of the larger.
    """
    out: list[list[np.ndarray]] = [[] for _ in sets]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not len(sizes) or not sizes.max():
        return [np.zeros(0, dtype=np.uint64) for _ in sets]
    free = slack_free(part, whole)
    bounds = np.array(size_classes(int(sizes.max() * whole // part) + 1, part, whole), dtype=np.int64)
    own = np.searchsorted(bounds, sizes)
    for level in (0, 1):
        # a set of `free` shingles or fewer is linked with equal sets only, unless a larger one can be its partner
        takes = (sizes * whole // part > bounds[own]) if level else (sizes > free)
        for k in np.unique((own + level)[takes]):
            rows = np.flatnonzero(takes & (own + level == k))
            count, spare = parts_of(int(bounds[k]), part, whole)
            every = np.concatenate([sets[r] for r in rows])
            place = np.repeat(np.arange(len(rows)) * count, sizes[rows]) + (mix64(every) % np.uint64(count)).astype(np.int64)
            cells = len(rows) * count
            # 64-bit sums from two exact sums of 32-bit halves
            low = np.bincount(place, weights=(every & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=cells)
            high = np.bincount(place, weights=(every >> np.uint64(32)).astype(np.float64), minlength=cells)
            total = low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))
            filled = np.bincount(place, minlength=cells)
            salt = np.tile(np.arange(count, dtype=np.uint64), len(rows)) + np.uint64(int(k) << 40)
            keys = mix64(total ^ mix64(salt + np.uint64(0x9E3779B97F4A7C15)) ^ (filled.astype(np.uint64) << np.uint64(48)))
            keys, filled = keys.reshape(len(rows), count), filled.reshape(len(rows), count)
            all_in = (filled == 0).sum(axis=1) > spare
            for i, r in enumerate(rows):
                out[r].append(keys[i] if all_in[i] else keys[i][filled[i] > 0])
    return [np.concatenate(k) if k else np.zeros(0, dtype=np.uint64) for k in out]


def histogram(shingles: np.ndarray) -> np.ndarray:
    """Shingles per bin, cut off at what 16 bits hold; sets that differ in d shingles differ by at most d here."""
    bins = (mix64(shingles ^ np.uint64(0xA5A5A5A5)) % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(bins, minlength=BINS), 65535).astype(np.uint16)


def _sketch(width: int, part: int, whole: int):
    import pyarrow as pa

    def run(batches):
        for batch, texts in runs(batches):
            sets = shingle_sets(texts, width, "blank_fold")
            keys = meeting_keys(sets, part, whole)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([histogram(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())),
                ],
                names=["doc_id", "mark", "n_shingles", "node", "bins", "keys"],
            )

    return run


def _meet(part: int, whole: int):
    """Per meeting, stars of the nodes whose histograms allow a link."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "node"], kind="stable")
        key, node = frame["key"].to_numpy(), frame["node"].to_numpy()
        bins = np.frombuffer(b"".join(frame["bins"]), dtype=np.uint16).reshape(len(frame), BINS).astype(np.int32)
        size = frame["n"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        a, b = [], []
        for lo, hi in zip(first, np.append(first[1:], len(key)), strict=True):
            rest = np.arange(lo + 1, hi)
            queue = [lo]
            while len(rest):
                if not queue:
                    queue, rest = [rest[0]], rest[1:]
                    continue
                x = queue.pop()
                apart = np.abs(bins[rest] - bins[x]).sum(axis=1)
                near = apart * (whole + part) <= (size[rest] + size[x]) * (whole - part)
                found, rest = rest[near], rest[~near]
                a.extend([node[x]] * len(found))
                b.extend(node[found])
                queue.extend(found)
        out = np.unique(np.array([a, b], dtype=np.int64).T.reshape(-1, 2), axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return run


class Lists:
    """Inverted lists of some sets: per shingle the sets that hold it, by ascending size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        assert (np.diff(self.sizes) >= 0).all()
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int64), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.sets = every[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        self.shingles, self.starts = every[first], np.append(first, len(every))
        # one ascending key per entry: number of the list, then the set
        number = np.repeat(np.arange(len(first), dtype=np.int64), np.diff(self.starts))
        self.entries = number * len(sets) + self.sets

    def lists_of(self, shingles: np.ndarray) -> np.ndarray:
        """Numbers of the lists of those shingles that have one."""
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return at[self.shingles[at] == shingles]

    def search(self, shingles: np.ndarray, part: int, whole: int, after: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Sets beyond number `after` that are linked with the asked one, and their overlaps."""
        none = np.zeros(0, dtype=np.int64)
        n = len(shingles)
        # a link needs this overlap with any set, since the union holds at least the n asked shingles
        least = -(-n * part // whole)
        lists = self.lists_of(shingles)
        lo = max(after + 1, int(np.searchsorted(self.sizes, least)))
        hi = int(np.searchsorted(self.sizes, n * whole // part, side="right"))
        if len(lists) < least or lo >= hi:
            return none, none
        # the entries of sets of a fitting size are one run of each list
        total = len(self.sizes)
        begin = np.searchsorted(self.entries, lists * total + lo)
        end = np.searchsorted(self.entries, lists * total + hi)
        order = np.argsort(end - begin, kind="stable")
        begin, end, lists = begin[order], end[order], lists[order]
        longest = int(end[-1] - begin[-1])
        if not longest:
            return none, none
        long = min(least - 1, int(least / (STEP * np.log2(longest + 1) + 1)))
        short = len(lists) - long
        spans = end[:short] - begin[:short]
        ends = np.cumsum(spans)
        if not ends[-1]:
            return none, none
        merged = self.sets[np.arange(ends[-1]) + np.repeat(begin[:short] - (ends - spans), spans)]
        # a stable sort merges runs that ascend already
        merged = np.sort(merged, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, common = merged[start], np.diff(np.append(start, len(merged)))
        needed = np.maximum(least, -(-part * (n + self.sizes[found]) // (part + whole)))
        for k in range(short, len(lists), 16):
            stay = common + (len(lists) - k) >= needed
            found, common, needed = found[stay], common[stay], needed[stay]
            if not len(found):
                return none, none
            asked = lists[k : k + 16, None] * total + found[None, :]
            at = np.minimum(np.searchsorted(self.entries, asked), len(self.entries) - 1)
            common = common + (self.entries[at] == asked).sum(axis=0)
        stay = whole * common >= part * (n + self.sizes[found] - common)
        return found[stay], common[stay]


def links_within(sets: list[np.ndarray], weight: np.ndarray, left: np.ndarray, right: np.ndarray, part: int, whole: int):
    """(linked weight per set, forest) of the links between the sets flagged left and those flagged right.

    Sets flagged both ways meet each other once. Sets come by ascending size.
    """
    index = np.flatnonzero(left)
    lists = Lists([sets[i] for i in index])
    total, label = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
    forest = []
    for x in np.flatnonzero(right):
        after = int(np.searchsorted(index, x)) if left[x] else -1
        found, _ = lists.search(sets[x], part, whole, after)
        if not len(found):
            continue
        linked = index[found]
        total[x] += weight[linked].sum()
        total[linked] += weight[x]
        groups, at = np.unique(label[linked], return_index=True)
        other = groups != label[x]
        if other.any():
            forest.extend((x, int(y)) for y in linked[at[other]])
            label[np.isin(label, groups[other])] = label[x]
    return total, forest


def _links(part: int, whole: int):
    """Rows (node, NULL, linked documents) and (node, other node, 0) of every (bundle, i, j)."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["root", "i", "j", "n", "node"], kind="stable")
        key = frame[["root", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        nodes, blobs = frame["node"].to_numpy(), frame["shingles"].to_numpy()
        block, copies = frame["own"].to_numpy(), frame["copies"].to_numpy()
        a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(first, np.append(first[1:], len(frame)), strict=True):
            keep = lo + np.flatnonzero(np.concatenate(([True], nodes[lo + 1 : hi] != nodes[lo : hi - 1])))
            i, j = key[lo, 1], key[lo, 2]
            if len(keep) < 2:
                continue
            sets = [np.frombuffer(blobs[r], dtype=np.uint64) for r in keep]
            left, right = block[keep] == i, block[keep] == j
            if not left.any() or not right.any():
                continue
            total, forest = links_within(sets, copies[keep], left, right, part, whole)
            some = np.flatnonzero(total)
            a.append(nodes[keep[some]])
            b.append(np.full(len(some), -1))
            n.append(total[some])
            if forest:
                x, y = np.array(forest).T
                a.append(nodes[keep[x]])
                b.append(nodes[keep[y]])
                n.append(np.zeros(len(x), dtype=np.int64))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)})

    return run


def _texts_to_sets(width: int):
    import pyarrow as pa

    def run(batches):
        for batch, texts in runs(batches):
            sets = [s.tobytes() for s in shingle_sets(texts, width, "blank_fold")]
            yield batch.set_column(batch.schema.get_field_index("text"), "shingles", pa.array(sets, pa.binary()))

    return run


def _bundles(nodes: DataFrame, part: int, whole: int) -> DataFrame:
    """(node, root) of all nodes that meet another one whose histogram allows a link."""
    entries = nodes.select("node", F.explode("keys").alias("key"))
    met = entries.groupBy("key").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("rows"),
        F.expr("bit_xor(xxhash64(node))").alias("who"),
    ).where("lo < hi")
    # parts that the same nodes share need one look
    met = freeze(met.groupBy("lo", "hi", "rows", "who").agg(F.min("key").alias("key")))
    members = rows_with_bit(entries.select(F.col("key").alias("k"), "node"), "k", bitmap(met, "key"))
    members = freeze(members.join(met, F.col("k") == F.col("key")).select("key", "node", "lo", "rows"))
    count = members.count()
    usual = members.where(F.col("rows") <= MEETING_ROWS).select("key", "node")
    usual = usual.join(nodes.select("node", "n", "bins"), "node")
    usual = usual.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts_for(count, 100_000, 12))))
    stars = usual.groupBy("part").applyInPandas(_meet(part, whole), "a long, b long")
    crowds = members.where((F.col("rows") > MEETING_ROWS) & (F.col("node") != F.col("lo")))
    return components(stars.union(crowds.select(F.col("lo").alias("a"), F.col("node").alias("b"))))


def set_join(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document.

    Documents are linked if whole * |A and B| >= part * |A or B| over their sets of distinct `width`-word shingles
    (A-Z lowered); a text of fewer words is one shingle. component_id is the smallest doc_id that links reach, the own
    one included; n_links counts the other documents that a document is directly linked with, copies too. A NULL or
    blank text has an empty set and is linked with nothing. Rows that repeat a doc_id count one by one. A NULL doc_id
    is the component_id only of a class in which no document has one. No rows give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketch = freeze(slim.mapInArrow(_sketch(width, part, whole), SKETCH))
    nodes = freeze(
        sketch.where("node is not null").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("pick"),
            F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"),
            F.first("bins").alias("bins"), F.first("keys").alias("keys"),
        )
    )
    bundles = _bundles(nodes, part, whole)

    cells = bundles.join(nodes.select("node", "pick", "n", "copies"), "node")
    blocks = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_SETS)))
    heavy = cells.groupBy("root").agg(blocks.cast("int").alias("blocks"))
    cells = cells.join(heavy, "root").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    cells = freeze(cells)
    volume = cells.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(other, F.col("own")).alias("i"), F.greatest(other, F.col("own")).alias("j")),
    )
    wanted = cells.select(
        "root", "node", "n", "copies", "own", F.col("pick.doc_id").alias("w_id"), F.col("pick.mark").alias("w_mark"),
        pairs.alias("pairs"),
    )
    # texts of other documents are not moved
    near = rows_with_bit(slim, "mark", bitmap(wanted, "w_mark"))
    match = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))
    found = near.join(wanted.hint("merge"), match).select("root", "node", "n", "copies", "own", "pairs", "text")
    sets = found.mapInArrow(
        _texts_to_sets(width),
        "root long, node long, n long, copies long, own int, pairs array<struct<i:int,j:int>>, shingles binary",
    )
    sets = sets.withColumn("p", F.explode("pairs")).select("root", "node", "n", "copies", "own", "shingles", "p.i", "p.j")
    sets = sets.withColumn("part", F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts_for(volume, 1_000_000, 12))))
    links = freeze(sets.groupBy("part").applyInPandas(_links(part, whole), "a long, b long, n long"))
    linked = links.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    groups = components(links.where("n = 0").select("a", "b"))

    owner = nodes.join(groups, "node", "left").join(linked, "node", "left").select(
        F.col("node").alias("owner"), F.coalesce("root", "node").alias("grp"), "pick",
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    owner = freeze(owner)
    best = owner.groupBy("grp").agg(F.min("pick").alias("best"))
    owner = owner.join(best, "grp").select("owner", "best", "n_links")
    rows = sketch.select("doc_id", "n_shingles", "node").join(owner, F.col("node") == F.col("owner"), "left")
    return rows.select(
        "doc_id", "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common FROM flat a JOIN flat b
  ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 90 * (nx + ny - common)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_id AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, coalesce(d.n_links, 0) AS n_links
FROM sets s JOIN least_id l ON l.x = s.doc_id LEFT JOIN degree d ON d.x = s.doc_id"""
