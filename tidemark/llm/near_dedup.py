"""Near-duplicate groups by b-bit MinHash.

1. Every text becomes the set of its distinct word shingles. Texts with equal sets are one node from here on.
2. Of each node's `HASHES` minima the lowest `BITS` bits are packed into a signature; runs of `ROWS` full minima give
   the band keys. A pair at the threshold shares no band with a chance of about (1 - 0.8^4)^32 = 5e-8.
3. Nodes of a band bucket are compared by bit counts of their signatures. Agreements are corrected for chance
   (1 / 2^BITS) to an estimate of the similarity; it must come within six standard errors of the threshold. Linked
   nodes of a bucket give a star; stars are joined to bundles, which hold every pair that can be similar.
4. Inside a bundle the full sets decide. A task returns a spanning forest of the true links, not all of them; the
   components of all forests are the groups. A bundle too large for a task is cut into blocks, a task per pair of blocks.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap, rows_with_bit
from .components import components
from .frames import freeze, fresh, parts_for
from .words import runs, shingle_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HASHES, ROWS, BITS = 128, 4, 2
#: Members of a band bucket above which its nodes are put into one bundle without an estimate.
BUCKET_ROWS = 20_000
#: Shingles that one block of a bundle may hold.
BLOCK_SHINGLES = 2_000_000

SKETCH = "doc_id long, mark long, n_shingles long, node long, sig binary, bands array<long>"


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES x len(sets) minima of non-empty sets."""
    every = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    draws = np.random.RandomState(20240131).randint(0, 1 << 62, size=(2, HASHES), dtype=np.int64).astype(np.uint64)
    out = np.empty((HASHES, len(sets)), dtype=np.uint64)
    for k in range(HASHES):
        a, b = draws[0, k] * np.uint64(2) + np.uint64(1), draws[1, k]
        out[k] = np.minimum.reduceat(every * a + b, starts)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """HASHES x n matrix of BITS-bit numbers to n rows of bytes."""
    bits = ((low[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.transpose(1, 0, 2).reshape(low.shape[1], -1), axis=1)


def agreements(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Number of equal BITS-bit fields between signature rows (uint64 words of two-bit fields)."""
    differ = one ^ many
    field = np.uint64(0x5555555555555555)
    return HASHES - np.bitwise_count((differ | (differ >> np.uint64(1))) & field).sum(axis=-1).astype(np.int64)


def least_agreements(share: float) -> int:
    """Agreements that a pair at the threshold reaches but for six standard errors."""
    chance = 1.0 / (1 << BITS)
    p = chance + share * (1 - chance)
    return int(np.floor(HASHES * p - 6 * np.sqrt(HASHES * p * (1 - p))))


def estimate(agree: np.ndarray) -> np.ndarray:
    """Similarity from agreements, corrected for chance."""
    chance = 1.0 / (1 << BITS)
    return np.clip((agree / HASHES - chance) / (1 - chance), 0.0, 1.0)


def _sketch(width: int, fold: str):
    import pyarrow as pa

    def run(batches):
        for batch, texts in runs(batches):
            sets = shingle_sets(texts, width, fold)
            full = [i for i, s in enumerate(sets) if len(s)]
            n = len(sets)
            node, sig, bands = [None] * n, [None] * n, [None] * n
            if full:
                least = minima([sets[i] for i in full])
                rows = packed((least >> np.uint64(20)) & np.uint64((1 << BITS) - 1))
                keys = np.zeros((HASHES // ROWS, len(full)), dtype=np.uint64)
                for r in range(ROWS):
                    keys = (keys ^ least[r::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
                    keys ^= keys >> np.uint64(29)
                keys += (np.arange(HASHES // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
                keys = keys.view(np.int64).T
                for k, i in enumerate(full):
                    node[i] = set_key(sets[i])
                    sig[i] = rows[k].tobytes()
                    bands[i] = keys[k]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "mark", "n_shingles", "node", "sig", "bands"],
            )

    return run


def set_key(shingles: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _stars(least: int):
    """Within each band bucket, stars of the nodes that the estimate connects."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["band", "node"], kind="stable")
        band, node = frame["band"].to_numpy(), frame["node"].to_numpy()
        sig = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint64).reshape(len(frame), -1)
        first = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
        sizes = np.diff(np.append(first, len(band)))
        leader = np.repeat(first, sizes)
        near = agreements(sig, sig[leader]) >= least
        pairs = [np.stack([node[leader[near]], node[near]], axis=1)]
        loose = np.add.reduceat((~near).astype(np.int64), first)
        for k in np.flatnonzero((loose > 0) & (sizes > 2)):
            lo, hi = first[k], first[k] + sizes[k]
            rest = np.flatnonzero(~near[lo:hi])
            queue = list(np.flatnonzero(near[lo:hi]))
            head = 0
            while len(rest):
                while queue and len(rest):
                    x = queue.pop()
                    if x == 0:
                        continue
                    hit = agreements(sig[lo + x], sig[lo + rest]) >= least
                    found, rest = rest[hit], rest[~hit]
                    if len(found):
                        pairs.append(np.stack([np.full(len(found), node[lo + head]), node[lo + found]], axis=1))
                        queue.extend(found)
                if len(rest):
                    head, rest = int(rest[0]), rest[1:]
                    queue = [head]
        out = np.concatenate(pairs)
        out = np.unique(out[out[:, 0] != out[:, 1]], axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    return run


def _forest(part: int, whole: int):
    """Spanning forests of the true links inside (bundle, i, j), from full sets."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["root", "i", "j", "node"], kind="stable").reset_index(drop=True)
        key = frame[["root", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        a, b = [], []
        for lo, hi in zip(first, np.append(first[1:], len(frame)), strict=True):
            node = frame["node"].to_numpy()[lo:hi]
            keep = np.concatenate(([True], node[1:] != node[:-1]))
            node, blobs = node[keep], frame["shingles"].to_numpy()[lo:hi][keep]
            sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs]
            size = np.array([len(s) for s in sets])
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
            start = np.concatenate(([0], np.cumsum(size)))
            flag = np.zeros(int(codes.max()) + 1, dtype=np.uint8)
            rest = np.arange(len(node))
            queue: list[int] = []
            while len(rest):
                if not queue:
                    queue, rest = [int(rest[0])], rest[1:]
                x = queue.pop()
                # Sets of too different a size cannot be linked.
                fits = rest[(np.minimum(size[rest], size[x]) * whole >= np.maximum(size[rest], size[x]) * part)]
                if not len(fits):
                    continue
                mine = codes[start[x] : start[x + 1]]
                flag[mine] = 1
                spans = size[fits]
                inner = np.arange(spans.sum()) + np.repeat(start[fits] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans)
                both = np.add.reduceat(flag[codes[inner]].astype(np.int64), np.concatenate(([0], np.cumsum(spans)[:-1])))
                flag[mine] = 0
                linked = fits[whole * both >= part * (size[x] + spans - both)]
                if len(linked):
                    a.extend([node[x]] * len(linked))
                    b.extend(node[linked])
                    queue.extend(linked.tolist())
                    rest = np.setdiff1d(rest, linked, assume_unique=True)
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return run


def _sets(width: int, fold: str):
    import pyarrow as pa

    def run(batches):
        for batch, texts in runs(batches):
            sets = [s.tobytes() for s in shingle_sets(texts, width, fold)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "shingles", pa.array(sets, pa.binary()))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept, chosen of every document.

    Documents are linked if whole * |A and B| >= part * |A or B| over their sets of distinct `width`-word shingles
    (A-Z lowered); a text of fewer words is one shingle. component_id is the smallest doc_id that links reach, kept
    says that it is the document's own. `mark` is a hash of the text, which tells apart rows that share a doc_id.
    A NULL or blank text has an empty set and is linked with nothing. A NULL doc_id never becomes a component_id
    unless no document of its group has one; then component_id is NULL and kept true. `chosen` marks the one document
    of a group that stays: the one with the smallest id, of several texts under that id the smallest mark.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketch = freeze(slim.mapInArrow(_sketch(width, "blank_fold"), SKETCH))
    nodes = sketch.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("pick"),
        F.first("n_shingles").alias("n"),
        F.first("sig").alias("sig"), F.first("bands").alias("bands"),
    )
    nodes = freeze(nodes)
    entries = nodes.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = freeze(shared.where("lo < hi").select("band", "lo", "n"))
    members = freeze(entries.join(shared, "band"))
    total = members.count()
    usual = members.where(F.col("n") <= BUCKET_ROWS).select("band", "node")
    usual = usual.join(nodes.select("node", "sig"), "node")
    usual = usual.withColumn("part", F.pmod(F.xxhash64("band"), F.lit(parts_for(total, 100_000, 12))))
    least = least_agreements(part / whole)
    stars = usual.groupBy("part").applyInPandas(_stars(least), "a long, b long")
    crowds = members.where((F.col("n") > BUCKET_ROWS) & (F.col("node") != F.col("lo")))
    bundles = components(stars.union(crowds.select(F.col("lo").alias("a"), F.col("node").alias("b"))))

    cells = bundles.join(nodes.select("node", "pick", "n"), "node")
    heavy = cells.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    cells = cells.join(heavy, "root").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    cells = freeze(cells)
    volume = cells.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(other, F.col("own")).alias("i"), F.greatest(other, F.col("own")).alias("j")),
    )
    wanted = cells.select("root", "node", F.col("pick.doc_id").alias("w_id"), F.col("pick.mark").alias("w_mark"), pairs.alias("pairs"))
    # Texts of other documents need not be moved.
    near = rows_with_bit(slim, "mark", bitmap(wanted, "w_mark"))
    match = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))
    found = near.join(wanted.hint("merge"), match)
    sets = found.select("root", "node", "pairs", "text").mapInArrow(
        _sets(width, "blank_fold"), "root long, node long, pairs array<struct<i:int,j:int>>, shingles binary"
    )
    sets = sets.select("root", "node", "shingles", F.explode("pairs").alias("p")).select("root", "node", "shingles", "p.i", "p.j")
    sets = sets.withColumn("part", F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts_for(volume, 1_000_000, 12))))
    links = sets.groupBy("part").applyInPandas(_forest(part, whole), "a long, b long")
    groups = components(links)

    owner = freeze(nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("grp"), "pick"))
    named = owner.groupBy("grp").agg(F.min("pick").alias("best"))
    owner = owner.join(named, "grp").select(F.col("node").alias("owner"), "best")
    rows = sketch.select("doc_id", "mark", "n_shingles", "node").join(owner, F.col("node") == F.col("owner"), "left")
    blank = F.col("node").isNull()
    component = F.when(blank, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return rows.select(
        "doc_id", "mark", "n_shingles", component.alias("component_id"), kept.alias("kept"),
        (blank | (kept & (F.col("mark") == F.col("best.mark")))).alias("chosen"),
    )


def one_of_each(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The documents with one row of each group left; rows without words all stay.

    Only rows that may have to go, by a bitmap of their marks, meet the decisions in a join.
    """
    groups = freeze(near_duplicates(docs, width, part, whole))
    seen = groups.where("n_shingles > 0").groupBy("doc_id", "mark").agg(
        F.max("chosen").alias("stays"), F.count(F.lit(1)).alias("rows")
    )
    doubtful = freeze(seen.where(~F.col("stays") | (F.col("rows") > 1)))
    bits = bitmap(doubtful, "mark")
    key, id_, mark = (fresh(docs, n) for n in ("row_mark", "kept_id", "kept_mark"))
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    sure = rows_with_bit(marked, key, bits, False)
    unsure = rows_with_bit(marked, key, bits)
    decided = doubtful.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("stays").alias(fresh(docs, "stays")))
    stays = F.col(fresh(docs, "stays"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(mark))
    rows = unsure.join(decided.hint("merge"), match, "left")
    untouched = rows.where(F.col(mark).isNull()).select(*docs.columns)
    one = rows.where(stays).dropDuplicates([id_, mark]).select(*docs.columns)
    return sure.select(*docs.columns).union(untouched).union(one)


SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common FROM flat a JOIN flat b
  ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 80 * (nx + ny - common)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_id AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least_id l ON l.x = s.doc_id"""
