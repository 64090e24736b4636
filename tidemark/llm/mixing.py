"""Mixing sources to target weights by nested hash thresholds, in DataFrame operations only.

Every document gets a 60-bit hash of its id. Per source, words are summed by the leading hash bits; the bucket in which
the running sum passes the budget is split by its next bits, and only its rows are read again, until one document is
left in it. Documents below that hash are taken. What the budget then lacks (less than the document at the threshold
has) is the budget of a nested round over the documents above it that still fit. No document is sorted or numbered.

A long document with a late hash can leave a wide gap that nothing above it fills. A source that lacks more than a
sixteenth of its budget is therefore tried again with the longest document that was passed over and fits the budget taken
first, and the rest filled by thresholds from the start; of the tries the one nearest to the target counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import freeze, fresh, word_count

HASH_BITS = 60
LEVEL_BITS = 12
ROUNDS = 4
#: A source that lacks more than this part of its budget is tried again, so many times.
GAP, TRIES = 16, 2


def id_hash(column):
    """Sixty bits of the md5 of an id; a NULL id counts as an empty text."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds `sid` and `target` to one row (source, source_size) per source.

    Sources by code point, NULL last, take the weights in turn. A source gets `weight * level`, but no more than
    `most` times its size; the level at which all targets add up to `share` of all sizes is the largest one that any
    number of full sources leaves to the others. The windows see one row per source, never documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    frame = (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    )
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        frame.withColumn("level", level)
        .withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(everything)))
        .select("source", "sid", "source_size", "target")
    )


def _threshold(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Per source (sid, lo, room) the first hash that the room cannot hold, what is left, and where to go on."""
    top = 1 << HASH_BITS
    frame = state.select(
        "sid", "lo", "room", F.col("room").alias("left"), F.lit(0).cast("long").alias("start"),
        F.lit(top).alias("end"), F.lit(False).alias("alone"),
    )
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        open_ = frame.where(~F.col("alone") & (F.col("left") > 0))
        seen = rows.join(open_, "sid").where(
            (F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("h") >= F.col("lo"))
            & (F.col("h") >= F.col("start")) & (F.col("h") < F.col("end"))
        )
        bars = seen.groupBy("sid", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left")
        )
        running = F.sum("words").over(Window.partitionBy("sid").orderBy("bucket"))
        bars = bars.withColumn("upto", running)
        bounds = bars.groupBy("sid").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "upto", "words", "n"))).alias("over"),
            F.max("upto").alias("all"),
        )
        joined = frame.join(bounds, "sid", "left")
        crossed, quiet = F.col("over").isNotNull(), F.col("all").isNotNull() & F.col("over").isNull()
        frame = freeze(
            joined.select(
                "sid", "lo", "room",
                F.when(crossed, F.col("left") - F.col("over.upto") + F.col("over.words"))
                .when(quiet, F.col("left") - F.col("all")).otherwise(F.col("left")).alias("left"),
                F.when(crossed, F.shiftleft("over.bucket", shift)).when(quiet, F.lit(top))
                .otherwise(F.col("start")).alias("start"),
                F.when(crossed, F.shiftleft(F.col("over.bucket") + 1, shift)).otherwise(F.col("end")).alias("end"),
                F.when(crossed, F.col("over.n") == 1).otherwise(F.lit(True)).alias("alone"),
            )
        )
        if frame.where(~F.col("alone")).isEmpty():
            break
    return frame


def thresholds(docs: DataFrame, weights, share: float, most: float, rounds: int) -> DataFrame:
    """One row per source: name, source_size, target, whole, and the hash range and room of every round."""
    slim = docs.select("source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    slim = freeze(slim)
    sources = freeze(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long")).withColumnRenamed("source", "name")
    rows = slim.join(sources.select("name", "sid"), F.col("source").eqNullSafe(F.col("name"))).select("sid", "size", "h")
    rows = freeze(rows)
    sources = sources.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    firsts = F.array().cast("array<long>")
    best = tried = freeze(_tried(rows, sources.select("sid", F.col("budget").alias("room"), firsts.alias("firsts")), rounds))
    for _ in range(TRIES):
        lacking = tried.join(sources.select("sid", "budget"), "sid").where(F.col("left") * GAP > F.col("budget"))
        missed = rows.join(lacking, "sid").where((F.col("size") > 0) & ~_hit(F.col("h"), F.col("size"), F.col, rounds))
        units = missed.groupBy("sid", "h", "room_0", "firsts").agg(F.sum("size").alias("words")).where("words <= room_0")
        longest = units.groupBy("sid", "room_0", "firsts").agg(F.max(F.struct("words", (-F.col("h")).alias("less"))).alias("p"))
        again = freeze(
            longest.select(
                "sid", (F.col("room_0") - F.col("p.words")).alias("room"), F.array_append("firsts", -F.col("p.less")).alias("firsts")
            )
        )
        if again.isEmpty():
            break
        tried = freeze(_tried(rows, again, rounds))
        nearer = best.alias("b").join(tried.alias("t"), "sid", "left")
        wins = F.coalesce(F.col("t.left") < F.col("b.left"), F.lit(False))
        best = freeze(nearer.select("sid", *[F.when(wins, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in best.columns if c != "sid"]))
    return freeze(sources.join(best, "sid").drop("sid", "left", "budget"))


def _tried(rows: DataFrame, state: DataFrame, rounds: int) -> DataFrame:
    """Per source (sid, room, firsts) the hash range and room of every round and what is left; `firsts` are taken already."""
    firsts = state.select("sid", "firsts")
    # one row per source
    others = rows.join(F.broadcast(firsts), "sid").where(~F.array_contains("firsts", F.col("h"))).select("sid", "size", "h")
    picked, state = firsts, state.select("sid", F.lit(0).cast("long").alias("lo"), "room")
    for k in range(rounds):
        found = _threshold(others, state)
        picked = picked.join(found.select("sid", *[F.col(a).alias(f"{a}_{k}") for a in ("lo", "start", "room")]), "sid")
        state = found.select("sid", F.col("end").alias("lo"), F.col("left").alias("room"))
    return picked.join(state.select("sid", F.col("room").alias("left")), "sid")


def _hit(h, size, at, rounds: int):
    """Whether a document is below the threshold of a round or taken first."""
    taken = [(h >= at(f"lo_{k}")) & (h < at(f"start_{k}")) & (size <= at(f"room_{k}")) for k in range(rounds)]
    return (size > 0) & (F.array_contains(at("firsts"), h) | reduce(lambda a, b: a | b, taken))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, rounds: int = ROUNDS) -> DataFrame:
    """The documents with a struct column `mix`: size, source_size, target, copies, taken (= size * copies).

    Every document of a source is taken as often as the target holds the source whole, and once more if its hash is
    below the threshold of a round or it is taken first; so no document is taken more than `most` times (rounded up). The
    words taken stay below the target by less than the smallest document that was passed over in the last round; if that
    is more than a sixteenth of what the whole source leaves open, up to two long documents are tried first.
    A NULL source is a source of its own. A NULL or blank text has size 0 and is taken as often as its source is
    whole. Rows with the same id share a hash and stand or fall together. No rows give no rows. A column `mix` of the
    documents moves the new one to `mix_`.
    """
    plan = thresholds(docs, weights, share, most, rounds)
    own = fresh(docs, "mix")
    size, h = word_count(F.col("text")), id_hash(F.col("doc_id"))
    held = fresh(docs, "mix_plan")
    plan = plan.select(F.struct("*").alias(held))
    at = F.col(held)
    rows = docs.withColumn(own, F.struct(size.alias("size"), h.alias("h")))
    rows = rows.join(plan, F.col("source").eqNullSafe(at["name"]))
    size, h = F.col(f"{own}.size"), F.col(f"{own}.h")
    copies = (at["whole"] + F.when(_hit(h, size, lambda c: at[c], rounds), 1).otherwise(0)).cast("long")
    return rows.select(
        *docs.columns,
        F.struct(
            size.alias("size"), at["source_size"].alias("source_size"), at["target"].alias("target"),
            copies.alias("copies"), (size * copies).alias("taken"),
        ).alias(own),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents as often as the mix takes them."""
    rows = mix(docs, **settings)
    own, turn = rows.columns[-1], fresh(rows, "turn")
    copies = F.col(f"{own}.copies")
    rows = rows.where(copies > 0).withColumn(turn, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return rows.select(*docs.columns)


def sql(rounds: int = ROUNDS) -> str:
    """The same result as SQL: thresholds as running sums in hash order, for every try."""
    own = "doc_id, source, h, size, source_size, target, whole, budget, room, first"
    steps = []
    for t in range(TRIES + 1):
        if t == 0:
            steps.append("b0 AS (SELECT *, room AS budget, false AS first FROM placed)")
        else:
            steps.append(
                f"p{t} AS (SELECT source AS ps, h AS ph, words FROM (SELECT source, h, room, left_ * {GAP} > budget AS lacks, "
                f"sum(size) AS words FROM t{t - 1}_r{rounds} WHERE size > 0 AND NOT hit AND NOT first GROUP BY ALL) "
                f"WHERE lacks AND words <= room QUALIFY row_number() OVER (PARTITION BY source ORDER BY words DESC, h) = 1)"
            )
            steps.append(
                f"b{t} AS (SELECT doc_id, source, h, size, source_size, target, whole, room - words AS room, budget, "
                f"first OR (h = ph AND size > 0) AS first FROM t{t - 1}_r{rounds} JOIN p{t} ON source IS NOT DISTINCT FROM ps)"
            )
        steps.append(f"t{t}_r0 AS (SELECT {own}, false AS hit, CAST(-1 AS BIGINT) AS lo, room AS left_ FROM b{t})")
        for k in range(rounds):
            fits = "NOT first AND size > 0 AND size <= left_ AND h > lo"
            steps.append(
                f"t{t}_e{k} AS (SELECT {own}, hit, lo, left_, {fits} AS fits, "
                f"sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h) AS upto FROM t{t}_r{k})"
            )
            steps.append(
                f"t{t}_r{k + 1} AS (SELECT {own}, hit OR (fits AND upto <= left_) AS hit, "
                f"coalesce(min(CASE WHEN fits AND upto > left_ THEN h END) OVER (PARTITION BY source), "
                f"CAST(1152921504606846976 AS BIGINT)) AS lo, "
                f"left_ - coalesce(sum(CASE WHEN fits AND upto <= left_ THEN size END) OVER (PARTITION BY source), 0) "
                f"AS left_ FROM t{t}_e{k})"
            )
    tries = " UNION ALL ".join(
        f"SELECT {t} AS try, doc_id, source, h, size, source_size, target, whole, hit OR first AS hit, left_ FROM t{t}_r{rounds}"
        for t in range(TRIES + 1)
    )
    steps.append(f"tries AS ({tries})")
    steps.append("nearest AS (SELECT source AS ns, try AS nt FROM (SELECT DISTINCT source, try, left_ FROM tries) QUALIFY row_number() OVER (PARTITION BY source ORDER BY left_, try) = 1)")
    return (
        r"""WITH slim AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
sizes AS (SELECT source, sum(size) AS source_size FROM slim GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM sizes),
weighed AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap,
  1.5::DOUBLE * sum(source_size) OVER () AS budget FROM numbered),
levelled AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aimed AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levelled),
placed AS (SELECT doc_id, s.source, h, size, source_size, target, false AS hit,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
  target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS room
  FROM slim s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
"""
        + ",\n".join(steps)
        + f"\nSELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, "
        f"CAST(size * (whole + CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM tries "
        f"JOIN nearest ON source IS NOT DISTINCT FROM ns AND try = nt"
    )
