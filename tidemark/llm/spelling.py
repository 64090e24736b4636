"""Spelling variants: words one edit apart, found by composing word acceptors with a one-edit transducer.

The pairs sought are the accepted pairs of vocabulary o one-edit o vocabulary. Before the edit both sides read the same
symbols, so they are in the same state; the composed machine therefore splits by the state in which it is after the first
symbols, and each part is a task's own small machine.

1. Routing. A pair whose shorter word has s symbols shares its first or its last k = (s - 1) div 2 symbols, wherever the
   edit is. Every word goes to the parts of its first and of its last k symbols, for s its own length and one less. Parts
   of last symbols read the words backwards. A part with too many words is split in the same way by its further symbols.
2. Per part the remaining symbols become a minimised acyclic acceptor. Composition with the transducer and the acceptor
   again needs only pairs of states behind an edit: equal states accept the same rests, other pairs are walked together,
   and pairs without a common rest are remembered. Accepted pairs are enumerated along those paths that lead to an edit.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import freeze, parts_for
from .words import runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a part above which it is split further.
PART_WORDS = 20_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
LOWER = {code: code + 32 for code in range(65, 91)}


class Acceptor:
    """Minimal acyclic automaton of distinct words, which come in ascending order.

    State 0 accepts the empty rest only, if any word needs it; states are numbered so that an arc leads to a smaller one.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def settle(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return state

        # states along the last word that may still grow: (symbol that leads here, arcs, final)
        path: list[list] = [["", {}, False]]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                symbol, arcs, final = path.pop()
                path[-1][1][symbol] = settle(arcs, final)
            path.extend([symbol, {}, False] for symbol in word[same:])
            path[-1][2] = True
            last = word
        while len(path) > 1:
            symbol, arcs, final = path.pop()
            path[-1][1][symbol] = settle(arcs, final)
        self.start = settle(path[0][1], path[0][2])

    def accepted(self, state: int):
        """All rests that are accepted from a state."""
        stack = [(state, "")]
        while stack:
            at, rest = stack.pop()
            # a chain without branches is followed in one go
            taken = []
            while not self.final[at] and len(self.arcs[at]) == 1:
                (symbol, at), = self.arcs[at].items()
                taken.append(symbol)
            rest += "".join(taken)
            if self.final[at]:
                yield rest
            stack.extend((onward, rest + symbol) for symbol, onward in self.arcs[at].items())


class OneEdit:
    """The composition of an acceptor, the transducer of exactly one edit and the acceptor."""

    def __init__(self, words: Acceptor):
        self.words = words
        self.barren: set[tuple[int, int]] = set()

    def both(self, p: int, q: int, not_first: str = ""):
        """Rests accepted from p and from q, but for those that begin with `not_first`."""
        arcs, final = self.words.arcs, self.words.final
        if not not_first and p == q:
            yield from self.words.accepted(p)
            return
        if final[p] and final[q]:
            yield ""
        for symbol in arcs[p].keys() & arcs[q].keys():
            if symbol != not_first:
                yield from self.shared(arcs[p][symbol], arcs[q][symbol], symbol)

    def shared(self, p: int, q: int, rest: str):
        """`rest` and every common rest of p and q behind it."""
        arcs, final = self.words.arcs, self.words.final
        order, found = [(p, q, rest)], set()
        seen: list[tuple[int, int]] = []
        while order:
            p, q, rest = order.pop()
            if p == q:
                found.add((p, q))
                yield from (rest + more for more in self.words.accepted(p))
                continue
            pair = (p, q) if p < q else (q, p)
            if pair in self.barren:
                continue
            seen.append(pair)
            if final[p] and final[q]:
                found.add(pair)
                yield rest
            order.extend((arcs[p][s], arcs[q][s], rest + s) for s in arcs[p].keys() & arcs[q].keys())
        if not found:
            self.barren.update(seen)

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of rests from a state whose edit comes first; the second is longer if the lengths differ.

        Each pair has one alignment: an inserted symbol stands behind the run of its equals.
        """
        arcs, out = self.words.arcs[state], []
        symbols = sorted(arcs)
        for i, one in enumerate(symbols):
            for other in symbols[i + 1 :]:
                out.extend((one + rest, other + rest) for rest in self.both(arcs[one], arcs[other]))
            out.extend((rest, one + rest) for rest in self.both(state, arcs[one], one))
        return out

    def pairs(self):
        """All accepted pairs."""
        arcs = self.words.arcs
        edits = [self.edits(state) for state in range(len(arcs))]
        leads = [bool(e) for e in edits]
        for state, onward in enumerate(arcs):
            leads[state] = leads[state] or any(leads[s] for s in onward.values())
        stack = [(self.words.start, "")]
        while stack:
            state, read = stack.pop()
            yield from ((read + one, read + other) for one, other in edits[state])
            stack.extend((s, read + symbol) for symbol, s in arcs[state].items() if leads[s])


def _count(lengths_from: int, drop_one_in: int | None):
    """Words per document, some of them with a symbol deleted, counted within the task."""
    import pyarrow as pa

    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % lengths_from)

    def batch_of(counts: Counter):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        counts: Counter = Counter()
        for batch, texts in runs(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                name = "" if doc_id is None else str(doc_id)
                for found, n in Counter(pattern.findall(text.decode())).items():
                    word = found.translate(LOWER)
                    if drop_one_in:
                        drawn = zlib.crc32(f"{name}:{word}".encode())
                        if drawn % drop_one_in == 0:
                            at = drawn % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= lengths_from:
                        counts[word] += n
            if len(counts) >= COUNTED:
                yield batch_of(counts)
                counts = Counter()
        yield batch_of(counts)

    return run


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, drop_one_in: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lowered, of `least_length` symbols, that occur `least_count` times.

    With `drop_one_in`, a word loses a symbol in those documents where the crc32 of `<doc_id>:<word>` divides by it.
    NULL and blank texts have no words; a NULL doc_id is the empty name; repeated rows count again.
    """
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = slim.mapInArrow(_count(least_length, drop_one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _near(frame_rows):
    """Pairs of one part: rows (rest, word, n) and the shorter length of its pairs."""
    rests, words, counts, shorter = frame_rows
    owner = {rest: i for i, rest in enumerate(rests)}
    for one, other in OneEdit(Acceptor(sorted(owner))).pairs():
        if len(one) > shorter and len(other) > shorter:
            # both words are of the greater length; another part has them
            continue
        i, j = owner[one], owner[other]
        yield words[i], counts[i], words[j], counts[j]


def _pairs():
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        key = frame["key"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        last = np.append(first[1:], len(key))
        columns = [frame[c].to_numpy() for c in ("rest", "word", "n", "shorter")]
        out = []
        for k in np.flatnonzero(last - first > 1):
            rests, words, counts, shorter = (c[first[k] : last[k]] for c in columns)
            out.extend(_near((rests, words, counts, int(shorter[0]))))
        return pd.DataFrame(out, columns=["a", "a_n", "b", "b_n"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, shorter, rest, word, n) to the parts of the first and of the last symbols of their rests."""
    take = F.floor((F.col("shorter") - 1) / 2).cast("int")
    sides = F.explode(
        F.array(
            F.struct(F.lit("<").alias("side"), F.col("rest").alias("read")),
            F.struct(F.lit(">").alias("side"), F.reverse("rest").alias("read")),
        )
    )
    return rows.withColumn("take", take).withColumn("s", sides).where("s.side = '<' OR take > 0").select(
        F.concat("key", F.lit("|"), F.col("shorter").cast("string"), F.col("s.side"), F.expr("left(s.read, take)")).alias("key"),
        (F.col("shorter") - F.col("take")).alias("shorter"),
        F.expr("substring(s.read, take + 1)").alias("rest"), "word", "n",
    )


def near_pairs(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of distinct words that differ by one inserted, deleted or replaced symbol, once each.

    `words` holds (word, n) with distinct words; NULL words and empty ones take no part.
    """
    size = F.length("word")
    rows = words.where(size > 0).select(
        F.lit("").alias("key"), F.explode(F.array(size, size - 1)).alias("shorter"), F.col("word").alias("rest"), "word", "n"
    )
    rows = _dealt(rows.where("shorter > 0"))
    done = []
    while True:
        heavy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("shorter").alias("left"))
        heavy = freeze(heavy.where((F.col("size") > part_words) & (F.col("left") > 2)).select("key"))
        if heavy.isEmpty():
            break
        done.append(rows.join(heavy, "key", "left_anti"))
        rows = freeze(_dealt(rows.join(heavy, "key", "left_semi")))
    done.append(rows)
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    # a word is in four parts
    parts = parts_for(4 * words.count(), 100_000, 12)
    whole = whole.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    found = whole.groupBy("part").applyInPandas(_pairs(), "a string, a_n long, b string, b_n long")
    ordered = found.select(
        F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
        F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"),
    )
    return ordered.distinct()


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary (word, n).

    The form of a word is its most frequent near word (ties: the smallest by code points) if that is `factor` times as
    frequent, else NULL with a NULL form_n. The root is reached by following forms, and is the word itself without one.
    """
    words = freeze(words)
    pairs = freeze(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select("b", "a", "a_n")
    )
    near = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    joined = words.join(near, "word", "left")
    has = -F.col("best.less") >= factor * F.col("n")
    joined = freeze(
        joined.select(
            "word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, -F.col("best.less")).alias("form_n"),
        )
    )
    # each step is followed twice as far as the last; counts grow along the way, so there is no circle
    steps = freeze(joined.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = freeze(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = farther.select("word", "root")
        if farther.where("moved").isEmpty():
            break
    out = joined.join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""WITH RECURSIVE found AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
runs AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM found WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, c, xor(4294967295, list_reduce([4294967295] || list_transform(
    regexp_extract_all(hex(encode(id || ':' || run)), '..'),
    lambda x: 16 * (strpos('0123456789ABCDEF', x[1]) - 1) + strpos('0123456789ABCDEF', x[2]) - 1),
    lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)
  )) AS h FROM runs),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
  ELSE run END AS word, c FROM coded),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, length(word) AS l, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, l, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM less),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON w.word = c.rest
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS (SELECT n.word, min(n.other) AS form, any_value(n.other_n) AS form_n FROM near n JOIN best b ON n.word = b.word AND n.other_n = b.top
  JOIN words w ON w.word = n.word WHERE n.other_n >= 10 * w.n GROUP BY n.word),
walk AS (SELECT word, word AS root FROM words UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON w.root = f.word),
roots AS (SELECT w.word, w.root FROM walk w LEFT JOIN forms f ON f.word = w.root WHERE f.word IS NULL)
SELECT w.word, f.form, r.root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w JOIN roots r USING (word) LEFT JOIN forms f USING (word) LEFT JOIN best b USING (word)"""
