"""Language identification by cross-parsing.

A suffix automaton is built for the sample text of every language. A document is parsed against each one: the longest
match from the current place is a phrase, the next phrase starts where it ended. A text in the language of the sample
needs few phrases; phrases times log(sample length) per letter estimates the cross entropy, and the smallest wins. A
letter that the sample lacks is a phrase of its own. Every letter of the samples has its own symbol, in any script.

The sample is bounded: at most `SAMPLE_DOCS` documents a language, the first `SAMPLE_CHARS` characters of each, less if
there are many languages (`MOST_CHARS` in all). Parsing covers whole texts.
"""

from __future__ import annotations

import random
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh
from .words import runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_DOCS, SAMPLE_CHARS, MOST_CHARS = 24, 2_000, 2_000_000
#: Characters of a lane. Long texts are parsed in lanes side by side; each is then entered with the phrase that the lane before
#: leaves open, as far as that changes anything, so the phrases are those of one parse of the whole text.
LANE = 512
BLANK, OTHER, FIRST = 0, 1, 2
#: State after a letter that the sample lacks, and before the first one.
NOWHERE = 0


def automaton(codes: list[int], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix automaton as (places, state after starting anew with each symbol).

    A state is the number of its first place: its transition with a symbol is at place state + symbol, if that place
    belongs to the state. A place holds its state in the upper and the next state in the lower 32 bits. Rows of places
    interleave, so the table grows with the transitions, not with states times symbols.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return interleaved(step, symbols)


def interleaved(step: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions by state as one table. Long rows are placed first, at random; each finds room after a few tries."""
    room = 2 * sum(map(len, step)) + len(step) + 1
    taken, used = bytearray(room + symbols), bytearray(room)
    used[NOWHERE] = 1
    base = [0] * len(step)
    rnd = random.Random(len(step))
    for s in sorted(range(len(step)), key=lambda s: -len(step[s])):
        moves = step[s]
        tries = 0
        while True:
            at = int(rnd.random() * room)
            if not used[at] and not any([taken[at + c] for c in moves]):
                break
            tries += 1
            if tries % 1000 == 0:
                used.extend(bytes(room))
                taken.extend(bytes(room))
                room *= 2
        base[s] = at
        used[at] = 1
        for c in moves:
            taken[at + c] = 1
    places = np.full(room + symbols, -1, dtype=np.int64)
    for s, moves in enumerate(step):
        for c, t in moves.items():
            places[base[s] + c] = base[s] << 32 | base[t]
    again = np.full(symbols, NOWHERE, dtype=np.int64)
    for c, t in step[0].items():
        again[c] = base[t]
    return places, again


def symbol_table(letters: list[str]) -> np.ndarray:
    """Symbol of every code point: blank for all but letters; both cases of a letter share one."""
    table = np.fromiter((OTHER if chr(c).isalpha() else BLANK for c in range(0x110000)), dtype=np.int32, count=0x110000)
    # A form that two letters share goes to the more frequent one, but a letter keeps its own symbol.
    for k, letter in reversed(list(enumerate(letters))):
        for form in (letter.upper(), letter.lower()):
            if len(form) == 1:
                table[ord(form)] = FIRST + k
    for k, letter in enumerate(letters):
        table[ord(letter)] = FIRST + k
    return table


def encode(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with runs of blanks as one, and the number of symbols per text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = table[points]
    before = np.zeros_like(codes)
    before[1:] = codes[:-1]
    ends = np.cumsum(lengths)
    before[(ends - lengths)[lengths > 0]] = BLANK
    keep = (codes != BLANK) | (before != BLANK)
    kept = np.concatenate(([0], np.cumsum(keep, dtype=np.int64)))
    return codes[keep], kept[ends] - kept[ends - lengths]


def lanes(codes: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols as a LANE x n matrix, and the text of each lane."""
    per = -(-counts // LANE)
    owner = np.repeat(np.arange(len(counts)), per)
    base = np.cumsum(per) - per
    begin = np.cumsum(counts) - counts
    place = np.arange(len(codes)) + np.repeat(base * LANE - begin, counts)
    out = np.full(len(owner) * LANE, pad, dtype=codes.dtype)
    out[place] = codes
    return np.ascontiguousarray(out.reshape(-1, LANE).T), owner


def phrases(matrix: np.ndarray, table: tuple[np.ndarray, np.ndarray], symbols: int, follows: np.ndarray | None = None) -> np.ndarray:
    """Phrases that begin in each lane against one automaton; a letter that the sample lacks is one by itself.

    The last symbol stands for no character; it only ends lanes. `follows` tells which lanes go on with the text of the
    lane before. All lanes are parsed as if a phrase began with them; then again from the state that the lane before ends
    in, until both parses are in the same state. Where that is not before the lane's end, the next one is corrected after it.
    """
    places, again = table
    n = matrix.shape[1]
    end = np.full(n, NOWHERE, dtype=np.int64)
    count = np.zeros(n, dtype=np.int32)
    for row in matrix:
        found = places[end + row]
        other = (found >> 32) != end
        count += other
        end = np.where(other, again[row], found & 0xFFFFFFFF)
    if follows is not None and follows.any():
        entry = np.full(n, NOWHERE, dtype=np.int64)
        late = np.flatnonzero(follows)
        entry[late] = end[late - 1]
        state, fresh_state = entry[late], np.full(len(late), NOWHERE, dtype=np.int64)
        for row in matrix:
            apart = state != fresh_state
            late, state, fresh_state = late[apart], state[apart], fresh_state[apart]
            if not len(late):
                break
            codes = row[late]
            found, fresh_found = places[state + codes], places[fresh_state + codes]
            other, fresh_other = (found >> 32) != state, (fresh_found >> 32) != fresh_state
            count[late] += other.astype(np.int32) - fresh_other
            state = np.where(other, again[codes], found & 0xFFFFFFFF)
            fresh_state = np.where(fresh_other, again[codes], fresh_found & 0xFFFFFFFF)
        end[late] = state
        look, anew = memoryview(places), memoryview(again)
        for lane in late.tolist():
            after = lane + 1
            while after < n and follows[after] and entry[after] != end[after - 1]:
                now, was, entry[after] = int(end[after - 1]), int(entry[after]), end[after - 1]
                more = 0
                for c in matrix[:, after].tolist():
                    found, before = look[now + c], look[was + c]
                    if found >> 32 == now:
                        now = found & 0xFFFFFFFF
                    else:
                        now, more = anew[c], more + 1
                    if before >> 32 == was:
                        was = before & 0xFFFFFFFF
                    else:
                        was, more = anew[c], more - 1
                    if now == was:
                        break
                else:
                    end[after] = now
                count[after] += more
                after += 1
    return count - (matrix == symbols - 1).sum(axis=0, dtype=np.int32)


def fit(docs: DataFrame, held_out=lambda doc_id: F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2) -> dict:
    """The model: symbols, code point table, and per language (name, automaton, sample length).

    Learns from documents with text, language and id that are not held out. The first documents of a language by a hash
    of the id are its sample; Spark keeps that many per partition before it compares them.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id")))
    rows = known.select("lang", F.xxhash64("doc_id", F.lit(11)).alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    rows = rows.withColumn("k", rank).where(F.col("k") <= SAMPLE_DOCS).collect()
    names = sorted({r.lang for r in rows})
    most = MOST_CHARS // max(1, len(names))
    samples = {n: "\n".join(r.t for r in sorted((r for r in rows if r.lang == n), key=lambda r: r.k))[:most] for n in names}
    seen: dict[str, int] = {}
    for sample in samples.values():
        for letter in sample.lower():
            if letter.isalpha():
                seen[letter] = seen.get(letter, 0) + 1
    letters = sorted(seen, key=lambda x: (-seen[x], x))
    table = symbol_table(letters)
    symbols = FIRST + len(letters) + 1
    models = []
    for name in names:
        codes = encode([samples[name]], table)[0]
        if len(codes):
            models.append((name, automaton(codes.tolist(), symbols), len(codes)))
    return {"symbols": symbols, "table": table, "models": models}


def classify(texts: list[str], model: dict) -> tuple[list[str], list[float]]:
    """Language and margin of each text; `und` with 0 where there is no letter, or nothing was learned."""
    codes, counts = encode(texts, model["table"])
    owner = np.repeat(np.arange(len(texts)), counts)
    letters = np.bincount(owner, weights=codes != BLANK, minlength=len(texts))
    matrix, lane_of = lanes(codes, counts, model["symbols"] - 1)
    follows = np.zeros(len(lane_of), dtype=bool)
    follows[1:] = lane_of[1:] == lane_of[:-1]
    models = model["models"]
    cost = np.full((max(1, len(models)), len(texts)), np.inf)
    for k, (_, table, size) in enumerate(models):
        needed = np.bincount(lane_of, weights=phrases(matrix, table, model["symbols"], follows), minlength=len(texts))
        cost[k] = needed * np.log2(size + 1) / np.maximum(letters, 1)
    best = cost.argmin(axis=0)
    ordered = np.sort(cost, axis=0)
    with np.errstate(invalid="ignore"):
        margin = 1 - ordered[0] / ordered[1] if len(models) > 1 else np.ones(len(texts))
    plain = (letters > 0) & (len(models) > 0)
    return (
        [models[b][0] if ok else "und" for b, ok in zip(best, plain, strict=True)],
        [float(min(1.0, max(0.0, m))) if ok else 0.0 for m, ok in zip(margin, plain, strict=True)],
    )


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with `lang_pred` and `score` (underscored further if the names are taken).

    `und` and 0 for a NULL text or one without letters; ties go to the language that sorts first; a score of 0 says that
    two languages fit alike, 1 that no other was learned. Only the text is read. The broadcast holds at most MOST_CHARS
    sample characters, at most 3 transitions and 2 states each, of 8 bytes and about 2.5 places a transition.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")

    def run(batches):
        own = shared.value
        for batch, texts in runs(batches, limit=2 << 20):
            names, margins = classify([t.decode("utf-8", "replace") for t in texts], own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(margins, pa.float64())],
                names=[*batch.schema.names, pred, score],
            )

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)
