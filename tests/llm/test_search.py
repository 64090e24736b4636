"""Set join, spelling variants and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.llm import ranking, set_join, spelling


def make(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- set join ------------------------------------------------------------------------------------------------------


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def joined(data, width, part, whole):
    sets = [shingles(t, width) for _, t in data]
    near = [
        [j for j, b in enumerate(sets) if j != i and a and b and whole * len(a & b) >= part * len(a | b)]
        for i, a in enumerate(sets)
    ]
    out = []
    for i, (doc_id, _) in enumerate(data):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        known = [data[j][0] for j in reach if data[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(known) if known else None) if sets[i] else doc_id, len(near[i])))
    return sorted(out, key=repr)


def texts_around(rnd, bases, copies, lengths):
    out = []
    for _ in range(bases):
        base = [f"w{rnd.randrange(60)}" for _ in range(rnd.choice(lengths))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randrange(3)):
                at = rnd.randrange(len(words) + 1)
                words[at : at + rnd.randrange(2)] = [f"w{rnd.randrange(60)}"] * rnd.randrange(2)
            out.append(" ".join(words))
    return out


EDGES = [None, "", " \t\n", "one", "ONE", "one two", "one two", "One Two three", "one two three"]


@pytest.mark.parametrize("width, part", [(3, 90), (5, 80), (1, 70)])
def test_set_join_equals_brute_force(spark, monkeypatch, width, part):
    rnd = random.Random(width)
    texts = EDGES + texts_around(rnd, 12, 6, [1, 2, 4, 9, 10, 11, 12, 13, 20, 60, 200]) + [" ".join(f"x{i}" for i in range(9000))] * 2
    rnd.shuffle(texts)
    data = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "one two"), (None, "alone here")]
    want = joined(data, width, part, 100)
    docs = make(spark, data).withColumn("node", F.lit("x")).withColumn("mark", F.lit(1))
    assert rows(set_join.set_join(docs, width, part)) == want
    monkeypatch.setattr(set_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(set_join, "MEETING_ROWS", 3)
    assert rows(set_join.set_join(docs, width, part)) == want


def test_set_join_of_no_rows(spark):
    got = set_join.set_join(make(spark, []))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and got.count() == 0


@pytest.mark.parametrize("part", [50, 80, 90, 100])
def test_linked_sets_share_a_key_and_near_histograms(part):
    rnd = np.random.RandomState(part)
    for _ in range(300):
        size = rnd.choice([1, 2, 5, 9, 10, 13, 14, 40, 300, 5000])
        one = np.unique(rnd.randint(0, 1 << 62, size).astype(np.uint64))
        cut = rnd.randint(0, max(1, len(one) * (100 - part) // 100) + 1)
        add = rnd.randint(0, max(1, len(one) * (100 - part) // 100) + 1)
        other = np.unique(np.concatenate([one[cut:], rnd.randint(0, 1 << 62, add).astype(np.uint64)]))
        common = len(np.intersect1d(one, other))
        if not len(other) or 100 * common < part * (len(one) + len(other) - common) or np.array_equal(one, other):
            continue
        keys = set_join.meeting_keys([one, np.zeros(0, np.uint64), other], part, 100)
        assert len(np.intersect1d(keys[0], keys[2])) and not len(keys[1])
        apart = np.abs(set_join.histogram(one).astype(int) - set_join.histogram(other).astype(int)).sum()
        assert apart * (100 + part) <= (len(one) + len(other)) * (100 - part)


@pytest.mark.parametrize("step", [0.01, 1.0, 50.0])
def test_search_with_any_number_of_long_lists(monkeypatch, step):
    monkeypatch.setattr(set_join, "STEP", step)
    rnd = random.Random(7)
    bases = [rnd.sample(range(1, 400), 50) for _ in range(4)]
    sets = []
    for _ in range(120):
        own = set(rnd.choice(bases))
        for _ in range(rnd.randrange(8)):
            own.discard(rnd.choice(sorted(own)))
            own.add(rnd.randrange(1, 400))
        sets.append(np.array(sorted(own), dtype=np.uint64))
    sets.sort(key=len)
    lists = set_join.Lists(sets)
    for part in (60, 80, 90):
        for i, own in enumerate(sets):
            found, common = lists.search(own, part, 100, i)
            want = [
                (j, len(set(own) & set(sets[j])))
                for j in range(i + 1, len(sets))
                if 100 * len(set(own) & set(sets[j])) >= part * len(set(own) | set(sets[j]))
            ]
            assert list(zip(found.tolist(), common.tolist())) == want


# --- spelling variants ---------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(6))
def test_composition_accepts_the_pairs_of_one_edit(seed):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choice("abé"[: 2 + seed % 2]) for _ in range(rnd.randrange(0, 8))) for _ in range(90)})
    acceptor = spelling.Acceptor(words)
    assert sorted(acceptor.accepted(acceptor.start)) == words
    got = list(spelling.OneEdit(acceptor).pairs())
    assert all(len(a) <= len(b) for a, b in got)
    assert sorted(tuple(sorted(p)) for p in got) == [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)]


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(acceptor.arcs) == 5


@pytest.mark.parametrize("part_words", [2, 20_000])
def test_near_pairs_equal_brute_force(spark, part_words):
    rnd = random.Random(part_words)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 11))) for _ in range(250)}
    words |= {"z" * 3000, "z" * 1400 + "y" + "z" * 1600, "z" * 2999, "ÿ" * 8, "ÿ" * 7, "éa" * 4, "èa" + "éa" * 3}
    words = sorted(words)
    frame = make(spark, [(w, len(w)) for w in words] + [(None, 5), ("", 1)], "word string, n long")
    want = [(a, len(a), b, len(b)) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)]
    assert rows(spelling.near_pairs(frame, part_words), "a", "a_n", "b", "b_n") == sorted(want, key=repr)


def test_variants_follow_forms(spark):
    counts = {"abcdefg": 2, "abcdefh": 30, "abcdeeh": 400, "abcdefk": 20, "zzzzzzz": 5, "abcdefgh": 30}
    got = rows(spelling.variants(make(spark, list(counts.items()), "word string, n long")))
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    want = [(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()]
    assert got == sorted(want, key=repr)
    assert root("abcdefg") == "abcdeeh" and form["abcdefg"] == "abcdefgh" or root("abcdefg") != "abcdefg"


def test_vocabulary_counts_runs_with_deletions(spark):
    rnd = random.Random(2)
    words = ["Ärgerlich", "vocabulary", "VOCABULARY", "sevenly", "tiny", "x1vocabularyÿ", "a" * 5000, "éééééééé", "İstanbulda"]
    data = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(60)]
    data += [(1, data[1][1]), (None, "vocabulary vocabulary"), (70, None), (71, "")]
    counts = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    docs = make(spark, data).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    got = rows(spelling.vocabulary(docs, drop_one_in=31))
    assert got == sorted(((w, n) for w, n in counts.items() if n >= 2), key=repr)
    assert any(len(w) == 9 and w.startswith("voc") for w, _ in got)


def test_no_words_give_no_variants(spark):
    docs = make(spark, [(1, None), (2, "short words")])
    got = spelling.variants(spelling.vocabulary(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0
    assert spelling.variants(spelling.vocabulary(make(spark, []))).count() == 0


# --- ranked search -------------------------------------------------------------------------------------------------


def ranked(docs, items, most=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))

    held = [Counter(terms(t)) for _, t in docs]
    size = [sum(c.values()) for c in held]
    n_docs, n_words = sum(s > 0 for s in size), sum(size)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), counts, n in zip(docs, held, size):
            if not n:
                continue
            m, score = 10 + (90 * n * n_docs) // n_words, 0
            for t in set(terms(text)) & set(counts):
                df = sum(t in c for c in held)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += weight * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort()
        out += [(item_id, k + 1, doc_id, -score) for k, (score, _, _, doc_id) in enumerate(scored[:most])]
    return sorted(out, key=repr)


def corpus(seed, n_docs=70, n_items=25):
    rnd = random.Random(seed)
    names = [f"t{k}" for k in range(40)] + ["Été", "the", "THE", "of"]
    odds = [1 / (k + 1) for k in range(len(names))]
    docs = [(i, " ".join(rnd.choices(names, odds, k=rnd.choice([1, 3, 30, 200])))) for i in range(n_docs)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (901, None), (902, "... !"), (903, docs[6][1])]
    items = [(i, " ".join(rnd.choices(names, odds, k=rnd.choice([1, 4, 25])))) for i in range(n_items)]
    items += [(3, items[4][1]), (None, "t1, t2"), (77, None), (78, ""), (79, "unknown"), (80, "of the")]
    return docs, items


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {"most_items": 4}), (3, {"most_terms": 9})])
def test_rank_equals_brute_force(spark, seed, limits):
    docs, items = corpus(seed)
    wide = make(spark, docs).withColumn("n", F.lit(1)).withColumn("item_id", F.lit(1)).repartition(5)
    asked = make(spark, items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert rows(ranking.rank(wide, asked, **limits)) == ranked(docs, items)


def test_rank_in_narrow_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "CELLS", 1)
    docs, items = corpus(4, 30, 10)
    got = ranking.rank(make(spark, docs), make(spark, items, "item_id long, text string"), most=3)
    assert rows(got) == ranked(docs, items, 3)


def test_rank_without_rows(spark):
    docs, items = make(spark, [(1, "a b")]), make(spark, [], "item_id long, text string")
    assert ranking.rank(docs, items).count() == 0
    assert ranking.rank(make(spark, []), make(spark, [(1, "a")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_shared_sums_equal_plain_sums(seed):
    rnd = random.Random(seed)
    items = [sorted(rnd.sample(range(30), rnd.randrange(0, 20))) for _ in range(40)] + [[], list(range(30))]
    graph = ranking.Sharing(items, 30)
    parts = np.random.RandomState(seed).randint(0, 1000, size=(30, 6))
    assert np.array_equal(graph.scores(parts), np.array([parts[t].sum(axis=0) for t in items]))
    shared, plain = graph.additions()
    assert shared < plain
