"""Near-duplicates, components, repeats and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import rows

from tidemark.llm import components, decontamination, near_dedup, repeats, words


def make(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


# --- words ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind, pattern", [("blank_fold", rb"[^\x20\x09-\x0D]+"), ("letters", rb"[0-9a-z\x80-\xff]+")])
def test_word_hashes_tell_words_apart(kind, pattern, monkeypatch):
    monkeypatch.setattr(words, "SLICE", 37)
    texts = [b"", b"One two\tTHREE one", b" \x0b", "été-Été a,b\x00c\x1cd".encode(), b"x" * 200 + b" y", b"one"]
    hashes, at = words.word_hashes(texts, kind)
    want = [re.findall(pattern, t.lower()) for t in texts]
    assert [int(b - a) for a, b in zip(at, at[1:])] == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (hashes[i] == hashes[j]) == (a == b)


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(200, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components.components(make(spark, links, "a long, b long"))
    assert rows(got, "node", "root") == sorted(((x, find(x)) for x in list(parent)), key=repr)
    assert components.components(make(spark, [], "a long, b long")).count() == 0


# --- near duplicates -----------------------------------------------------------------------------------------------


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(width))))


def groups_of(data, width):
    """(doc_id, n, component, kept) per row, by all pairs."""
    sets = [shingles(t, width) for _, t in data]
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if label[j] == label[i] and data[j][0] is not None]
        component = doc_id if not sets[i] else min(ids) if ids else None
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def near_copies(seed, n=60, base=8, length=60):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(3)) for _ in range(80)]
    bases = [[rnd.choice(vocabulary) for _ in range(length)] for _ in range(base)]
    data = []
    for i in range(n):
        text = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, 5)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        data.append((i * 3, " ".join(text)))
    return data


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "Word"), (904, "word"), (905, "word two"), (903, "Word"), (None, "word two"), (None, "alone here now"), (None, None)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, width):
    data = near_copies(width) + EDGES
    docs = make(spark, [(i, t, 1, "x") for i, t in data], "doc_id long, text string, mark int, node string")
    got = near_dedup.near_duplicates(docs, width)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == groups_of(data, width)


def test_large_buckets_and_bundles_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 200)
    data = near_copies(9, n=80, base=2)
    got = near_dedup.near_duplicates(make(spark, data), 2)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == groups_of(data, 2)


def test_one_of_each_group_stays(spark):
    data = near_copies(5) + EDGES
    docs = make(spark, [(t, i, True) for i, t in data], "text string, doc_id long, kept boolean")
    got = near_dedup.one_of_each(docs, 2)
    assert got.columns == ["text", "doc_id", "kept"]
    left = [(r.doc_id, r.text) for r in got.collect()]
    wordless = [x for x in data if not shingles(x[1], 2)]
    assert sorted((x for x in left if not shingles(x[1], 2)), key=repr) == sorted(wordless, key=repr)
    components_ = {c for _, n, c, _ in groups_of(data, 2) if n}
    kept_full = [x for x in left if shingles(x[1], 2)]
    # One row per component, under the id of the component; (None, ...) groups without any id count once each.
    assert len({x[0] for x in kept_full if x[0] is not None}) == len([x for x in kept_full if x[0] is not None])
    assert {x[0] for x in kept_full} == components_


def test_no_documents(spark):
    empty = make(spark, [])
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.one_of_each(empty).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    items = make(spark, [], "item_id long, text string")
    assert decontamination.leaks(empty, items).count() == 0
    assert decontamination.without_leaks(make(spark, [(1, "a b c d e f")]), items).count() == 1


def test_signature_estimate():
    rnd = np.random.RandomState(1)
    a = np.sort(rnd.randint(0, 1 << 62, 900, dtype=np.int64).astype(np.uint64))
    b = np.sort(np.concatenate((a[:800], rnd.randint(0, 1 << 62, 100, dtype=np.int64).astype(np.uint64))))
    least = near_dedup.minima([a, b])
    sig = near_dedup.packed((least >> np.uint64(20)) & np.uint64(3)).view(np.uint64)
    agree = near_dedup.agreements(sig[0], sig[1:])
    assert abs(near_dedup.estimate(agree)[0] - 0.8) < 0.2
    assert near_dedup.agreements(sig[0], sig[:1])[0] == near_dedup.HASHES


# --- repeats -------------------------------------------------------------------------------------------------------


def cut(data, length=50):
    """(doc_id, bytes, removed, spans, digest) per row, by a table of all strings."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in data]
    for i, x in texts:
        if i is not None:
            for k in range(len(x) - length + 1):
                s = x[k : k + length]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        if i is not None:
            for k in range(len(x) - length + 1):
                if least[x[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    rnd = random.Random(seed)

    def noise(n):
        return "".join(rnd.choice("abcde é") for _ in range(n))

    shared = [noise(n) for n in (49, 50, 51, 80, 300)]
    data = []
    for i in range(40):
        parts = [noise(rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(0, 4)):
            parts += [rnd.choice(shared), noise(rnd.randrange(0, 60))]
        data.append((rnd.randrange(0, 1000), "".join(parts)))
    long = noise(3000)
    return data + [
        (5, "a" * 400), (2000, "a" * 120 + "b" + "a" * 49), (2001, "ab" * 90), (2002, "ab" * 40), (2003, None), (2004, ""),
        (2005, "\x00" * 130), (2006, "x" + "\x00" * 70), (None, "a" * 200), (None, shared[4]), (2007, shared[3]), (2007, shared[3]),
        (2008, long), (2009, long[:1500] + "!" + long[1500:]), (2010, long), (1, shared[4][:60]),
    ]


@pytest.mark.parametrize("hot", [512, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PACK_BYTES", 2000)
    monkeypatch.setattr(repeats, "WINDOWS", 700)
    data = passages(hot)
    docs = make(spark, [(t, i, 1) for i, t in data], "text string, doc_id long, pack int")
    assert rows(repeats.remove_repeats(docs)) == cut(data)


def test_a_text_that_every_pack_has_keeps_its_regions(spark, monkeypatch):
    # Many packs have its anchors, but one region of each: no window of it needs a key of its own.
    monkeypatch.setattr(repeats, "HOT", 100)
    monkeypatch.setattr(repeats, "PACK_BYTES", 2000)

    def never(*_):
        raise AssertionError("windows were asked for one by one")

    monkeypatch.setattr(repeats, "windows_of", never)
    rnd = random.Random(11)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(200))
    docs = make(spark, [(text, i, 1) for i in range(600)], "text string, doc_id long, pack int")
    got = rows(repeats.remove_repeats(docs))
    assert sorted((i, n, m) for i, n, m, *_ in got) == [(i, 200, 200 if i else 0) for i in range(600)]


def test_regions_of_a_period_have_codes_of_their_own():
    texts = [(b"i" + b" in" * 20)[:53], (b"n" + b" in" * 20)[:50]]
    ends = np.cumsum([len(t) for t in texts])
    codes = repeats.region_codes(np.frombuffer(b"".join(texts), dtype=np.uint8), np.append(0, ends[:-1]), ends)
    assert codes[0] != codes[1]


def test_anchors_are_dealt_evenly():
    rnd = np.random.default_rng(5)
    raw = rnd.integers(97, 123, 200_000).astype(np.uint8)
    runs = repeats.window_runs(raw, np.array([0, len(raw)]))
    code, _, place = repeats.pack_anchors(runs, np.array([1]), np.array([True]))
    dealt = np.bincount(repeats.part_of(code, 50), minlength=50)
    assert dealt.min() > 0 and dealt.max() < 1.5 * dealt.mean()
    assert (code[place] == repeats.spread(runs[3])).all()


def test_packs_know_the_bucket_of_the_writer(spark):
    from pyspark.sql import functions as F

    numbers = [0, 1, 7, (3 << 32) + 5, (900 << 32) + 123_456, -1, -(1 << 40)]
    found = spark.createDataFrame([(n,) for n in numbers], "pack long").select("pack", F.expr("pmod(hash(pack), 37)")).collect()
    assert repeats.bucket_of(np.array([r[0] for r in found]), 37).tolist() == [r[1] for r in found]


def test_merged_transforms_are_the_sorted_suffixes():
    rnd = random.Random(3)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(50, 90))).encode() for _ in range(12)]
    docs = np.array([rnd.randrange(100) for _ in strings])
    want = {}
    for s, d in zip(strings, docs):
        for k in range(len(s) - 49):
            want[s[k : k + 50]] = min(d, want.get(s[k : k + 50], d))
    for shards in (1, 3, 50):
        for s, got in zip(strings, repeats.least_documents(strings, docs, shards)):
            assert got.tolist() == [want[s[k : k + 50]] for k in range(len(s) - 49)]


# --- decontamination -----------------------------------------------------------------------------------------------


def leaked(docs, items, width=5):
    def toks(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for doc_id, text in docs:
        w = toks(text)
        for item_id, item in items:
            v = toks(item)
            k = min(width, len(v))
            if not k:
                continue
            own = set(zip(*(v[j:] for j in range(k))))
            shared = len(own & set(zip(*(w[j:] for j in range(k)))))
            if shared and 100 * shared >= 80 * len(own):
                out.append((doc_id, -1 if item_id is None else item_id, len(own), shared))
    return sorted(out, key=repr)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]

    def text(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    items = [(k, " ".join(text(n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 20, 30, 45, 60])]
    items += [(50, None), (51, ""), (None, " ".join(text(25))), (7, " ".join(text(33))), (7, items[6][1])]
    docs = []
    for i in range(120):
        body = text(rnd.choice([0, 3, 40, 700, 5000]))
        if rnd.random() < 0.7:
            piece = (rnd.choice(items)[1] or "").split()
            if len(piece) > 12 and rnd.random() < 0.5:
                piece[rnd.randrange(len(piece))] = "zz"
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.upper() + rnd.choice(["", ",", "\n"]) for w in piece]
        docs.append((i % 110, " ".join(body)))
    docs += [(500, None), (None, items[8][1]), (501, "")]
    frame = make(spark, [(1, i, t) for i, t in docs], "item_id int, doc_id long, text string")
    tests = make(spark, items, "item_id long, text string")
    want = leaked(docs, items)
    for most in (20_000, 4):
        got = decontamination.leaks(frame, tests, most=most)
        assert rows(got, "doc_id", "item_id", "n_item", "n_shared") == want
    bad = {x[0] for x in want}
    clean = decontamination.without_leaks(frame, tests, most=4)
    assert clean.columns == frame.columns
    per_row = [(i, t) for i, t in docs if not leaked([(i, t)], items)]
    assert rows(clean, "doc_id", "text") == sorted(per_row, key=repr)
    assert bad
