"""Language identification, quality rules, license scans, page text and archives."""

import gzip
import json
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from conftest import rows

from tidemark.llm import html_text, language_id, licenses, quality, warc


def brute_sql(data, columns, sql, name="documents"):
    db = duckdb.connect()
    db.execute(f"CREATE TABLE {name} ({columns})")
    if data:
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(data[0]))})", data)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    return names, sorted((tuple(r) for r in result.fetchall()), key=repr)


TEXTS = [
    (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "a b c a b c"), (5, "x x x x x x"), (6, "line\nline\n\n\nline \nline"),
    (7, "été #1 $5 | <b> & *"), (8, "\r\nA\r\nA\r\n"), (9, "a\x0bb\x0cc \x1c d e"), (3, "one"), (None, "two words"),
    (10, "w" * 5000 + " " + "w" * 5000), (11, "to be or not to be or not to be"),
]


def test_quality_counts_equal_sql(spark):
    docs = spark.createDataFrame([(i, t, "en", 7) for i, t in TEXTS if i is not None], "doc_id long, text string, lang string, n_words int")
    got = quality.assess(docs.dropDuplicates(["doc_id"]))
    data = sorted({(i, t) for i, t in TEXTS if i is not None}, key=repr)
    names, want = brute_sql(data, "doc_id BIGINT, text VARCHAR", quality.SQL_COUNTS)
    got = got.drop("n_words").withColumnRenamed("n_words_", "n_words")
    assert rows(got, *names) == want


def test_quality_verdict(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    plain = docs.where("length(text) > 1200").limit(1).collect()[0]
    junk = " ".join("qx%%z$$k" + str(i) for i in range(300))
    extra = spark.createDataFrame(
        [(-1, None, plain.text), (-2, "en", junk), (-3, "en", "short text"), (-4, "en", None), (-5, "en", "same words here " * 40)], docs.schema
    )
    got = {r.doc_id: r for r in quality.assess(docs.union(extra)).where("doc_id < 0").collect()}
    assert [got[-k].kept for k in range(1, 6)] == [got[-1].kept, False, False, False, False]
    assert not got[-1].base_failed and not got[-2].base_failed
    assert got[-3].base_failed and got[-4].base_failed and got[-5].base_failed
    assert got[-2].char_distance > quality.FAR_CHARS
    assert quality.assess(docs.limit(0)).count() == 0
    assert quality.references(docs.limit(0)) == {}


def test_quality_keeps_good_documents(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    got = quality.assess(docs).join(labels, "doc_id")
    assert got.where("quality = 1 and not base_failed and not kept").count() == 0


def test_letters_without_common_words_are_turned_down(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    refs = quality.references(docs)
    rnd = random.Random(4)
    plain = " ".join(r.text for r in docs.where("lang = 'en' and length(text) > 1200").limit(20).collect())
    junk = [" ".join("".join(rnd.choices(re.sub("[^a-z]", "", plain.lower()), k=rnd.randrange(7, 12))) for _ in range(300)) for _ in range(5)]
    extra = spark.createDataFrame([(-k, "en", t) for k, t in enumerate(junk, 1)], docs.schema)
    for r in quality.assess(extra, refs).collect():
        assert not r.base_failed and r.char_distance < quality.FAR_CHARS and not r.kept
    for _, _, shares, limit in refs.values():
        nothing = np.append(np.zeros(len(shares) - 1), 1.0)
        assert limit < quality.distance(nothing, shares)


def test_common_words_may_be_long(spark):
    rnd = random.Random(5)
    often = ["notwithstanding", "hereinafter", "aforementioned"]
    text = " ".join(rnd.choice(often) if k % 3 else f"w{rnd.randrange(10**9)}" for k in range(600))
    refs = quality.references(spark.createDataFrame([(1, "x", text)], "doc_id long, lang string, text string"))
    assert 1 - refs["x"][2][-1] > 0.6
    assert quality.word_limit(np.array([0.01, 0.99])) == np.inf


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]]), np.array([0.5, 0.5, 0.0])
    assert np.allclose(quality.distance(p, q), [0, 1])


# --- licenses ------------------------------------------------------------------------------------------------------

LICENSED = [
    (0, None), (1, ""), (2, "Released under the MIT License."), (3, "under THE mit-license, under the mit license"),
    (4, "apache\nlicense version 2.0"), (5, "CC BY-NC 4.0 and apache license, version 2"), (6, "cc by"), (7, "under the mité license"),
    (8, "no words about it"), (2, "Released under the MIT License."), (9, "cc by nc cc by nc"), (None, "cc by nc"),
    (10, "filler " * 400 + "under the mit license"), (11, "..."), (12, "xcc by nc"),
]


def test_license_places_equal_sql(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in LICENSED], "doc_id long, text string, key string")
    got = licenses.scan(docs)
    data = sorted({(i, t) for i, t in LICENSED if i is not None}, key=repr)
    names, want = brute_sql(data, "doc_id BIGINT, text VARCHAR", licenses.SQL_BASE)
    assert sorted(set(rows(got.where("doc_id is not null"), *names)), key=repr) == want
    assert got.count() == len(LICENSED)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_notices_with_small_changes_are_found(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    changed = bsd.replace("binary forms", "compiled binary forms").replace("provided that", "provided")
    data = [(1, f"Some text. {bsd}:"), (2, f"Some text. {changed}"), (3, "redistribution and use of gravel"), (4, " ".join("gravel" if k % 4 == 3 else w for k, w in enumerate(bsd.split())))]
    got = {r.doc_id: (r.labels, r.base_labels, r.n_base, r.first_word) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1] == ("bsd", "", 0, None) and got[2] == ("bsd", "", 0, None)
    assert got[3] == ("", "", 0, None) and got[4] == ("", "", 0, None)


def test_like_licenses_are_told_apart(spark):
    grant = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cc = "This work is licensed under a Creative Commons {} International License."
    bsd = "Redistribution and use in source and binary forms, with or without any such kind of modification of it are permitted provided that the following conditions are met"
    data = {
        cc.format("Attribution 4.0"): "cc-by", cc.format("Attribution-ShareAlike 4.0"): "cc-by-sa",
        cc.format("Attribution-Share Alike 4.0"): "cc-by-sa", cc.format("Attribution-NoDerivatives 4.0"): "cc-by-nd",
        cc.format("Attribution-NonCommercial 4.0"): "cc-by-nc", cc.format("Attribution-NonCommercial-ShareAlike 4.0"): "cc-by-nc-sa",
        cc.format("Attribution-ShareAlike 4.0") + " Text. " + cc.format("Attribution 4.0"): "cc-by,cc-by-sa",
        grant.format("General Public License", "2"): "gpl-2", grant.format("General Public License", "3"): "gpl-3",
        grant.format("Affero General Public License", "3").replace("program", "library"): "agpl-3",
        grant.format("Lesser General Public License", "2.1").replace("program", "library"): "lgpl",
        "This work is licensed under the GNU General Public License.": "gpl",
        "This is free and unencumbered software released into the public domain.": "unlicense", bsd: "bsd",
    }
    frame = spark.createDataFrame([(k, text) for k, text in enumerate(data)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(frame).collect()}
    assert [got[k] for k in range(len(data))] == list(data.values())


def test_alignment_equals_plain_recursion():
    rnd = random.Random(8)
    for _ in range(60):
        own = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 7))]
        words = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randrange(0, 12))]
        best = 0
        score = {}
        for i in range(len(words) + 1):
            for j in range(len(own) + 1):
                ways = [0]
                if i and j:
                    ways.append(score[i - 1, j - 1] + (1 if words[i - 1] == own[j - 1] else -1))
                if i:
                    ways.append(score[i - 1, j] - 1)
                if j:
                    ways.append(score[i, j - 1] - 1)
                score[i, j] = max(ways)
                best = max(best, score[i, j])
        matches, other, first, end = licenses.aligned(words, own)
        assert end - first == matches + other and matches >= best and (matches > 0) == (best > 0)


# --- languages -----------------------------------------------------------------------------------------------------


def test_automaton_gives_longest_matches():
    rnd = random.Random(2)
    sample = [rnd.randrange(2, 5) for _ in range(300)]
    symbols = 7
    table = language_id.automaton(sample, symbols)
    known = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
    for _ in range(20):
        text = [rnd.randrange(2, 5) for _ in range(rnd.randrange(1, 400))]
        count, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and tuple(text[at : end + 1]) in known:
                end += 1
            count, at = count + 1, end
        codes = np.array(text, dtype=np.uint8)
        matrix = np.full((language_id.LANE, 1), symbols - 1, dtype=np.uint8)
        matrix[: len(codes), 0] = codes
        assert language_id.phrases(matrix, table, symbols)[0] == count


def test_a_letter_that_the_sample_lacks_is_a_phrase():
    rnd = random.Random(2)
    sample = [rnd.randrange(2, 5) for _ in range(300)]
    symbols = 7
    table = language_id.automaton(sample, symbols)
    known = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
    for text in [[5], [2, 3, 5, 4], [5, 5, 2], *([rnd.randrange(2, 6) for _ in range(rnd.randrange(1, 400))] for _ in range(20))]:
        count, at = 0, 0
        while at < len(text):
            end = at + 1
            while end < len(text) and tuple(text[at : end + 1]) in known:
                end += 1
            count, at = count + 1, end
        matrix = np.full((language_id.LANE, 1), symbols - 1, dtype=np.int32)
        matrix[: len(text), 0] = text
        assert language_id.phrases(matrix, table, symbols)[0] == count


def test_every_letter_of_the_samples_has_a_symbol(spark):
    rnd = random.Random(3)
    blocks = {"la": "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "cy": "".join(map(chr, range(0x430, 0x460)))}
    blocks |= {"h1": "".join(map(chr, range(0x4E00, 0x4F00))), "h2": "".join(map(chr, range(0x4F00, 0x5000)))}
    blocks |= {"ha": "".join(map(chr, range(0xAC00, 0xAD00))), "uk": blocks["cy"][:32] + "ґєії", "ru": blocks["cy"][:32] + "ёъыэ"}
    words = {n: ["".join(rnd.choices(b, k=4)) for _ in range(150)] for n, b in blocks.items()}
    words["uk"] = [w[:3] + rnd.choice("ґєії") for w in words["cy"]]
    words["ru"] = [w[:3] + rnd.choice("ёъыэ") for w in words["cy"]]
    data = [(k, n, " ".join(rnd.choices(words[n], k=300))) for k, n in enumerate(sorted(words) * 30)]
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string")
    model = language_id.fit(docs)
    letters = {x for _, _, t in data for x in t if x.isalpha()}
    assert len({int(model["table"][ord(x)]) for x in letters}) > 0.95 * len(letters) > 600
    got = language_id.identify(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and all(r.lang == r.lang_pred for r in held)


def test_a_rare_letter_takes_no_form_of_a_frequent_one():
    table = language_id.symbol_table(["i", "s", "ı", "ſ"])
    assert [int(table[ord(x)]) - language_id.FIRST for x in "iIsSıſ"] == [0, 0, 1, 1, 2, 3]


def test_lanes_hold_every_symbol(monkeypatch):
    monkeypatch.setattr(language_id, "LANE", 8)
    table = language_id.symbol_table(list("abc"))
    texts = ["", "abc  cab", "!!", "a" * 30, "1 2"]
    codes, counts = language_id.encode(texts, table)
    matrix, owner = language_id.lanes(codes, counts, 9)
    assert matrix.shape[0] == 8 and (matrix != 9).sum() == len(codes) == counts.sum()
    assert [int(((matrix != 9) * (owner == k)).sum()) for k in range(5)] == counts.tolist()


@pytest.mark.parametrize("kind", ["mixed", "one letter", "period", "lacking"])
def test_lanes_count_as_one_parse(monkeypatch, kind):
    rnd = random.Random(4)
    monkeypatch.setattr(language_id, "LANE", 8)
    sample = {"one letter": [2] * 3, "period": [2, 3, 2, 4] * 3}.get(kind) or [rnd.randrange(2, 5) for _ in range(200)]
    symbols = 7
    table = language_id.automaton(sample, symbols)
    known = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
    texts = []
    for _ in range(40):
        n = rnd.choice([0, 1, 7, 8, 9, 16, 17, rnd.randrange(300)])
        if kind == "one letter":
            texts.append([2] * n)
        elif kind == "period":
            texts.append(([2, 3, 2, 4] * n)[:n])
        else:
            texts.append([rnd.randrange(2, 6 if kind == "lacking" else 5) for _ in range(n)])
    want = []
    for text in texts:
        count, at = 0, 0
        while at < len(text):
            stop = at + 1
            while stop < len(text) and tuple(text[at : stop + 1]) in known:
                stop += 1
            count, at = count + 1, stop
        want.append(count)
    codes, counts = np.array(sum(texts, []), dtype=np.int32), np.array([len(t) for t in texts])
    matrix, owner = language_id.lanes(codes, counts, symbols - 1)
    follows = np.concatenate(([False], owner[1:] == owner[:-1]))
    got = np.bincount(owner, weights=language_id.phrases(matrix, table, symbols, follows), minlength=len(texts))
    assert got.tolist() == want


def test_a_long_text_of_one_letter_takes_linear_time():
    import time

    model = {"symbols": 4, "table": language_id.symbol_table(["a"]), "models": [("x", language_id.automaton([2] * 3, 4), 3)]}
    begin = time.time()
    assert language_id.classify(["a" * 1_500_000], model)[0] == ["x"]
    assert time.time() - begin < 10


def test_language_identification(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es"} and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    edge = [(1, None), (2, ""), (3, " 12 %$ \n"), (None, "the and of the"), (1, None), (4, "中文"), (5, "the " * 20_000)]
    extra = spark.createDataFrame([(i, t, "z", 0.5) for i, t in edge], "doc_id long, text string, lang_pred string, score double")
    out = language_id.identify(extra, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "lang_pred_", "score_"]
    named = [(r.doc_id, r.lang_pred_, r.score_) for r in out.collect()]
    assert [x[1] for x in named[:3]] == ["und"] * 3 and [x[2] for x in named[:3]] == [0.0] * 3
    assert named[4][1] == "und" and named[3][1] != "und" and named[5][1] != "und" and named[6][1] == "en"
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs.limit(5), nothing).collect()} == {"und"}


# --- pages ---------------------------------------------------------------------------------------------------------

PROSE = "Plain words of a long enough sentence that belongs to the story of the page and goes on for a while."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T words</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>{body}</body></html>"


def labelled():
    menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">item {k}</a></li>' for k in range(6)) + "</ul></nav>"
    return [page(f'{menu}<div class="ad">Buy it now</div><article><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></article><footer>bottom</footer>') for _ in range(20)]


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<nav><a>one</a></nav><article><h1>A &amp; B</h1><p>{PROSE}\n  more&nbsp;here</p></article><footer>x</footer>", f"A & B\n{PROSE} more here"),
        (f"<div id='sidebar'>{PROSE}</div><article><p>{PROSE}<p>Second<br>line</article>", f"{PROSE}\nSecond line"),
        (f"<article><p>{PROSE}</p><form><label>Name</label><input></form><div class='comments'><p>{PROSE}</p></div><p>End.</p></article>", f"{PROSE}\nEnd."),
        (f"<header><p>site name</p></header><main><p>{PROSE}</p><aside>{PROSE}</aside><p>Last &#233;&lt;</p></main>", f"{PROSE}\nLast é<"),
        (f"<!-- {PROSE} --><article><p>{PROSE}</p><script>{PROSE}</script></article>", PROSE),
        ("", ""),
    ],
)
def test_main_text(body, want):
    weights = html_text.fit_weights(labelled())
    assert html_text.extract(page(body), weights) == want


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div id='page' class='has-sidebar'><p>{PROSE}</p></div>", PROSE),
        (f"<article class='post category-alerts'><p>{PROSE}</p></article>", PROSE),
        (f"<article class='comments'><p>{PROSE}</p></article>", PROSE),
        (f"<main class='content no-sidebar'><p>{PROSE}</p></main>", PROSE),
        (f"<div class='widget'><p>{PROSE}</p><article><p>{PROSE}</p></article></div>", f"{PROSE}\n{PROSE}"),
        (f"<form><input><main><p>{PROSE}</p></main></form>", PROSE),
        (f"<nav><a>one</a><article><p>{PROSE}</p></article>", PROSE),
        (f"<article><p>One</p><div data-id='ad' title='class=ad id=ad'><p>{PROSE}</p></div></article>", f"One\n{PROSE}"),
        (f"<article><p>One</p><div><div class='ad'>Buy it now</div><p>{PROSE}</p></article>", f"One\n{PROSE}"),
        (f"<article><section><div class='ad'>Buy it now</section><p>{PROSE}</p></article>", PROSE),
        (f"<article><datalist><option value=a><option>b</datalist><p>{PROSE}</p></article><select><option>c</option></select>", PROSE),
        (f"<article><p>One</p><svg width='1'/><p>{PROSE}</p></article><svg><text>x</text></svg>", f"One\n{PROSE}"),
        (f"<article><div><a class='ad'><div>Buy</a></div></div><p>{PROSE}</p></article>", PROSE),
        (f"<article><p>{PROSE}</p><div><div><ul><li><a>one</a></li></ul></div></div><div><div><a>two</a></div></div>", PROSE),
        (f"<article><div><script>var a = 1;</div><p>{PROSE}</p></article>", PROSE),
        ("<article>" + "".join(f"<table><tr><td><ul><li><div><section><p>Short {k}</section></div></ul></table>" for k in range(9)) + "</article>", "\n".join(f"Short {k}" for k in range(9))),
    ],
)
def test_wrappers_and_open_elements_lose_no_article_text(body, want):
    weights = html_text.fit_weights(labelled())
    assert html_text.extract(page(body), weights) == want


def test_layout_class_of_body_loses_nothing():
    got = html_text.extract(page(f"<p>{PROSE}</p>").replace("<body>", "<body class='sidebar right-sidebar'>"), html_text.fit_weights(labelled()))
    assert got == PROSE


def strange():
    """Labelled pages whose class names tell nothing."""
    menu = "<div class='q1'>" + "".join(f"<b>item {k}</b> " for k in range(6)) + "</div>"
    return [page(f"<div id='z9'>{menu}<article><h1>Title</h1><p class='t'>{PROSE}</p><p>{PROSE}</p></article><div class='c-7f k2'><p>{PROSE}</p></div></div>") for _ in range(20)]


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div class='q1'>one two</div><p>{PROSE}</p><div class='c-7f'><p>{PROSE}</p><p>{PROSE}</p></div>", PROSE),
        (f"<section id='k2'>{PROSE}</section><div id='z9'><p class='t'>{PROSE}</p></div>", PROSE),
        (f"<div class='c-7f'><article><p>{PROSE}</p></article></div>", PROSE),
        (f"<article><p>{PROSE}</p><div class='k2'>kept</div><div class='ads'>{PROSE}</div><p>End</p></article>", f"{PROSE}\nkept\nEnd"),
        (f"<div><p>{PROSE}</p><div class='k2'>{PROSE * 20}</div><p>{PROSE * 3}</p></div>", f"{PROSE}\n{PROSE * 3}"),
        (f"<div class='k2'>{PROSE}</div>", ""),
    ],
)
def test_unknown_names_are_learned(body, want):
    assert html_text.extract(page(body), html_text.fit_weights(strange())) == want


def test_names_seen_in_articles_lose_nothing():
    seen = [page(f"<div class='box'>{PROSE}</div><article><div class='box'>{PROSE}</div></article>") for _ in range(9)]
    weights = html_text.fit_weights(seen)
    assert weights[".box"] == 0 and weights[".ads"] == -html_text.PRIOR
    assert html_text.extract(page(f"<div class='box'>{PROSE}</div>"), weights) == PROSE


def test_results_come_from_the_weights(folder):
    import pandas as pd

    pages = pd.read_parquet(f"{folder}/pages.parquet").html.dropna().tolist()
    weights = html_text.fit_weights(pages[:100])
    zero = dict.fromkeys(weights, 0.0)
    assert sum(html_text.extract(p, weights) != html_text.extract(p, zero) for p in pages) > 0.9 * len(pages)


def test_best_part_equals_all_parts():
    rnd = random.Random(6)
    for _ in range(400):
        scores = [(float(rnd.randint(-3, 5)), float(rnd.randint(-6, 1))) for _ in range(rnd.randint(0, 9))]
        sums = {
            (i, j): sum(own for own, _ in scores[i:j]) + sum(parting for _, parting in scores[i + 1 : j])
            for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)
        }
        best = max([0.0, *sums.values()])
        begin, end = html_text.best_part(scores)
        assert sums.get((begin, end), 0.0) == best
        if best > 0:
            assert (end, -begin) == min((j, -i) for (i, j), total in sums.items() if total == best)


def test_pages(spark):
    data = [(k, f"u{k}", h) for k, h in enumerate(labelled())] + [(90, None, None), (91, "u", ""), (92, "u", "<p>"), (90, None, None), (None, "u", "just words"), (93, "u", "<article " + "x" * 50_000)]
    pages = spark.createDataFrame([(*r, "t") for r in data], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.main_texts(pages).collect()}
    assert got[0].text == f"Title\n{PROSE}\n{PROSE}" and got[0].n_chars == len(got[0].text)
    assert [got[k].text for k in (90, 91, 92)] == ["", "", ""] and got[None].text == "just words"
    assert html_text.main_texts(pages).count() == len(data)
    assert html_text.main_texts(pages.limit(0)).count() == 0


# --- archives ------------------------------------------------------------------------------------------------------

LARGE = "<p>" + "payload " * 40 + "</p>"
PAGES = [
    (1, "http://a/", LARGE), (2, "http://b/\r\nX-Page-Id: 7", LARGE), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
    (7, "u", "é" * 60), (0, "u", "é" * 60), (None, "u", LARGE), (8, "u", "x\r\n\r\nWARC/1.1\r\n" * 30), (9, "u", "y" * 200_000),
]


def test_archives_equal_sql_and_can_be_entered_at_every_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 1000)
    pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string").coalesce(2)
    files = warc.write_archives(pages, f"{tmp_path}/streams")
    assert files.count() > 2
    for file in rows(files, "file"):
        with open(f"{tmp_path}/streams/{file[0]}", "rb") as f:
            inflate = zlib.decompressobj(31)
            assert inflate.decompress(f.read()).startswith(b"WARC/1.1") and inflate.eof and not inflate.unused_data
    index = warc.normalise(files, f"{tmp_path}/streams", f"{tmp_path}/members")
    assert index.count() == len(PAGES)
    for r in index.collect():
        with open(f"{tmp_path}/members/{r.file}", "rb") as f:
            f.seek(r.offset)
            raw = gzip.decompress(f.read(r.length))
        assert raw.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {r.record_type}".encode() in raw
    for file in {r.file for r in index.collect()}:
        listed = [json.loads(x) for x in open(f"{tmp_path}/members/{file}.index")]
        assert sorted(x["offset"] for x in listed) == sorted(r.offset for r in index.collect() if r.file == file)
        assert os.path.getsize(f"{tmp_path}/members/{file}") == sum(x["length"] for x in listed)
    got = warc.read_records(index, f"{tmp_path}/members")
    names, want = brute_sql([p for p in PAGES if p[0] is not None], "page_id BIGINT, url VARCHAR, html VARCHAR", warc.SQL, "pages")
    assert rows(got.where("page_id is not null"), *names) == want
    unnamed = got.where("page_id is null").collect()
    assert [(r.record_type, r.refers_to) for r in unnamed] == [("revisit", 1)]


def test_repeated_pages_and_none(spark, tmp_path):
    pages = spark.createDataFrame([(4, "u", LARGE), (4, "u", LARGE), (4, "v", LARGE), (6, "u", LARGE)], "page_id long, url string, html string")
    got = rows(warc.archived(pages, str(tmp_path / "a")), "page_id", "record_type", "refers_to")
    assert got == [(4, "response", None), (4, "revisit", 4), (4, "revisit", 4), (6, "revisit", 4)]
    assert warc.archived(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_archives_with_members_are_accepted_and_torn_ones_not():
    one = warc.record(1, "u", b"abc", "d", None, False)
    import io

    members = io.BytesIO(gzip.compress(one) + gzip.compress(one * 2))
    assert len(list(warc.records(warc.inflated(members)))) == 3
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(gzip.compress(one)[:-9]))))
    with pytest.raises(ValueError):
        list(warc.records([one[:-6]]))
    with pytest.raises(ValueError):
        list(warc.records([b"no archive\r\n\r\n"]))
    assert re.match(rb"WARC/1.1\r\nWARC-Type: response", one)


@pytest.mark.parametrize("tail", ["", "'>", '">', ">"])
@pytest.mark.parametrize("bit", ["<a ", '<a "', "<a '", "<a ''", "<!", "<?", "<a \"'", "<a b=\"'\" "])
def test_unclosed_tags_take_linear_time(bit, tail):
    import time

    begin = time.time()
    html_text.extract(f"<p>some words</p>{bit * 40_000}{tail}", {})
    assert time.time() - begin < 5


def test_markup_equals_one_pattern():
    import random

    whole = re.compile(
        r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*>|<\?[^>]*>"
        r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
    )
    rnd = random.Random(1)
    pieces = ["<", "a", ">", '"', "'", "!--", "-->", "<![CDATA[", "]]>", "<!", "<?", " ", "/", "</b", "<i x=", "=", "-"]
    for _ in range(20_000):
        page = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14)))
        want = [(m.start(), m.end(), m.group(2) or "", m.group(3) or "") for m in whole.finditer(page)]
        markup, at, got = html_text.Markup(page), 0, []
        while (found := markup.next(at)) is not None:
            at = found[1]
            got.append((*found[:2], *found[4:]))
        assert got == want
