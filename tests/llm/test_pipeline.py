"""Mixing, sharding, the pipeline and the registered queries."""

import hashlib
import os
import random
import sys
import zlib

import duckdb
import numpy as np
import pytest
from conftest import rows

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from tidemark.llm import bitmaps, decontamination, mixing, near_dedup, queries, sharding  # noqa: E402
from tidemark.session import freeze  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def views(folder):
    db = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    return db


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, folder, name):
    from tools.verify import normal

    frame = queries.QUERIES[name](spark, folder)
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    result = views(folder).execute(queries.SQL[name])
    assert got == normal([d[0] for d in result.description], result.fetchall())


# --- mixing --------------------------------------------------------------------------------------------------------


def mixed_sql(data):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    if data:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
    return sorted((tuple(r) for r in db.execute(mixing.sql()).fetchall()), key=repr)


MIXED = [(k, f"s{k % 4}" if k % 9 else None, "w " * (k * k % 37)) for k in range(150)] + [
    (500, "s1", None), (501, "s2", ""), (502, "é", "one two"), (503, "\U0001f600", "x " * 30), (504, "empty", " "),
    (None, "s0", "a b"), (505, "s3", "long " * 900),
]


def test_mix_equals_sql_with_gaps_and_names(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in MIXED], "doc_id long, source string, text string, mix int, size int")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "source", "text", "mix", "size", "mix_"]
    got = rows(got, "doc_id", "mix_.size", "mix_.source_size", "mix_.target", "mix_.taken")
    want = mixed_sql(MIXED)
    assert [(a[0], a[1], a[2], round(a[3], 6), a[4]) for a in got] == [(a[0], a[1], a[2], round(a[3], 6), a[4]) for a in want]


def test_mix_comes_near_its_targets(spark):
    data = [(k, "big" if k % 3 else f"s{k % 7}", "w " * (1 + k * 7 % 50)) for k in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    mixed = mixing.mix(docs)
    by = mixed.groupBy("source").agg({"mix.taken": "sum", "mix.target": "max"}).toDF("source", "a", "b").collect()
    for r in by:
        taken, target = sorted((r.a, r.b)) if abs(r.a - r.b) > 60 else (r.a, r.b)
        assert abs(taken - target) <= 60
    total = mixed.agg({"mix.target": "max"}).first()[0]
    assert total > 0 and mixed.where("mix.copies > 2").count() == 0
    again = mixing.mix(docs.repartition(5))
    assert rows(again, "doc_id", "mix.taken") == rows(mixed, "doc_id", "mix.taken")
    assert mixing.mixed(docs).count() == mixed.agg({"mix.copies": "sum"}).first()[0]


def test_mix_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    same = spark.createDataFrame([(1, "a", "x y")] * 6 + [(2, "a", None)], "doc_id long, source string, text string")
    got = mixing.mix(same).select("doc_id", "mix.copies").distinct()
    assert got.count() == 2


@pytest.mark.parametrize("long_at", [0, 5, -1])
def test_a_long_text_leaves_no_wide_gap(spark, long_at):
    """900 words are wanted of a source with one text of 600 words and ten of 40, wherever the hash puts the long one."""
    by_hash = sorted(range(100, 111), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    data = [(i, "b", "w " * (600 if i == by_hash[long_at] else 40)) for i in by_hash]
    data += [(i, "a", "w " * 200) for i in range(3)] + [(i, "c", "w " * 200) for i in range(10, 13)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    mixing.mix(docs).select("doc_id", "source", "mix.*").toPandas().to_parquet(path := f"/tmp/mix-{os.getpid()}.parquet")
    # knows nothing of rounds: what is taken, and the smallest text that is not
    told = duckdb.sql(f"""SELECT source, any_value(target), sum(taken), min(size) FILTER (WHERE taken < size * ceil(target / source_size))
      FROM '{path}' GROUP BY source""").fetchall()
    os.remove(path)
    for source, target, taken, least in told:
        assert taken <= target and (least is None or target - taken < least), (source, target, taken, least)
        assert source != "b" or taken == 880


def test_gaps_of_many_long_texts_equal_sql(spark):
    rnd = random.Random(12)
    data = []
    for k in range(14):
        sizes = [rnd.choice([3, 40, 300, 900, 2000]) for _ in range(rnd.randrange(1, 14))]
        data += [(1000 * k + i, f"s{k}", "w " * n) for i, n in enumerate(sizes)]
    data += [data[5], (9, None, "w " * 700), (8, None, "w " * 50), (7, "s1", None)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = rows(mixing.mix(docs), "doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")
    want = mixed_sql(data)
    assert [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in want]


# --- sharding ------------------------------------------------------------------------------------------------------


def check_shards(data, got, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in data if i is not None
    )
    assert len(got) == len(data) and {r.law for r in got} <= {"bytes"} and all(r.grown_shard is None for r in got)
    for s in {r.shard for r in got}:
        assert 0 <= s < shards and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_are_even_and_groups_stay_together(spark):
    data = [(k, f"text {k % 700} " + "b" * (k % 700 * 3)) for k in range(2000)] + [(5000 + k, "hot copy") for k in range(1000)]
    data += [(9000, None), (9001, ""), (9000, None), (None, "no id")]
    docs = spark.createDataFrame([(t, i, 3) for i, t in data], "text string, doc_id long, shard int")
    got = sharding.shard_documents(docs, shards=6).collect()
    check_shards(data, got, 6)
    load = [sum(r.size for r in got if r.shard == s) for s in range(6)]
    count = [sum(r.shard == s for r in got) for s in range(6)]
    assert max(load) < 1.03 * sum(load) / 6 and max(count) < 1.1 * len(got) / 6
    where = {}
    for r in got:
        if r.text_crc32 not in (zlib.crc32(b"hot copy"), 0):
            where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    # Light groups are whole; the hot one is spread.
    assert all(len(s) == 1 for (crc, size), s in where.items() if size < 300)
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot copy")}) > 1


def test_few_and_no_documents(spark):
    data = [(1, "a"), (2, "bb")]
    got = sharding.shard_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    check_shards(data, got, 24)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_follows_the_dot_product():
    loads = np.array([[9.0, 1, 1], [1, 9, 1], [9, 1, 1], [1, 9, 1]])
    shard = sharding.pack(loads, 2)
    assert sorted(shard) == [0, 0, 1, 1] and shard[0] != shard[2] and shard[1] != shard[3]


def test_bitmap_finds_its_keys(spark):
    keys = spark.createDataFrame([(k * 7919 - 50_000,) for k in range(300)], "k long")
    bits = bitmaps.bitmap(keys, "k")
    assert int(np.unpackbits(bits).sum()) == 300
    both = keys.union(spark.createDataFrame([(3,), (4,)], "k long"))
    assert bitmaps.rows_with_bit(both, "k", bits).count() == 300
    assert bitmaps.rows_with_bit(both, "k", bits, False).count() == 2


# --- the pipeline --------------------------------------------------------------------------------------------------


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(10**6, None, "en", "src1", 0), (10**6 + 1, "12 34", None, None, 5), (10**6 + 2, "", "en", "src1", 0)]
    docs = freeze(docs.union(spark.createDataFrame(extra, docs.schema)).union(docs.limit(2)))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)

    named = freeze(stage["language_id"](spark, docs, folder))
    assert named.columns == columns and named.count() == docs.count() - 3

    single = freeze(stage["near_dedup"](spark, named, folder))
    groups = near_dedup.near_duplicates(named, 5)
    assert single.columns == columns and single.count() == groups.select("component_id").distinct().count()
    assert near_dedup.near_duplicates(single, 5).where("not kept").count() == 0

    clean = freeze(stage["decontamination"](spark, single, folder))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    bad = {r.doc_id for r in decontamination.leaks(single, items).collect()}
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad

    mixed = freeze(stage["mixing"](spark, clean, folder))
    taken = {r.doc_id: r.copies for r in mixing.mix(clean).select("doc_id", "mix.copies").collect()}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == columns and counted == {k: v for k, v in taken.items() if v}

    sharded = stage["sharding"](spark, mixed, folder).collect()
    assert len(sharded) == mixed.count() and {r.doc_id for r in sharded} == set(counted)


def test_pipeline_of_nothing(spark, folder):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_pipeline_runs_whole(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 100
