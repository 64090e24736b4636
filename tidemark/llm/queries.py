"""Registered queries of the corpus operators, with the SQL that they must equal where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language_id, licenses, mixing, near_dedup, quality, ranking, repeats, set_join
from . import sharding, spelling, warc
from .frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


@query(decontamination.SQL)
def op1_decontamination(spark, folder):
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op2_sharding(spark, folder):
    return sharding.shard_documents(table(spark, folder, "documents"))


@query(near_dedup.SQL)
def op3_near_dedup(spark, folder):
    groups = near_dedup.near_duplicates(table(spark, folder, "documents"), width=2)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


@query(mixing.sql())
def op4_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query(warc.SQL)
def op5_warc(spark, folder):
    return warc.archived(table(spark, folder, "pages"))


@query()
def op6_html_text(spark, folder):
    return html_text.main_texts(table(spark, folder, "pages"))


@query()
def op7_quality_rules(spark, folder):
    docs = quality.assess(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return docs.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance",
    )


@query()
def op8_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query()
def op9_suffix_dedup(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents"))


@query()
def op10_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs)
    named = language_id.identify(docs.select("doc_id", "text"), model)
    remainder = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4))
    return named.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query(set_join.SQL)
def op11_set_join(spark, folder):
    return set_join.set_join(table(spark, folder, "documents"), width=3, part=90)


@query(spelling.SQL)
def op12_spelling_variants(spark, folder):
    words = spelling.vocabulary(table(spark, folder, "documents"), drop_one_in=31)
    return spelling.variants(words)


@query(ranking.SQL)
def op13_ranked_search(spark, folder):
    return ranking.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
