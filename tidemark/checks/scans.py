"""Sources and sinks: each query writes a whole table, reads it back and returns it."""

from pyspark.sql import functions as F

from ..session import frozen_path, tune
from ..sources import tables
from . import check
from .frames import entity, sources
from .standin_sql import BASE


def _file(spark, folder, name):
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


@check("""
SELECT c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS dates
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def sql_scan(spark, folder):
    tables.register({"scan_customer": _file(spark, folder, "customer"), "scan_orders": _file(spark, folder, "orders")})
    return tables.query(
        spark,
        "SELECT c_custkey, o_orderkey, o_orderdate AS dates FROM scan_customer "
        "JOIN scan_orders ON o_custkey = c_custkey WHERE c_mktsegment = :segment",
        dates=["dates"],
        segment="BUILDING",
    )


@check("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, folder):
    customer, path = _file(spark, folder, "customer"), frozen_path(spark)
    tables.write_csv(customer, path)
    return tables.read_csv(spark, path, customer.schema).withColumn(
        "c_nationkey", F.col("c_nationkey").cast("long")
    )


@check(BASE + "SELECT id, name, category_code, status, dates, CAST(experience AS BIGINT) AS experience FROM entity")
def feature_table_round_trip(spark, folder):
    path = frozen_path(spark)
    tables.write_frames({"entity": entity(sources(spark, folder))}, path)
    return tables.read_frames(spark, path, ["entity"])["entity"].select(
        "id", "name", "category_code", "status", "dates", "experience"
    )


@check("SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def first_rows(spark, folder):
    return tables.first_rows(_file(spark, folder, "orders").orderBy("o_orderkey"), 20)


# columns of the given tables with their types
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


@check(" UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type, COUNT(*) AS n_rows, COUNT({name}) AS n_known "
    f"FROM {table}"
    for table, columns in COLUMNS.items() for name, kind in (c.split() for c in columns.split(", "))
))
def table_listing(spark, folder):
    """Columns, types and counts of all given tables."""
    return tables.table_profile({name: _file(spark, folder, name) for name in COLUMNS})
