import pytest
from conftest import rows

from tidemark import checks
from tidemark.operators.features import minus_minimum
from tidemark.plans import report
from tidemark.session import freeze
from tidemark.sources import tables
from tidemark.sources.schemas import SOURCE_SCHEMAS
from tidemark.sources.standin import TABLES, Sources


def test_csv_and_missing_numbers(spark, tmp_path):
    schema = "id string, x double, n int"
    path = str(tmp_path / "t")
    tables.write_csv(tables.inline_rows(spark, [("a", 1.5, 2), ("b", float("nan"), None)], schema), path)
    frame = tables.read_csv(spark, path, spark.createDataFrame([], schema).schema)
    assert rows(frame) == [("a", 1.5, 2), ("b", None, None)]


def test_frames_are_replaced(spark, tmp_path):
    folder = str(tmp_path)
    tables.write_frames({"a": spark.range(3), "b": spark.range(5)}, folder)
    tables.write_frames({"a": spark.range(2)}, folder)
    back = tables.read_frames(spark, folder, ["a", "b"])
    assert (back["a"].count(), back["b"].count()) == (2, 5)


def test_query_binds_parameters(spark):
    tables.register({"bound": spark.createDataFrame([("a'b", "2010-01-31"), ("c", None)], "name string, dates string")})
    got = tables.query(spark, "SELECT * FROM bound WHERE name = :name", dates=["dates"], name="a'b")
    assert str(got.first()["dates"]) == "2010-01-31"
    assert ("bound", "name", "string") in rows(tables.table_listing(spark))
    assert tables.first_rows(spark.range(5), 2).count() == 2


def test_freeze_reads_back_the_same_rows(spark):
    frame = spark.createDataFrame([(1, "a b", None), (2, None, 3.5)], "id int, `a b` string, x double")
    back = freeze(frame)
    assert rows(back) == rows(frame) and back.schema == frame.schema


def test_standin_tables_follow_the_schemas(spark, folder):
    source = Sources(spark, folder)
    for name in TABLES:
        want = {f.name: f.dataType for f in SOURCE_SCHEMAS[name]}
        assert {f.name: f.dataType for f in source[name].schema} == want, name


def test_minus_minimum(spark):
    frame = spark.createDataFrame([(3,), (5,)], "x int")
    assert rows(minus_minimum(frame, "x", "d")) == [(3, 0), (5, 2)]


def _entity(spark):
    return spark.createDataFrame(
        [("c:1", "Zed", "real_estate", "operating"), ("c:2", "Amy", "web", "ipo"), ("c:3", "amber", None, "acquired"),
         ("c:4", "Bob", "web", "closed"), ("c:0", "Amy", "web", "operating")],
        "id string, name string, category_code string, status string",
    )


def test_messages(spark):
    events = spark.sql(
        "SELECT 'c:2' AS id, 'public' AS event_id, date'2012-05-18' AS dates UNION ALL SELECT 'c:3', 'acquired', date'2011-01-02'"
    )
    labels = spark.createDataFrame([("c:2", 0), ("c:3", 1), ("c:1", 3), ("c:0", 2)], "id string, label int")
    predictions = spark.createDataFrame([("c:1", 1)], "id string, pred int")
    got = dict(rows(report.outcome_messages(_entity(spark), events, labels, predictions), "id", "message"))
    assert got == {
        "c:0": "Amy continues to operate.",
        "c:1": "Zed will exit, but in a long time.",
        "c:2": "Amy went public on 05/18/2012! Amy exited before the median age for its industry.",
        "c:3": "amber was acquired on 01/02/2011! amber exited after the median age for its industry.",
        "c:4": "Bob: Oops! It doesn't look like we have any information on that company.",
    }


def test_lookup_and_names(spark):
    entity = _entity(spark)
    assert rows(report.company_ids(entity, "Amy"), "id") == [("c:0",)]
    assert report.company_ids(entity, "nobody").count() == 0
    assert rows(report.name_suggestions(entity, "am"), "name") == [("Amy",), ("Amy",), ("amber",)]
    assert rows(report.names_json(entity, size=3), "list_no", "names") == [(0, '["Amy","Amy","Bob"]'), (1, '["Zed","amber"]')]


def test_named_importances(spark):
    data = [("m", "offices", 0.5), ("m", "category_web", 0.9), ("m", "products", 0.25), ("m", "latitude", 0.1)]
    got = report.named_importances(spark.createDataFrame(data, "model_key string, feature string, importance double"), 2)
    assert rows(got) == [("m", 1, "Number of Offices", "50.00%"), ("m", 2, "Products", "25.00%")]


def test_candidates_keep_their_order(spark):
    entity = spark.sql("SELECT id, name, category_code, date'2010-01-01' AS dates FROM VALUES ('a','A','web'),('b','B','real_estate'),('c','C',NULL) t(id, name, category_code)")
    events = spark.sql(
        "SELECT id, 'funded' AS event_id, d AS dates, amt AS famt_cumsum, 1 AS time_to_event FROM VALUES "
        "('a', date'2011-01-01', 1234.5D), ('b', date'2012-01-01', NULL), ('c', date'2010-01-01', 1D) t(id, d, amt)"
    )
    predictions = spark.createDataFrame([("a", 0, 0.2), ("b", 0, 0.9), ("c", 0, 0.99)], "id string, pred int, proba0 double")
    got = [(r["id"], r["category"], r["famt_str"], r["last_funded"]) for r in report.exit_candidates(predictions, entity, events).collect()]
    # c was last funded on its founding date and is left out
    assert got == [("b", "real estate", "-", "01/01/2012"), ("a", "web", "$1,234.50", "01/01/2011")]


def test_contract():
    checks.load()
    assert set(checks.SQL) <= set(checks.QUERIES) and len(checks.QUERIES) > 90


@pytest.mark.parametrize(
    "name", ["category_counts", "null_group_count", "dedupe_first", "event_timeline", "roc_auc", "km_by_group",
             "logrank", "concordance", "stratified_split", "grouped_median", "cosine_topk", "covariate_intervals"]
)
def test_query_equals_its_sql(spark, folder, name):
    import os

    import duckdb

    from tools.verify import normal

    checks.load()
    db = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    frame = checks.QUERIES[name](spark, folder)
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    result = db.execute(checks.SQL[name])
    assert got == normal([d[0] for d in result.description], result.fetchall())
