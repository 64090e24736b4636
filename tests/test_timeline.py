import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.plans import labels, matrix, timeline
from tidemark.plans.entity import entity_frame, experience
from tidemark.plans.static import age_thresholds, mean_round_gap, static_labels
from tidemark.sources.schemas import SOURCE_SCHEMAS


def day(n):
    return datetime.date(2010, 1, 1) + datetime.timedelta(n)


def company(id, founded, category="web", status="operating", closed=None):
    return (id, id.upper(), None, category, status, founded, "company", closed, None, None, None, None, None, None)


@pytest.fixture(scope="module")
def src(spark):
    data = {
        "objects": [
            company("c:1", day(0)),
            company("c:2", day(10), closed=day(400), status="closed"),
            company("c:3", None),
            company("c:4", day(5), category=None),
            ("p:1", "Ann", None, None, None, None, "Person", None, None, None, None, None, None, None),
        ],
        "funding_rounds": [
            (1, "c:1", "angel", "seed", day(30), 100.0, 2),
            (2, "c:1", "venture", "a", day(60), None, 3),
            (3, "c:1", "venture", "a", day(60), 50.0, 3),
            (4, "c:2", "venture", "a", day(5), 70.0, 1),
            (5, "c:2", "venture", "b", day(20), 30.0, 1),
            (6, "c:3", "venture", "b", day(20), 30.0, 1),
            (7, "c:4", "venture", "b", None, 30.0, 1),
        ],
        "investments": [(1, "c:2"), (1, "f:1"), (7, "c:1")],
        "acquisitions": [(1, "c:2", "c:1", day(200), "cash", 9.0), (2, None, "c:1", day(100), "cash", None)],
        "ipos": [(1, "c:1", day(300))],
        "milestones": [(1, "c:1", day(-5)), (2, "c:1", day(40))],
        "offices": [(1, "c:1", None, 2.0, "HQ"), (2, "c:1", 1.0, 3.0, "branch")],
        "relationships": [
            ("p:1", "c:1", day(-100), "Co-Founder"),
            ("p:1", "c:2", day(500), "Board Member"),
            ("p:2", "c:2", day(50), "founder"),
            ("p:3", "c:1", day(-900), "Engineer"),
            ("p:2", "c:4", day(300), "Director"),
        ],
    }
    return {name: spark.createDataFrame(data[name], schema) for name, schema in SOURCE_SCHEMAS.items()}


@pytest.fixture(scope="module")
def entity(src):
    return entity_frame(src["objects"], src["offices"], src["relationships"], "founder|board|director")


def test_entity_keeps_companies_with_leaders(entity):
    got = {r["id"]: r for r in entity.collect()}
    assert set(got) == {"c:1", "c:2", "c:4"}
    # first known value per column, not the first row
    assert (got["c:1"]["latitude"], got["c:1"]["longitude"], got["c:1"]["offices"]) == (1.0, 2.0, 2)
    # p:1 started at c:1 100 days before it, and that start counts for c:2 as well; p:2 gives a negative value there
    assert got["c:1"]["experience"] == 100
    assert got["c:2"]["experience"] == 110
    # only negative experience: zero when filled, NULL in the raw sum
    assert got["c:4"]["experience"] == 0


def test_experience_without_known_value_is_null(src):
    found = experience(src["objects"].filter("founded_at IS NOT NULL"), src["relationships"], "director")
    assert rows(found, "id", "experience") == [("c:4", None)]


def test_timeline_rows(src, entity):
    got = {
        (r["id"], r["event_id"], r["seq"]): r for r in timeline.event_timeline(src, entity).collect()
    }
    # c:3 has no founding date, c:4 no dated round
    assert {k[0] for k in got} == {"c:1", "c:2"}
    # before the founding: dropped
    assert ("c:2", "funded", 4) not in got and ("c:1", "milestone", 1) not in got
    # ... but only after numbering and running sums
    assert got["c:2", "funded", 5]["event_count"] == 2
    assert got["c:2", "funded", 5]["famt_cumsum"] == 100.0
    assert got["c:2", "funded", 5]["time_diff"] == 15
    assert got["c:1", "milestone", 2]["event_count"] == 2
    # a round without amount has no running sum and the next one carries on
    assert got["c:1", "funded", 2]["famt_cumsum"] is None
    assert got["c:1", "funded", 3]["famt_cumsum"] == 150.0
    assert got["c:1", "funded", 3]["time_diff"] == 0
    # the first gap counts from the founding; one acquired row at the first date
    assert got["c:1", "funded", 1]["time_diff"] == 30
    assert got["c:1", "acquired", 0]["time_to_event"] == 100
    assert got["c:2", "investment", 1]["iamt"] == 100.0
    assert got["c:2", "acquisition", 1]["aamt"] == 9.0
    assert got["c:2", "closed", 0]["time_to_event"] == 390


def test_split_groups_give_the_same_timeline(src, entity):
    names = ["id", "event_id", "seq", "famt_cumsum", "event_count", "time_diff", "time_to_event"]
    plain = rows(timeline.event_timeline(src, entity), *names)
    assert rows(timeline.event_timeline(src, entity, limit=1), *names) == plain


def test_mean_round_gap(src):
    # c:1: 30, then 30 (rounds without amount do not count); c:2: -5 dropped, 15
    got = rows(mean_round_gap(src["objects"], src["funding_rounds"]), "id", "mean_round_gap")
    assert got == [("c:1", 30.0), ("c:2", 15.0)]


def test_trajectory(src, entity):
    points = rows(timeline.trajectory_points(timeline.event_timeline(src, entity)).filter("id = 'c:2'"), "seq", "years", "amount")
    assert points == [(-1, 0.0, 0.0), (5, 10 / 365, 100.0)]
    path = timeline.funding_trajectory(src["objects"], src["funding_rounds"])
    assert rows(path.filter("id = 'c:1'"), "funding_round_id", "fund_idx", "time_to_funding") == [(1, 0, 30), (3, 1, 60)]


def _events(spark, data):
    return spark.createDataFrame(data, "id string, event_id string, time_to_event int")


def test_labels(spark):
    entity = spark.createDataFrame(
        [(i, c) for i, c in [("e", "web"), ("l", "web"), ("both", "web"), ("old", "web"), ("new", "web"),
                             ("n", None), ("x", "bio"), ("none", "web")]],
        "id string, category_code string",
    )
    events = _events(spark, [
        ("e", "acquired", 10), ("l", "public", 40), ("both", "acquired", 5), ("both", "public", 60),
        ("old", "funded", 30), ("new", "funded", 3), ("n", "acquired", 7), ("x", "funded", 999),
    ])
    assert rows(labels.exit_thresholds(events, entity)) == [("web", 25.0)]
    got = dict(rows(labels.outcome_labels(events, entity), "id", "label"))
    assert got == {
        "e": 0, "l": 1,
        "both": 1,            # late outweighs early
        "old": 2, "new": 3,
        "n": 3, "x": 3,       # no category, or one without exits
        "none": 3,
    }


def test_static_labels(spark):
    frame = spark.createDataFrame(
        [("a", "web", "operating", 100), ("b", "web", "operating", 1), ("c", "web", "acquired", 1000),
         ("d", "web", "closed", 5), ("e", "bio", "operating", 50), ("f", "web", "ipo", 2)],
        "id string, category_code string, status string, age_at_exit int",
    )
    got = dict(rows(static_labels(frame, deviations=0), "id", "label"))
    # a category of one has no deviation, hence no threshold and no label
    assert got == {"a": 3, "b": 3, "c": 1, "d": 0, "e": None, "f": 1}
    assert dict(rows(age_thresholds(frame)))["bio"] is None


def _random_timeline(spark):
    import random

    draw = random.Random(5)
    out = []
    for i in range(40):
        seen = {}
        times = sorted(draw.randint(0, 60) for _ in range(draw.randint(0, 14)))
        cumulative = 0.0
        for t in times:
            kind = draw.choice(["funded", "milestone", "investment", "acquisition", "closed"])
            seen[kind] = seen.get(kind, 0) + 1
            amount = float(draw.randint(1, 99)) if kind == "funded" and draw.random() < 0.8 else None
            cumulative += amount or 0
            out.append((f"c{i}", kind, t, draw.randint(0, 20), seen[kind], amount, cumulative if amount else None))
    return spark.createDataFrame(
        out, "id string, event_id string, time_to_event int, time_diff int, event_count long, famt double, famt_cumsum double"
    )


def test_states_equal_a_rebuild_at_every_cut(spark):
    events = _random_timeline(spark)
    for limit in (None, 4):
        states = matrix.states(events, limit=limit).cache()
        for cut in (0, 1, 17, 30, 61):
            want = matrix.event_features(events.filter(F.col("time_to_event") < cut))
            at = states.filter((F.col("day") < cut) & (F.col("next_day").isNull() | (F.col("next_day") >= cut)))
            names = ["id", *matrix.DYNAMIC]

            def shown(df):
                return rows(df.select("id", *[F.round(c, 6).alias(c) for c in matrix.DYNAMIC]), *names)

            assert shown(at) == shown(want)


def test_asof_matrix_members(spark):
    events = _random_timeline(spark)
    ids = [f"c{i}" for i in range(40)]
    entity = spark.createDataFrame(
        [(i, 1.0, 2.0, 1, 1, 5, "web") for i in ids],
        "id string, latitude double, longitude double, offices long, products long, experience long, category_code string",
    )
    label = spark.createDataFrame([(i, 3 if n % 4 == 0 else n % 3) for n, i in enumerate(ids)], "id string, label int")
    cuts = matrix.cut_ages(events, label)
    got = matrix.asof_matrix(events, entity, label, cuts, ["web"]).cache()
    days = sorted({r["cut"] for r in cuts.collect()})
    assert got.filter("NOT is_query").count() == len(days) * 30
    assert rows(got.filter("is_query"), "id", "cut") == rows(cuts, "id", "cut")
    # scaled inside the cut
    spread = got.groupBy("cut").agg(F.avg("funded_events").alias("m"), F.stddev_pop("funded_events").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and (abs(r["s"] - 1) < 1e-9 or r["s"] == 0) for r in spread)
    totals = {r["cut"]: r["events"] for r in matrix.asof_totals(events, cuts).collect()}
    for cut in days:
        assert totals[cut] == events.filter(F.col("time_to_event") < cut).count()


def test_category_named_like_a_feature(spark):
    events = _random_timeline(spark)
    entity = spark.createDataFrame(
        [(f"c{i}", 1.0, 2.0, i, 1, 5, "offices" if i % 2 else None) for i in range(40)],
        "id string, latitude double, longitude double, offices long, products long, experience long, category_code string",
    )
    got = matrix.feature_matrix(events, entity, ["offices"])
    assert got.columns == ["id", *matrix.NUMERIC, "category_offices"]
    assert got.agg(F.sum("category_offices")).first()[0] == 20
    assert got.agg(F.stddev_pop("offices")).first()[0] == pytest.approx(1)


def test_cuts_round_up(spark):
    events = _events(spark, [("a", "funded", 7), ("b", "funded", 10)])
    label = spark.createDataFrame([("a", 3), ("b", 3)], "id string, label int")
    assert rows(matrix.cut_ages(events, label, 5), "id", "cut") == [("a", 10), ("b", 10)]


def test_reports_use_the_models_of_the_predictions(spark, folder, monkeypatch):
    from tidemark.checks import modelling, reports
    from tidemark.plans import predict

    # The cut stands for the model: equal cuts make equal predictions.
    monkeypatch.setattr(predict, "predict_unlabelled", lambda asof, *_: {"predictions": asof.where("is_query").select("id", "cut")})
    want = rows(modelling.rf_predictions(spark, folder), "id", "cut")
    assert rows(reports._model_predictions(spark, folder)[3], "id", "cut") == want and want
