import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import evaluate, features, models, sampling, similar
from tidemark.operators.quantiles import box_statistics, exact_quantiles
from tidemark.operators.similar import nearest, neighbour_vote


def test_columns(spark):
    one = spark.sql(
        "SELECT date'2010-01-31' AS a, date'2013-12-12' AS b, 1.0D AS x, 0 AS z, CAST(NULL AS DOUBLE) AS n, 'Wet Paint' AS w"
    )
    got = one.select(
        c.whole_months("a", "b").alias("months"), c.days_between("a", "b").alias("days"),
        c.ratio("x", "z").alias("ratio"), c.smallest("n", "x").alias("least"),
        c.money_text("n").alias("none"), c.money_text(F.lit(1234.5)).alias("money"),
        c.percent_text(F.lit(0.123456)).alias("percent"), c.equals_text("w", "wet paint").alias("same"),
        c.matches("w", "PAINT").alias("found"), c.matches("w", "PAINT", ignore_case=False).alias("strict"),
        c.starts_with("w", "wet").alias("starts"), c.slash_date(F.lit("2013/12/12")).alias("slash"),
        c.date_text("b").alias("text"), c.spaced(F.lit("a_b")).alias("spaced"),
        c.display_names("w", {"Wet Paint": "wp"}).alias("shown"), c.not_negative(F.lit(-1)).alias("neg"),
    ).first()
    assert (got.months, got.days, got.ratio, got.least) == (46, 1411, None, 1.0)
    assert (got.none, got.money, got.percent) == ("-", "$1,234.50", "12.35%")
    assert got.same and got.found and not got.strict and got.starts
    assert (str(got.slash), got.text, got.spaced, got.shown, got.neg) == ("2013-12-12", "12/12/2013", "a b", "wp", None)


def test_count_true_is_null_without_values(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 2), ("b", None, 2)], "k string, x int, y int")
    got = df.groupBy("k").agg(c.count_true(F.col("x") < F.col("y")).alias("n"))
    assert rows(got, "k", "n") == [("a", 1), ("b", None)]


def _numbers(spark, n=500):
    draw = random.Random(11)
    data = [
        ("hot" if draw.random() < 0.7 else draw.choice(["a", None]), draw.gauss(0, 3) if draw.random() < 0.9 else None,
         float(draw.randint(0, 6)))
        for _ in range(n)
    ]
    return spark.createDataFrame(data, "k string, x double, y double"), data


@pytest.mark.parametrize("limit", [None, 40])
def test_exact_quantiles(spark, limit):
    df, data = _numbers(spark)
    for p in (0.5, 0.9):
        got = {r["k"]: (r["x"], r["y"]) for r in exact_quantiles(df, ["x", "y"], ["k"], p, limit).collect()}
        for key in ("hot", "a", None):
            for i in (1, 2):
                values = [r[i] for r in data if r[0] == key and r[i] is not None]
                assert got[key][i - 1] == pytest.approx(np.quantile(values, p))
    assert exact_quantiles(spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "x double"), ["x"]).first()[0] == 2.5


def test_box_statistics(spark):
    days = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([("a", d) for d in days], "k string, d int")
    got = box_statistics(df, "k", "d").first()
    assert (got.n, got.q1, got["median"], got.q3) == (9, 3.0, 5.0, 7.0)
    assert (got.low_whisker, got.high_whisker, got.outliers) == (1, 8, 1)


def test_fill_and_scale_is_impute_then_standardise(spark):
    df, _ = _numbers(spark)
    df = df.withColumns({"id": F.monotonically_increasing_id(), "none": F.lit(None).cast("double"), "same": F.lit(4.0)}).cache()
    names = ["x", "y", "none", "same"]

    def shown(frame):
        return rows(frame.select("id", *[F.round(n, 7).alias(n) for n in names]))

    for by in ([], ["k"]):
        assert shown(features.fill_and_scale(df, names, by)) == shown(features.standardise(features.impute(df, names, by), names, by))
    whole = features.fill_and_scale(df, names).agg(
        F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("none").alias("n"), F.max("same").alias("c")
    ).first()
    assert whole.m == pytest.approx(0, abs=1e-9) and whole.s == pytest.approx(1) and whole.n == 0.0 and whole.c == 0.0


def test_indicators_and_noise(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, None, 3), (3, "b", 1)], "id int, k string, label int")
    assert features.category_values(df, "k") == ["a", "b"]
    assert rows(features.one_hot(df, "k", ["a", "b"]), "id", "a", "b") == [(1, 1, 0), (2, 0, 0), (3, 0, 1)]
    known = features.known_label_indicators(df, "label", [0, 1], unknown=3)
    assert rows(known, "id", "is_0", "is_1") == [(1, 1, 0), (3, 0, 1)]
    noisy = features.noise_columns(spark.range(2000), 2, 7, "id").agg(F.stddev("noise_0"), F.corr("noise_0", "noise_1")).first()
    assert abs(noisy[0] - 1) < 0.1 and abs(noisy[1]) < 0.1


def _classes(spark):
    sizes = {0: 30, 1: 7, 2: 90}
    data = [(f"{label}-{i}", label, float(i)) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "id string, label int, x double"), sizes


def test_numbering_is_complete(spark):
    df, sizes = _classes(spark)
    got = sampling.numbered(df, ["label"], "id").collect()
    for label, n in sizes.items():
        assert sorted(r["number"] for r in got if r["label"] == label) == list(range(1, n + 1))


def test_upsample(spark):
    df, sizes = _classes(spark)
    got = sampling.upsample(df, "label", "id", 2, [0, 1]).collect()
    for label in sizes:
        drawn = [r for r in got if r["label"] == label]
        assert len(drawn) == 90
        assert all(r["id"].startswith(f"{label}-") for r in drawn)
    assert len({r["id"] for r in got if r["label"] == 2}) == 90


def test_upsample_of_a_tiny_class(spark, monkeypatch):
    df, _ = _classes(spark)
    one = df.filter("label = 2 OR id = '1-3'")
    plain = rows(sampling.upsample(one, "label", "id", 2, [0, 1]), "label", "id", "draw")
    assert [r[:2] for r in plain if r[0] == 1] == [(1, "1-3")] * 90
    # the draws do not depend on how many copies serve them
    monkeypatch.setattr(sampling, "_DRAWS_PER_COPY", 4)
    assert rows(sampling.upsample(one, "label", "id", 2, [0, 1]), "label", "id", "draw") == plain


def test_stratified_split_and_folds(spark):
    df, sizes = _classes(spark)
    got = sampling.stratified_split(df, "label", "id", 0.6).collect()
    assert len(got) == sum(sizes.values())
    for label, n in sizes.items():
        assert sum(r["is_train"] for r in got if r["label"] == label) == round(0.6 * n)
    folds = sampling.folds(df, "label", "id", 3).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["fold"]): r["count"] for r in folds}[2, 1] == 30
    assert sampling.sample_entities(df.unionByName(df), "id", 5).count() == 10


def _vectors(spark, n=120, dim=6):
    draw = np.random.default_rng(1)
    data = draw.normal(size=(n, dim)).round(3)
    data[7] = data[3]
    data[50] = -data[3]
    group = ["a" if draw.random() < 0.7 else "b" for _ in range(n)]
    frame = spark.createDataFrame(
        [(i, group[i], [float(v) for v in data[i]], i % 3) for i in range(n)],
        "id long, g string, vector array<double>, label int",
    )
    return frame, data, group


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("block,cells", [(11, 1), (1000, None), (15, 9)])
def test_nearest_against_brute_force(spark, metric, by, block, cells):
    frame, data, group = _vectors(spark)
    got = {}
    for r in nearest(frame, frame, 4, by=by, metric=metric, block_rows=block, cells=cells).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    for i in range(len(data)):
        near = []
        for j in range(len(data)):
            if i == j or (by and group[i] != group[j]):
                continue
            if metric == "cosine":
                s = abs(data[i] @ data[j] / np.linalg.norm(data[i]) / np.linalg.norm(data[j]))
            else:
                s = -np.linalg.norm(data[i] - data[j])
            near.append((round(s, 12), -j))
        best = sorted(near, reverse=True)[:4]
        assert [(-b[1], pytest.approx(b[0], abs=2e-6)) for b in best] == [(j, s) for _, j, s in sorted(got[i])]


def _near_brute(data, k, decimals=15):
    out = []
    for i in range(len(data)):
        near = [(round(-float(np.sqrt(((data[i] - data[j]) ** 2).sum())), decimals), -j) for j in range(len(data)) if j != i]
        out += [(i, -j, s) for s, j in sorted(near, reverse=True)[:k]]
    return sorted(out)


@pytest.mark.parametrize("cells", [1, 12])
def test_many_copies(spark, cells):
    draw = np.random.default_rng(6)
    data = draw.integers(0, 3, size=(150, 3)).astype(float)
    data[draw.random(150) < 0.5] = [1.0, 1.0, 1.0]
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "id long, vector array<double>")
    useful = similar._useful_copies(frame.select(F.col("id").alias("item_id"), F.col("vector").alias("_vector")), 4, [])
    assert useful.groupBy("_vector").count().agg(F.max("count")).first()[0] == 5
    assert "WindowGroupLimit" in useful._jdf.queryExecution().executedPlan().toString()
    got = nearest(frame, frame, 4, metric="euclid", block_rows=20, cells=cells)
    assert rows(got, "query_id", "item_id", "score") == sorted(_near_brute(data, 4), key=repr)


def _asked_share(data, k, metric, cells, block_rows):
    """Share of (vector, block) pairs that are compared when every vector asks all others."""
    class Cover:
        value = similar._cover(np.random.default_rng(1).permutation(data)[: similar.SAMPLE * cells], cells, metric)

    frame = pd.DataFrame({"_g": 0, "query_id": np.arange(len(data)), "_vector": list(data)})
    frame = next(similar._assigner(Cover, metric)([frame]))
    pivots = Cover.value[0]
    own = pivots[frame["_cell"]]
    exact = np.linalg.norm(data - own, axis=1) if metric == "euclid" else np.arccos(
        np.clip(similar._exact(data, own, metric), 0, 1)
    )
    assert (exact <= frame["_reach"] + 1e-6).all()
    blocks = frame.groupby("_cell", as_index=False).agg(_n=("_reach", "size"), _reach=("_reach", "max"))
    blocks["_first"] = (blocks["_n"].cumsum() - blocks["_n"]) // block_rows
    blocks["_parts"] = -(-blocks["_n"] // block_rows)
    asked = similar._asker(Cover, k, metric, "query_id")(frame.assign(_query=0), blocks)
    total = int((blocks["_first"] + blocks["_parts"]).max())
    return asked["_blocks"].map(len).sum() / len(data) / total


@pytest.mark.parametrize("width", [64, 256])
@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_clustered_vectors_meet_few_blocks(width, metric):
    draw = np.random.default_rng(width)
    centres = draw.normal(size=(100, width))
    data = centres[draw.integers(100, size=10_000)] + 0.1 * draw.normal(size=(10_000, width))
    assert _asked_share(data, 5, metric, cells=200, block_rows=500) < 0.2


def test_far_cells_are_left_out(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(12, 5)) * 100
    data = np.concatenate([c + draw.normal(size=(40, 5)) for c in centres])
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "id long, vector array<double>")

    assert _asked_share(data, 3, "euclid", cells=24, block_rows=40) < 0.2
    got = nearest(frame, frame, 3, metric="euclid", block_rows=40, cells=12)
    found = sorted((r["query_id"], r["item_id"], r["score"]) for r in got.collect())
    want = _near_brute(data, 3)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in want])


def test_large_values_and_copies(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 4)) * 1e6
    data = np.concatenate([c + draw.normal(size=(30, 4)) for c in centres])
    data[1::2] = data[::2]
    frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(data)], "id long, vector array<double>")
    want = []
    for i in range(len(data)):
        d = np.sqrt(((data - data[i]) ** 2).sum(1))
        order = sorted((d[j], j) for j in range(len(data)) if j != i)[:5]
        want += [(i, j, -s) for s, j in order]
    for cells, block in ((None, None), (7, 50), (40, 17)):
        got = nearest(frame, frame, 5, metric="euclid", cells=cells, block_rows=block)
        assert rows(got, "query_id", "item_id") == sorted(((i, j) for i, j, _ in want), key=repr)
        assert got.filter("rank = 1 AND score <> 0").count() == 0


def test_tasks_need_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); import numpy as np; print(f(np.ones((1, 2)), np.ones((1, 2)), 'cosine'))"
    done = subprocess.run(
        [sys.executable, "-c", code], input=cloudpickle.dumps(similar._exact), cwd=tmp_path, capture_output=True
    )
    assert done.stdout.strip() == b"[1.]", done.stderr


def test_exact_match_outvotes(spark):
    near = spark.createDataFrame(
        [(1, 10, 0.0), (1, 11, -0.1), (1, 12, -0.1), (2, 11, -0.5), (2, 10, -0.5)], "query_id long, item_id long, score double"
    )
    labels = spark.createDataFrame([(10, 0), (11, 1), (12, 1)], "id long, label int")
    assert rows(neighbour_vote(near, labels), "query_id", "prediction") == [(1, 0), (2, 0)]


def _scored(spark):
    draw = random.Random(2)
    data = [(i, draw.randint(0, 2), draw.randint(0, 2), round(draw.random(), 1)) for i in range(300)]
    return spark.createDataFrame(data, "id int, label int, pred int, score double")


def test_report_agrees_with_library(spark):
    df = _scored(spark)
    report = {r["cls"]: r for r in evaluate.class_report(df, "label", "pred").collect()}
    as_double = df.select(F.col("label").cast("double").alias("label"), F.col("pred").cast("double").alias("prediction"))
    for metric, column in (("weightedPrecision", "precision"), ("weightedRecall", "recall"), ("f1", "f1")):
        want = MulticlassClassificationEvaluator(metricName=metric).evaluate(as_double)
        assert report["total"][column] == pytest.approx(want)
    assert report["macro"]["f1"] == pytest.approx(np.mean([report[str(k)]["f1"] for k in range(3)]))
    assert models.MacroF1().evaluate(as_double) == pytest.approx(report["macro"]["f1"])


def test_class_never_predicted_scores_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    got = {r["cls"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.class_scores(df, "label", "pred").collect()}
    assert got[1] == (0.0, 0.0, 0.0) and got[0] == (0.5, 1.0, pytest.approx(2 / 3))


@pytest.mark.parametrize("limit", [None, 3])
def test_roc_agrees_with_library(spark, limit):
    df = _scored(spark).withColumn("positive", F.col("label") == 1)
    curve = evaluate.roc_curve(df, "score", "positive", limit=limit)
    points = sorted((r["fpr"], r["tpr"]) for r in curve.collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert all(b[1] >= a[1] for a, b in zip(points, points[1:]))
    library = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", numBins=0).evaluate(
        df.select(array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("raw"), F.col("positive").cast("double").alias("y"))
    )
    assert evaluate.roc_auc(curve).first()["auc"] == pytest.approx(library)


@pytest.mark.parametrize("limit", [None, 3])
def test_interpolation(spark, limit):
    knots = [(0, 0.0, 0.0), (0, 0.0, 0.3), (0, 0.5, 0.4), (0, 0.5, 0.8), (0, 1.0, 1.0)]
    curve = spark.createDataFrame(knots, "c int, fpr double, tpr double")
    grid = spark.createDataFrame([(0, x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "c int, fpr double")
    got = rows(evaluate.interpolate(curve, grid, ["c"], limit), "fpr", "tpr")
    want = np.interp([0, 0.25, 0.5, 0.75, 1], [k[1] for k in knots], [k[2] for k in knots])
    assert [v for _, v in got] == pytest.approx(list(want))


def test_search_report_shares_ranks(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.9), (4, 0.1)], "candidate int, score double")
    assert rows(evaluate.search_report(df, "score", 3), "candidate", "rank") == [(1, 1), (2, 3), (3, 1)]


def test_knn_search_and_candidates(spark):
    frame, _, _ = _vectors(spark)
    got = models.knn_search(frame, [1, 3]).collect()
    assert {(r["size"], r["weights"]) for r in got} == {(s, w) for s in (1, 3) for w in ("uniform", "distance")}
    assert all(0 <= r["score"] <= 1 for r in got)
    one = {r["weights"]: r["score"] for r in got if r["size"] == 1}
    assert one["uniform"] == one["distance"]
    tried = models.random_candidates(20, 16)
    assert all(1 <= t["max_features"] < 8 and 2 <= t["min_split"] <= 50 for t in tried)


def test_votes_of_all_sizes_without_a_row_per_size(spark):
    draw = random.Random(12)
    data = []
    for q in range(40):
        near = [(r + 1, -float(draw.randrange(3)), draw.choice([0, 1, 2, None])) for r in range(draw.choice([1, 4, 9]))]
        data.append((q % 3, draw.choice([0, 1, None]), *[[n[i] for n in near] for i in range(3)]))
    schema = "fold int, truth int, rank array<int>, score array<double>, label array<int>"
    sizes = [1, 3, 4, 12]
    cells = spark.createDataFrame(data, schema).repartition(3).mapInArrow(
        models._ballots(sizes), "fold int, size int, weights string, truth int, vote int, n long"
    )
    got = {tuple(r)[:5]: r[5] for r in cells.groupBy("fold", "size", "weights", "truth", "vote").agg(F.sum("n")).collect()}
    want = {}
    for fold, truth, rank, score, label in data:
        for size in sizes:
            sums = {}
            for r, s, c in zip(rank, score, label):
                if r <= size:
                    old = sums.get(c, (0, 0, 0.0))
                    sums[c] = (old[0] + 1, old[1] + (s == 0), old[2] + (-1 / s if s else 0.0))
            order = sorted(sums, key=lambda c: (c is None, c or 0))
            for weights, vote in (
                ("uniform", max(order, key=lambda c: sums[c][0])), ("distance", max(order, key=lambda c: sums[c][1:])),
            ):
                cell = (fold, size, weights, truth, vote)
                want[cell] = want.get(cell, 0) + 1
    assert got == want


def test_forests_of_a_search_remember_nodes_and_read_in_few_tasks(spark, monkeypatch):
    seen = {}

    class Watched(models.CrossValidator):
        def _fit(self, dataset):
            seen["tasks"], seen["maps"] = dataset.rdd.getNumPartitions(), self.getEstimatorParamMaps()
            return super()._fit(dataset)

    monkeypatch.setattr(models, "CrossValidator", Watched)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 60, raising=False)
    data = [(i, i % 2, float(i % 7), float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(data, "id int, label int, x double, y double")
    settings = [{"max_depth": d, "max_features": 1, "min_split": 4, "criterion": "gini"} for d in (3, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = models.random_search(df, ["x", "y"], "id", settings, k=2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 2 and seen["tasks"] == 2
    kept = [{p.name: v for p, v in m.items()}.get("cacheNodeIds") for m in seen["maps"]]
    assert kept == [False, True]


def test_score_of_a_candidate_is_the_mean_over_its_classes(spark):
    draw = random.Random(3)
    data = [(draw.randrange(3), float(draw.choice([0, 1, 4]))) for _ in range(60)]
    df = spark.createDataFrame(data, "label int, prediction double")
    want = evaluate.macro_scores(evaluate.class_scores(df.withColumn("label", F.col("label").cast("double")), "label", "prediction"))
    assert models.MacroF1().evaluate(df) == pytest.approx(want.first()["f1"], abs=1e-12)
    assert models.MacroF1().evaluate(df.limit(0)) is None


def test_forest(spark):
    draw = np.random.default_rng(4)
    data = [(i, int(x > 0), float(x), float(y)) for i, (x, y) in enumerate(draw.normal(size=(200, 2)))]
    df = spark.createDataFrame(data, "id int, label int, x double, y double").cache()
    model = models.forest(["x", "y"]).fit(df)
    got = models.predict(model, df, ["id", "label"], 3).collect()
    assert np.mean([r["pred"] == r["label"] for r in got]) > 0.95
    assert all(abs(r["proba0"] + r["proba1"] + r["proba2"] - 1) < 1e-9 for r in got)
    weight = dict(rows(models.importances(model, ["x", "y"], "m", spark), "feature", "importance"))
    assert weight["x"] > weight["y"]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "id long, x double, label int, vector array<double>")
    assert features.fill_and_scale(empty, ["x"]).count() == 0
    assert features.impute(empty, ["x"]).count() == 0
    assert sampling.upsample(empty, "label", "id", 2, [0, 1]).count() == 0
    assert sampling.stratified_split(empty, "label", "id", 0.5).count() == 0
    assert nearest(empty, empty, 3).count() == 0


@pytest.mark.parametrize("near, limit, p", [(1, 7, 0.5), (3, None, 0.9), (50, None, 1.0)])
def test_exact_quantiles_whatever_the_first_look_gives(spark, near, limit, p):
    rnd = random.Random(near)
    data = [
        (rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, float(rnd.randrange(6)), rnd.gauss(0, 1)]), float(i % 400) if i % 3 else None)
        for i in range(3000)
    ] + [("c", None, None), ("d", None, 4.0), ("e", float("inf"), -0.0)]
    df = spark.createDataFrame(data, "k string, x double, y double").repartition(5)
    got = {r["k"]: (r["x"], r["y"]) for r in exact_quantiles(df, ["x", "y"], ["k"], p, limit, near).collect()}
    for k in {d[0] for d in data} - {"c"}:
        for i in (1, 2):
            own = sorted(d[i] for d in data if d[0] == k and d[i] is not None)
            place = p * (len(own) - 1)
            low, high = int(place), min(int(place) + (place > int(place)), len(own) - 1)
            want = own[low] + (own[high] - own[low]) * (place - low) if own and low != high else (own[low] if own else None)
            assert got[k][i - 1] == (None if want is None else pytest.approx(want))


def test_quantiles_shuffle_only_values_near_the_rank(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").cast("double").alias("x"))
    plan = exact_quantiles(df, ["x"], ["k"], limit=None)._jdf.queryExecution().toString()
    assert "explode(array_compact" in plan
    ends = df.groupBy("k").agg(F.percentile_approx("x", F.array(F.lit(0.498), F.lit(0.502)), F.lit(1000)).alias("e"))
    inside = df.join(ends, "k").filter((F.col("x") >= F.col("e")[0]) & (F.col("x") <= F.col("e")[1])).count()
    assert 0 < inside < 2000


def test_memory_of_candidate_pairs_is_bounded():
    draw = np.random.default_rng(8)
    left, right = draw.normal(size=(600, 20)), draw.normal(size=(500, 20))
    row, column = (a.ravel() for a in np.indices((600, 500)))
    tracemalloc.start()
    got = similar._ranked(left, right, np.arange(600), np.arange(500), row, column, 2, "euclid")
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    apart = np.sqrt(((left[:, None] - right[None]) ** 2).sum(2))
    want = [i for own in np.argsort(apart, axis=1, kind="stable")[:, :2] for i in own]
    assert got["item_id"].tolist() == want
    # 300,000 pairs of 20 numbers: one gathered side alone takes 48 MB
    assert held < 45_000_000


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_leaves_of_a_block_leave_no_neighbour_out(monkeypatch, spread):
    draw = np.random.default_rng(5)
    items = np.round(draw.uniform(0, 40, (6000, 3))) * spread
    ids = draw.permutation(6000)
    asked = np.r_[0:60, 0:10]
    queries = pd.DataFrame({"query_id": [*ids[:60], *range(9000, 9010)], "_vector": list(items[asked])})
    compared, rough = [], similar._candidates
    monkeypatch.setattr(similar, "_candidates", lambda a, b, m: compared.append(len(a) * len(b)) or rough(a, b, m))
    got = similar._best_pairs(queries, pd.DataFrame({"item_id": ids, "_vector": list(items)}), 5, "euclid")
    found = {q: list(zip(part["item_id"], part["score"])) for q, part in got.groupby("query_id")}
    for query, vector in zip(queries["query_id"], items[asked]):
        score = -np.sqrt(((items - vector) ** 2).sum(axis=1))
        want = sorted((-s, i) for i, s in zip(ids.tolist(), score.tolist()) if i != query)[:5]
        assert found[query] == [(i, -d) for d, i in want]
    # most of a block is not compared
    assert sum(compared) < 0.4 * len(queries) * len(items)


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "near_ties", "outlier", "missing"])
def test_wide_blocks_in_half_size_numbers_give_the_exact_neighbours(kind, monkeypatch):
    rnd = np.random.default_rng(8)
    items = rnd.normal(size=(900, 64))
    if kind == "copies":
        items[300:600] = items[:300]
        items[600:] = items[:300] + rnd.normal(size=(300, 64)) * 1e-9
    elif kind == "far":
        items += 1e6
    elif kind == "near_ties":
        items = items[:1] + rnd.integers(0, 2, (900, 64)) * 1e-7
    elif kind == "outlier":
        items[7] *= 1e12
    elif kind == "missing":
        items[5, 5] = np.nan
    ids = rnd.permutation(900)
    ids[10] = ids[11]
    asked, wide = np.arange(0, 900, 3), []
    # 900 items are more than a chunk of 32 queries takes
    monkeypatch.setattr(similar, "_CHUNK_CELLS", 32 * 960)
    rough = similar._candidates
    monkeypatch.setattr(similar, "_candidates", lambda a, b, m: wide.append(len(a)) or rough(a, b, m))
    got = similar._best_pairs(
        pd.DataFrame({"query_id": ids[asked], "_vector": list(items[asked])}),
        pd.DataFrame({"item_id": ids, "_vector": list(items)}), 5, "euclid",
    )
    if kind in ("plain", "copies", "far"):
        assert not wide
    if kind == "missing":
        return
    found = {q: list(zip(own["item_id"], own["score"])) for q, own in got.groupby("query_id")}
    for q in asked:
        scores = similar._exact(np.broadcast_to(items[q], items.shape), items, "euclid")
        want = sorted((-s, i) for s, i in zip(scores, ids) if i != ids[q])[:5]
        assert found[ids[q]] == [(i, -s) for s, i in want]
