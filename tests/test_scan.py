import random

from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators.scan import ordered_scan

CALCS = {
    "total": scan.running_sum("x"),
    "n": scan.row_number(),
    "prev": scan.previous("x"),
    "next": scan.following("x"),
    "known": scan.last_known("x"),
    "top": scan.running_max("x"),
    "times": scan.running_product("f"),
    "whole": scan.group_sum("x"),
}


def _frame(spark):
    draw = random.Random(3)
    data = []
    for i in range(900):
        key = "hot" if draw.random() < 0.6 else draw.choice(["a", "b", None, "c"])
        x = None if draw.random() < 0.25 else float(draw.randint(-5, 9))
        data.append((key, draw.randint(0, 40), i, x, 1 + draw.random() / 100))
    return spark.createDataFrame(data, "k string, t int, i int, x double, f double"), data


def _expected(data, descending=False):
    out = {}
    for key in {r[0] for r in data}:
        group = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]), reverse=descending)
        total = known = top = prev = None
        whole = [r[3] for r in group if r[3] is not None]
        whole = sum(whole) if whole else None
        times = 1.0
        for n, r in enumerate(group, 1):
            x = r[3]
            if x is not None:
                total = x if total is None else total + x
                top = x if top is None else max(top, x)
                known = x
            times *= r[4]
            after = group[n][3] if n < len(group) else None
            out[r[2]] = (total, n, prev, after, known, top, round(times, 9), whole)
            prev = x
    return out


def _got(df):
    return {
        r["i"]: (r["total"], r["n"], r["prev"], r["next"], r["known"], r["top"], round(r["times"], 9), r["whole"])
        for r in df.collect()
    }


def test_plain_and_split_groups_agree(spark):
    df, data = _frame(spark)
    want = _expected(data)
    assert _got(ordered_scan(df, ["k"], ["t", "i"], CALCS)) == want
    # groups above 60 rows are cut into parts
    split = ordered_scan(df, ["k"], ["t", "i"], CALCS, limit=60)
    assert _got(split) == want
    assert split.columns == df.columns + list(CALCS)


def test_descending_split(spark):
    df, data = _frame(spark)
    order = [F.col("t").desc(), F.col("i").desc()]
    assert _got(ordered_scan(df, ["k"], order, CALCS, limit=50)) == _expected(data, descending=True)


def test_no_group(spark):
    df, data = _frame(spark)
    one = [("all", *r[1:]) for r in data]
    assert _got(ordered_scan(df, [], ["t", "i"], CALCS, limit=100)) == _expected(one)


def test_limit_none_is_a_plain_window(spark):
    df, data = _frame(spark)
    assert _got(ordered_scan(df, ["k"], ["t", "i"], CALCS, limit=None)) == _expected(data)
