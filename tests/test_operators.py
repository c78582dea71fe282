"""Hand-computed cases of the operators, and that features of a prefix do not change with later rows."""

import pytest
from pyspark.sql import functions as F

from furlong.functions import parsing as P
from furlong.functions import racing as R
from furlong.ml import metrics as M
from furlong.operators import relational as O
from furlong.operators import windows as W
from furlong.quality import checks as Q
from furlong.sources import tables as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x").alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("ハナ", 0.02), ("クビ", 0.10), ("1.1/2", 1.5), ("大", 15.0), ("同着", 0.0), ("1.1/4+クビ", 1.35), ("2.1/4", None), ("", None), (None, None), (" 　3/4 ", 0.75)])
def test_margin(spark, text, want):
    got = one(spark, P.margin_lengths, text)
    assert got == want or abs(got - want) < 1e-9


@pytest.mark.parametrize(("text", "want"), [("1:29.5", 89.5), ("0:59.3", 59.3), ("59.3", None), ("1:2:3", None), ("x:1", None), (None, None)])
def test_clock(spark, text, want):
    assert one(spark, P.clock_seconds, text) == want


def test_cells(spark):
    assert tuple(one(spark, P.weight_and_change, "456(+4)")) == (456, 4)
    assert tuple(one(spark, P.weight_and_change, "472(0)")) == (472, 0)
    assert tuple(one(spark, P.weight_and_change, "計不")) == (None, None)
    assert tuple(one(spark, P.sex_and_age, "牝3")) == ("牝", 3)
    assert tuple(one(spark, P.corners, "3-3-x-1-9")) == (3, 3, None, 1)
    assert tuple(one(spark, P.finish_cell, "3(降)")) == (3, "降") and tuple(one(spark, P.finish_cell, "中")) == (None, "中")
    assert tuple(one(spark, P.region_and_name, "[東] 某")) == ("東", "某")
    assert one(spark, R.status, None) == "finished" and one(spark, R.status, "再") == "finished" and one(spark, R.status, "除") == "removed"
    assert one(spark, P.tri_state, "") is None and one(spark, P.null_tokens, "NA") is None
    assert one(spark, lambda c: P.not_in(c, ["a"]), None) is True


def test_lags_and_prefix(spark):
    rows = [("h", d, v, ok) for d, v, ok in [(1, 3.0, True), (2, None, False), (3, 1.0, True), (4, 2.0, True), (5, 9.0, True)]]
    df = spark.createDataFrame(rows, "e string, d int, v double, ok boolean")
    op = W.lag_features("e", ["d"], ["v"], F.col("ok"))
    got = {r.d: r for r in op(df).collect()}
    assert got[4].prev_1_v == 1.0 and got[4].prev_2_v == 3.0 and got[5].prev3_v_mean == 2.0 and got[2].prev_1_v is None and got[3].prev3_v_std is None
    assert {r.d: r for r in op(df.where("d <= 4")).collect()} == {d: r for d, r in got.items() if d <= 4}


def test_rolling_limits(spark):
    def rides(entries, now):
        df = spark.createDataFrame([("p", i, d, 1, t) for i, (d, t) in enumerate(entries)] + [("p", 10_000, now, 1, 0)], "p string, r int, n int, ok int, t int").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")))
        r = W.rolling_dual("p", "r", "day", {"t": "t"}, "ok")(df).where("r = 10000").first()
        return r.rides, r.t_rate

    assert rides([(i, 0) for i in range(70)] + [(500 + i, 1) for i in range(80)], 600) == (80.0, 1.0)
    assert rides([(i, 1) for i in range(40)] + [(500 + i, 0) for i in range(80)], 600) == (80.0, 0.0)
    assert rides([(i, 0) for i in range(50)] + [(50 + i, 1) for i in range(100)], 200) == (100.0, 1.0)
    assert rides([], 5) == (0.0, None)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0 if i == 0 else 0.0, 0.05) for i in range(9)] + [(1.0, 0.95)], "y double, p double")
    assert abs(M.ece(df, "y", "p").first().ece - (0.9 * abs(1 / 9 - 0.05) + 0.1 * 0.05)) < 1e-12
    assert M.auc(df.where("y = 0"), "y", "p").first().auc is None and M.auc(df.limit(0), "y", "p", 0.5).first().auc == 0.5
    assert [r.bin for r in M.ece_bins(spark.createDataFrame([(0.0, 0.3), (0.0, 0.6), (0.0, 0.7)], "y double, p double"), "y", "p").orderBy("bin").collect()] == [2, 5, 6]


def test_sets_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "2020-01-05", "a"), (2, "2020-02-01", "a"), (3, "bad", "a")], "k int, day string, v string")
    with pytest.raises(ValueError, match="unique"):
        O.union_strict(a, a, ["k"])
    with pytest.raises(ValueError, match="differ"):
        O.union_strict(a, a.drop("v"), ["k"])
    root, order = f"{tmp_path}/t", [F.col("v")]
    done = T.upsert_months(a, root, "x", ["k"], order, "day")
    assert done.skipped == 1 and done.rows == {"202001": 1, "202002": 1} and not done.replaced
    for _ in range(2):
        T.upsert_months(a.where("k = 2").withColumn("v", F.lit("b")), root, "x", ["k"], order, "day")
    assert T.months(spark, root) == ["202001", "202002"]
    assert spark.read.parquet(f"{root}/202002/x.parquet").first().v == "b" and spark.read.parquet(f"{root}/202001/x.parquet").count() == 1
    assert [r.null_rate for r in Q.null_rates(a, ["k", "no"]).collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="whole number"):
        O.conform(spark.createDataFrame([(1.5,)], "n double"), {"n": "bigint"}).collect()
