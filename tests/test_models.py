"""The training run's folds, trees, early stopping, final fit and calibration."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.ml import models, trees
from furlong.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_gbt_oof_is_the_reference_job(spark, monkeypatch):
    """Five folds over six chunks of days, early stopping with the reference's figures; only the first chunk has no row."""
    asked = []

    def few(df, features, label, race, date, params, patience, ratio):
        asked.append((params.trees, patience, ratio))
        return trees.fit(df, features, label, trees.Params(trees=1))

    monkeypatch.setattr(models, "fit_stopped", few)
    got = {(r.o_orderkey, r.fold) for r in QUERIES["gbt_oof"](spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = con.execute(f"SELECT o_orderkey, CAST(chunk - 1 AS VARCHAR) FROM orders JOIN ({SQL['date_block_folds']}) f ON CAST(o_orderdate AS DATE) = f.day WHERE chunk > 0").fetchall()
    assert got == set(want) and len({f for _, f in got}) == 5
    assert asked == [(1000, 50, 0.2)] * 5


@pytest.mark.parametrize(("losses", "patience", "want"), [([3, 2, 1], 2, (3, False)), ([3, 1, 2, 2], 2, (2, True)), ([3, 1, 2, 0.5, 2], 2, (4, False)), ([1, 1, 1], 2, (1, True))])
def test_best_count(losses, patience, want):
    assert trees.best_count(losses, patience) == want


def rows(spark, flipped):
    """400 races of one row, four a day; the label follows x, but for the latest fifth if ``flipped``."""
    y = (F.col("race") % 2 == 1) != (F.lit(flipped) & (F.col("race") >= 320))
    return spark.range(400).select(F.col("id").alias("race"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("day"), (F.col("id") % 2).alias("x"), y.cast("int").alias("y"))


def test_trees_are_chosen_on_the_latest_races(spark):
    model, best = models.final_fit(rows(spark, False), ["x"], "y", "race", "day", trees=12, patience=2)
    assert best == 12 and len(model.trees) == 12
    model, best = models.final_fit(rows(spark, True), ["x"], "y", "race", "day", trees=12, patience=2)
    assert best == 1 and len(model.trees) == 10


def noisy(spark):
    """A number with gaps and a category, of which the label depends on both."""
    r = np.random.default_rng(5)
    x, c = r.normal(size=3000), r.choice(list("abcde"), 3000)
    p = 1 / (1 + np.exp(-(x + (c == "b") * 2 - (c == "d") * 2)))
    y = (r.random(3000) < p).astype(int)
    return spark.createDataFrame([(i, None if i % 10 == 0 else float(a), None if i % 17 == 0 else str(b), int(k), i % 5 == 1) for i, (a, b, k) in enumerate(zip(x, c, y, strict=True))], "i long, x double, c string, y int, held boolean")


def test_both_sources_of_sums_give_the_same_trees(spark):
    df, p = noisy(spark).repartition(3), trees.Params(trees=22, depth=3, least_rows=20, feature_share=1.0)
    one, a = trees.fit(df, ["x", "c"], "y", p, F.col("held"), 50)
    two, b = trees.fit(df, ["x", "c"], "y", p, F.col("held"), 50, cell_bytes=0)
    assert a == b > 5 and len(one.trees) == a
    for s, t in zip(one.trees, two.trees, strict=True):
        assert all(s[k] == t[k] for k in ("feature", "cut", "miss", "child"))
        assert np.allclose(s["value"], t["value"], atol=1e-9)


def test_scores_follow_the_label(spark, tmp_path):
    df = noisy(spark)
    model, _ = trees.fit(df.where("not held"), ["x", "c"], "y", trees.Params(trees=60, least_rows=20))
    path = models.save_model(spark, model, f"{tmp_path}/m.json")
    again = models.load_model(spark, path)
    got = trees.score(again, df.where("held").withColumn("_in0", F.lit(1))).toPandas()
    assert set(got.columns) == {"i", "x", "c", "y", "held", "_in0", "p_raw"} and got.p_raw.between(0, 1).all()
    pos, neg = got.p_raw[got.y == 1].to_numpy(), got.p_raw[got.y == 0].to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.75
    assert min(model.importance().values()) > 0
    with pytest.raises(FileNotFoundError):
        models.load_calibrator(spark, f"{tmp_path}/none")


def test_no_folds_and_few_dates(spark):
    df = rows(spark, False)
    empty = models.out_of_fold(df.withColumn("chunk", F.lit(0)), ["x"], "y", "chunk", 0, "race", "day")
    assert empty.count() == 0 and empty.columns[-2:] == ["p_raw", "fold"]
    with pytest.raises(ValueError, match="dates"):
        models.DateFolds(5).chunked(df.where("race < 12"), "race", "day")
    with pytest.raises(ValueError, match="several"):
        models.DateFolds(2).chunked(df.withColumn("race", F.lit(1)), "race", "day")
    for train, val in models.DateFolds(3).split(df, "race", "day"):
        assert train.agg(F.max("day")).first()[0] < val.agg(F.min("day")).first()[0]
    with pytest.raises(ValueError, match="left to train"):
        models.inner_split(df.where("race = 1"), "race", "day", 0.2)
