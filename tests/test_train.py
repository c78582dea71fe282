"""The training run as a whole, on a small feature table."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.ml import metrics as M
from furlong.ml import run as R
from furlong.ml.models import final_fit
from furlong.sources.tables import get_text


def features(spark, path):
    """Two runners of six in a race of each day do well, the stronger the likelier; a venue and a gap among the features."""
    rng = np.random.default_rng(3)
    rows = []
    for d in range(240):
        for h in range(1, 7):
            x = float(rng.normal())
            rows.append((f"{202005000000 + d}", d, h, x if h != 5 else None, "東京" if d % 2 else None, int(rng.random() < 1 / (1 + np.exp(-2 * x))), d % 40 == 0))
    df = spark.createDataFrame(rows, "race_id string, d int, horse_number long, strength double, course_name string, target_top3 int, exclude_from_training boolean")
    df = df.withColumn("race_date", F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")), "yyyy-MM-dd")).drop("d")
    df.write.mode("overwrite").parquet(f"{path}/features.parquet")
    entry = df.select("race_id", "horse_number", F.concat("race_id", F.lpad(F.col("horse_number").cast("string"), 2, "0")).alias("horse_race_id"), F.when(F.col("horse_number") != 3, F.col("horse_number").cast("double")).alias("popularity"))
    entry.write.mode("overwrite").parquet(f"{path}/entry.parquet")


def config(path):
    return {
        "seed": 1,
        "data": {"feature_path": f"{path}/features.parquet", "entry_path": f"{path}/entry.parquet", "train_window": ["2020-01-01", "2020-07-01"], "holdout_window": ["2020-07-02", "2020-12-31"], "target_column": "target_top3", "feature_columns": ["race_id", "strength", "course_name"], "drop_columns": ["race_id"]},
        "cv": {"n_splits": 3, "group_column": "race_id", "early_stopping_val_ratio": 0.2}, "model": {"n_estimators": 30, "num_leaves": 7, "min_data_in_leaf": 20}, "early_stopping": {"stopping_rounds": 5}, "evaluation": {"ece_bins": 10},
        "artifacts": {"model_dir": f"{path}/model", "model_filename": "m.json", "calibrator_filename": "iso", "oof_dir": f"{path}/oof", "oof_filename": "oof.parquet", "holdout_filename": "holdout.parquet", "report_dir": f"{path}/report"},
    }


def test_run(spark, tmp_path):
    features(spark, tmp_path)
    own = config(tmp_path)
    with pytest.raises(AssertionError, match="expected and found"):
        R.run_train(spark, own)
    out = R.run_train(spark, own, [])
    oof, held = spark.read.parquet(out["oof"]), spark.read.parquet(out["holdout"])
    assert oof.columns == held.columns == ["race_id", "horse_race_id", "p_top3_raw", "p_top3_calibrated", "target_top3", "fold"]
    assert {r.fold for r in oof.select("fold").distinct().collect()} == {"0", "1", "2"} and held.select("fold").distinct().collect()[0].fold == "holdout"
    train = R.load_features(spark, f"{tmp_path}/features.parquet", ("2020-01-01", "2020-07-01"), ("2020-07-02", "2020-12-31"), f"{tmp_path}/entry.parquet", [])
    assert oof.count() < train["metadata"]["train_rows"] and held.count() == train["metadata"]["holdout_rows"] and train["metadata"]["key_overlap"] == 1.0
    assert oof.select("horse_race_id").distinct().count() == oof.count()
    metrics = json.loads(get_text(spark, out["metrics"]))
    assert metrics["auc_raw"] > 0.75 and 0 <= metrics["ece_calibrated"] < 0.2 and metrics["oof_rows"] == oof.count() and metrics["baseline_n_rows"] == held.count() * 5 // 6
    assert "| AUC |" in get_text(spark, out["report"]) and get_text(spark, out["diagram"]).startswith("<svg")
    again, _ = final_fit(train["train"], ["strength", "course_name"], "target_top3", "race_id", "race_date", 30, 5, params=R.params_of(own))
    assert again.to_json() == get_text(spark, out["model"])
    assert R.load_features(spark, f"{tmp_path}/features.parquet", ("2020-01-01", "2020-07-01"), ("2020-07-02", "2020-12-31"), None, {"train_rows": train["metadata"]["train_rows"]})["metadata"]["key_overlap"] is None


def test_contracts(spark, tmp_path):
    own = config(tmp_path)
    del own["data"]["entry_path"]
    with pytest.raises(KeyError, match="data.entry_path"):
        R.require(own)
    with pytest.raises(KeyError, match="missing"):
        R.effective_features(["a", "b"], ["b"], ["c"])
    with pytest.raises(FileNotFoundError):
        R.load_features(spark, f"{tmp_path}/no", ("2020-01-01", "2020-01-02"), ("2020-01-03", "2020-01-04"))
    spark.createDataFrame([("1", "2020-01-01", 1, False)], "race_id string, race_date string, horse_number long, exclude_from_training boolean").write.parquet(f"{tmp_path}/f")
    with pytest.raises(TypeError):
        R.load_features(spark, f"{tmp_path}/f", ("2020-01-01", "2020-01-02"), ("2020-01-03", "2020-01-04"), expected={})
    text = R.report({"auc_raw": None, "brier_raw": 0.25}, {"train": 1, "holdout": 2, "oof": 3}, 1, "c")
    assert "| AUC | n/a | n/a |" in text and "| Brier | 0.2500 | n/a |" in text


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.9), (0.0, 0.1)], "y double, p double")
    rows = M.reliability(df, "y", "p", 4).orderBy("bin").collect()
    assert [(r.n, r.accuracy) for r in rows] == [(1, 0.0), (0, None), (0, None), (2, 0.5)] and rows[1].confidence == 0.375
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 500), np.round(rng.normal(size=500), 1)
    got = M.auc(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double"), "y", "p", parts=7).first().auc
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    assert abs(got - ((pos > neg) + 0.5 * (pos == neg)).mean()) < 1e-12
    entry = spark.createDataFrame([("r", 1, 1.0), ("r", 2, None)], "race_id string, horse_number int, popularity double")
    f = spark.createDataFrame([("r", 1, 1), ("r", 2, 0)], "race_id string, horse_number int, target_top3 int")
    with pytest.raises(ValueError, match="popularity"):
        M.popularity_baseline(entry, entry)
    r = M.popularity_baseline(f.where("horse_number = 2"), entry).first()
    assert (r.baseline_auc, r.n_rows) == (0.5, 0)
