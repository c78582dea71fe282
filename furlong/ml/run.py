"""The training run as one command: features to windows, folds, calibrator, final model, metrics and report."""

from __future__ import annotations

import json
import logging
import math
from dataclasses import replace
from typing import Any

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong import schemas as S
from furlong.functions import parsing as P
from furlong.ml import metrics as M
from furlong.ml import models as O
from furlong.ml.trees import Params, score
from furlong.operators.relational import key_overlap
from furlong.quality.checks import leakage
from furlong.sources.tables import exists, put_text, write_staged

log = logging.getLogger(__name__)
# Rows and races that the windows of the whole corpus must have.
WHOLE_CORPUS = {"train_rows": 322510, "train_races": 23288, "holdout_rows": 66343, "holdout_races": 4740}
REQUIRED = [
    "data", "data.feature_path", "data.train_window", "data.holdout_window", "data.entry_path", "data.target_column", "data.feature_columns",
    "cv", "cv.n_splits", "evaluation", "evaluation.ece_bins", "artifacts", "artifacts.model_dir", "artifacts.model_filename", "artifacts.calibrator_filename",
    "artifacts.oof_dir", "artifacts.oof_filename", "artifacts.holdout_filename", "artifacts.report_dir",
]


def window(df: DataFrame, first: str, last: str, excluded: str = "exclude_from_training", date: str = "race_date") -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included, that may be trained on; a null flag excludes nothing."""
    day = F.try_to_date(F.col(date).cast("string"))
    return df.where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")) & ~F.coalesce(F.col(excluded).cast("boolean"), F.lit(False)))


def load_features(
    spark: SparkSession, feature_path: str, train_window: tuple[str, str], holdout_window: tuple[str, str], entry_path: str | None = None,
    expected: dict[str, int] | list | None = None,
) -> dict[str, Any]:
    """train and holdout frames with their runner key, and what was found on the way.

    ``expected``: None stands for the figures of the whole corpus, an empty list for no check, a filled dict for own figures;
    an empty dict is an error.
    """
    if not exists(spark, feature_path):
        raise FileNotFoundError(feature_path)
    df = spark.read.parquet(feature_path)
    if late := leakage(df, S.TABLES["race"], S.TABLES["entry"]):
        log.warning("features hold columns that are known after the event only: %s", late)
    df = df.withColumn("race_date", F.date_format(F.try_to_date(F.col("race_date").cast("string")), "yyyy-MM-dd")).withColumn("horse_race_id", P.composite_key("race_id", "horse_number"))
    out: dict[str, Any] = {"train": window(df, *train_window), "holdout": window(df, *holdout_window)}
    counts = {}
    for name in ("train", "holdout"):
        r = out[name].agg(F.count("*").alias("rows"), F.count_distinct("race_id").alias("races")).first()
        counts |= {f"{name}_rows": r["rows"], f"{name}_races": r["races"]}
    if expected is None:
        want: dict[str, int] = WHOLE_CORPUS
    elif isinstance(expected, list) and not expected:
        want = {}
    elif isinstance(expected, dict) and expected:
        want = expected
    else:
        raise TypeError(f"expected counts must be None, an empty list or a filled dict, not {expected!r}")
    if off := {k: (n, counts.get(k)) for k, n in want.items() if counts.get(k) != n}:
        raise AssertionError(f"expected and found rows: {off}")
    met = key_overlap(df, spark.read.parquet(entry_path), "horse_race_id").first()["overlap"] if entry_path and exists(spark, entry_path) else None
    return out | {"metadata": counts | {"key_overlap": met, "late_columns": late}}


def require(config: dict) -> None:
    """Every key that the run needs must be there."""
    for path in REQUIRED:
        node: Any = config
        for k in path.split("."):
            if not isinstance(node, dict) or k not in node:
                raise KeyError(f"the configuration lacks {path}")
            node = node[k]


def effective_features(columns: list[str], dropped: list[str], have: list[str]) -> list[str]:
    """The features less the dropped ones, all of which must be there."""
    own = [c for c in columns if c not in dropped]
    if lost := [c for c in own if c not in have]:
        raise KeyError(f"features are missing: {lost}")
    return own


def params_of(config: dict) -> Params:
    """Tree parameters from the model section; leaves become levels."""
    m = config.get("model", {})
    depth = max(1, math.ceil(math.log2(int(m.get("num_leaves", 31)))))
    return Params(
        int(m.get("n_estimators", O.TREES)), depth, float(m.get("learning_rate", 0.05)), int(m.get("min_data_in_leaf", 100)), float(m.get("feature_fraction", 0.9)),
        ridge=max(1e-3, float(m.get("lambda_l2", 0.0))), seed=int(config.get("seed", 42)),
    )


def predictions(df: DataFrame, calibrator: IsotonicRegressionModel, target: str, fold: str | None = None) -> DataFrame:
    """The table of predictions; ``fold`` is text."""
    out = O.apply_isotonic(calibrator, df, "p_raw")
    kind = F.col("fold") if fold is None else F.lit(fold)
    return out.select("race_id", "horse_race_id", F.col("p_raw").alias("p_top3_raw"), F.col("p_calibrated").alias("p_top3_calibrated"), F.col(target).cast("long").alias("target_top3"), kind.alias("fold"))


def report(metrics: dict[str, Any], rows: dict[str, int], seed: int, config: str) -> str:
    """The metrics as Markdown; what is undefined reads n/a."""
    def say(name: str) -> str:
        v = metrics.get(name)
        return "n/a" if v is None or (isinstance(v, float) and not math.isfinite(v)) else f"{v:.4f}" if isinstance(v, float) else str(v)

    table = "\n".join(f"| {label} | {say(f'{name}_raw')} | {say(f'{name}_calibrated')} |" for label, name in (("AUC", "auc"), ("Brier", "brier"), ("Log loss", "logloss"), ("ECE", "ece")))
    return (
        f"# Evaluation\n\nConfiguration: `{config}` (seed {seed}). Rows: training {rows['train']}, holdout {rows['holdout']}, out of fold {rows['oof']} (validation chunks only).\n\n"
        f"| metric (holdout) | raw | calibrated |\n|-|-|-|\n{table}\n| samples | {say('n_samples')} | |\n| baseline AUC by popularity | {say('baseline_auc')} (n = {say('baseline_n_rows')}) | |\n\n"
        "The holdout is evaluated only: neither the model nor the calibrator sees it. The features hold no popularity and no odds, so the baseline is a figure of the market.\n"
    )


def evaluate(df: DataFrame, target: str, raw: str, calibrated: str, n_bins: int = 10) -> dict[str, float | None]:
    """Nine figures of the raw and the calibrated score."""
    out = M.evaluate(df, target, raw, calibrated, n_bins).first().asDict()
    return out | {"n_samples": df.count()}


def run_train(spark: SparkSession, config: str | dict, expected: dict[str, int] | list | None = None) -> dict[str, str]:
    """All steps of the run; returns the places of what it wrote. ``config`` is a mapping or the path of a YAML file."""
    label = config if isinstance(config, str) else "given"
    if isinstance(config, str):
        import yaml

        from furlong.sources.tables import get_text

        config = yaml.safe_load(get_text(spark, config))
    require(config)
    data, art = config["data"], config["artifacts"]
    loaded = load_features(spark, data["feature_path"], tuple(data["train_window"]), tuple(data["holdout_window"]), data["entry_path"], expected)
    train, holdout, target = loaded["train"], loaded["holdout"], data["target_column"]
    group = str(config["cv"].get("group_column", config["cv"].get("group_col", "race_id")))
    if group != "race_id":
        raise ValueError(f"predictions are keyed by race_id, not by {group}")
    features = effective_features(list(data["feature_columns"]), list(data.get("drop_columns", [])), train.columns)
    params, ratio = params_of(config), float(config["cv"].get("early_stopping_val_ratio", O.INNER_RATIO))
    patience = int(config.get("early_stopping", {}).get("stopping_rounds", O.PATIENCE))
    n_splits = int(config["cv"]["n_splits"])
    chunked = O.DateFolds(n_splits).chunked(train)
    oof_path, holdout_path = (f"{art['oof_dir']}/{art[k]}" for k in ("oof_filename", "holdout_filename"))
    # predictions out of fold are read by the calibrator and written with its scores: they are kept in between
    raw = O.out_of_fold(chunked, features, target, "chunk", n_splits, "race_id", "race_date", trees=params.trees, patience=patience, ratio=ratio, params=params)
    raw = raw.select("race_id", "horse_race_id", "p_raw", target, "fold").persist()
    calibrator = O.fit_isotonic(raw, "p_raw", target)
    write_staged(predictions(raw, calibrator, target), oof_path)
    raw.unpersist()
    model, best = O.final_fit(train, features, target, "race_id", "race_date", params.trees, patience, ratio, params=replace(params))
    write_staged(predictions(score(model, holdout), calibrator, target, "holdout"), holdout_path)
    held = spark.read.parquet(holdout_path)
    bins = int(config["evaluation"]["ece_bins"])
    found = evaluate(held, "target_top3", "p_top3_raw", "p_top3_calibrated", bins)
    if (found["ece_calibrated"] or 0.0) >= float(config["evaluation"].get("ece_tolerance", 0.02)):
        log.warning("the calibrated scores are off by %.4f on average", found["ece_calibrated"])
    base = M.popularity_baseline(holdout, spark.read.parquet(data["entry_path"]), target).first()
    oof_rows = spark.read.parquet(oof_path).count()
    found |= {"baseline_auc": base["baseline_auc"], "baseline_n_rows": base["n_rows"], "oof_rows": oof_rows, "best_trees": best}
    out = {
        "model": O.save_model(spark, model, f"{art['model_dir']}/{art['model_filename']}"),
        "calibrator": O.save_calibrator(calibrator, f"{art['model_dir']}/{art['calibrator_filename']}"), "oof": oof_path, "holdout": holdout_path,
    }
    folder = art["report_dir"]
    clean = {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in found.items()}
    out["metrics"] = put_text(spark, f"{folder}/{art.get('metrics_filename', 'metrics.json')}", json.dumps(clean, indent=2, allow_nan=False))
    rows = {"train": loaded["metadata"]["train_rows"], "holdout": loaded["metadata"]["holdout_rows"], "oof": oof_rows}
    out["report"] = put_text(spark, f"{folder}/{art.get('report_filename', 'evaluation_report.md')}", report(clean, rows, params.seed, label))
    picture = M.reliability_svg(M.reliability(held, "target_top3", "p_top3_calibrated", bins).orderBy("bin").collect())
    out["diagram"] = put_text(spark, f"{folder}/{art.get('diagram_filename', 'reliability.svg')}", picture)
    return out | {"config": label}
