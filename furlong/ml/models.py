"""Out-of-fold predictions, the final model and isotonic calibration."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.ml.trees import Model, Params, fit, score
from furlong.operators.windows import date_folds, inner_tail
from furlong.sources.tables import exists, get_text, put_text

#: The training run: most trees, trees without a gain that stop it, share of the latest races held for that, least trees of the final fit.
TREES, PATIENCE, INNER_RATIO, FLOOR = 1000, 50, 0.2, 10


class DateFolds:
    """Folds over blocks of days: ``n_splits`` + 1 chunks, the first only trains; fold i validates on chunk i + 1.

    Folds are frames, not positions: a row's chunk is a column, which survives any plan.
    """

    def __init__(self, n_splits: int = 5) -> None:
        self.n_splits = n_splits

    def get_n_splits(self, *_: object) -> int:
        return self.n_splits

    def chunked(self, df: DataFrame, group: str = "race_id", date: str = "race_date") -> DataFrame:
        """``df`` with its chunk; a group of several dates, a missing column and too few dates are errors."""
        if lost := [c for c in (group, date) if c not in df.columns]:
            raise ValueError(f"folds need the columns {lost}")
        if not df.groupBy(group).agg(F.count_distinct(date).alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"a {group} has several values of {date}")
        days = date_folds(df.select(date), date, self.n_splits)
        if (n := days.count()) < self.n_splits + 1:
            raise ValueError(f"{self.n_splits} folds need {self.n_splits + 1} dates at least, there are {n}")
        return df.join(F.broadcast(days), date)  # one row a date

    def split(self, df: DataFrame, group: str = "race_id", date: str = "race_date") -> list[tuple[DataFrame, DataFrame]]:
        """(train, validation) frames of each fold; every training date is before every validation date."""
        own = self.chunked(df, group, date)
        return [(own.where(F.col("chunk") <= i).drop("chunk"), own.where(F.col("chunk") == i + 1).drop("chunk")) for i in range(self.n_splits)]


def inner_split(df: DataFrame, race: str, date: str, ratio: float, flag: str = "is_val") -> DataFrame:
    """``df`` with whether a row's race is among the latest ``ratio`` of races; none left to train on is an error."""
    if not 0 < ratio < 1:
        raise ValueError(f"the share of races to hold must lie between 0 and 1, not {ratio}")
    tail = inner_tail(df.select(race, date), race, date, ratio)
    out = df.join(tail.select(race, F.col("is_val").alias(flag)), race)
    if out.where(~F.col(flag)).isEmpty():
        raise ValueError("no race is left to train on")
    return out


def fit_stopped(df: DataFrame, features: list[str], label: str, race: str, date: str, params: Params, patience: int, ratio: float) -> tuple[Model, int]:
    """(trees fitted on all but the latest ``ratio`` of races, their number): as many as have the least loss on those races."""
    return fit(inner_split(df, race, date, ratio, "_held"), features, label, params, F.col("_held"), patience)


def out_of_fold(
    df: DataFrame, features: list[str], label: str, chunk: str, n_splits: int, race: str, date: str, out: str = "p_raw",
    trees: int = TREES, patience: int = PATIENCE, ratio: float = INNER_RATIO, params: Params = Params(),
) -> DataFrame:
    """Rows of chunks 1..n, each scored by trees that saw earlier chunks only, stopped early on the latest races of those;
    ``fold`` is text. Chunk 0 only trains. Without folds the frame is empty, in the same columns."""
    params = replace(params, trees=trees)
    parts = [score(_no_model(features), df.limit(0), out).withColumn("fold", F.lit(""))] if n_splits < 1 else []
    for fold in range(n_splits):
        model, _ = fit_stopped(df.where(F.col(chunk) <= fold), features, label, race, date, params, patience, ratio)
        parts.append(score(model, df.where(F.col(chunk) == fold + 1), out).withColumn("fold", F.lit(str(fold))))
    return reduce(DataFrame.unionByName, parts)


def _no_model(features: list[str]) -> Model:
    from furlong.ml.trees import Binning

    return Model(Binning(list(features), {f: [] for f in features}), 0.0)


def final_fit(
    df: DataFrame, features: list[str], label: str, race: str, date: str, trees: int = TREES, patience: int = PATIENCE,
    ratio: float = INNER_RATIO, floor: int = FLOOR, params: Params = Params(),
) -> tuple[Model, int]:
    """(trees on all rows, the number that early stopping found): at least ``floor`` trees are fitted."""
    _, best = fit_stopped(df, features, label, race, date, replace(params, trees=trees), patience, ratio)
    return fit(df, features, label, replace(params, trees=max(best, floor)))[0], best


def save_model(spark: SparkSession, model: Model, path: str) -> str:
    return put_text(spark, path, model.to_json())


def load_model(spark: SparkSession, path: str) -> Model:
    return Model.from_json(get_text(spark, path))


def fit_isotonic(df: DataFrame, raw: str, label: str) -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol=raw, labelCol=label).fit(df.select(F.col(raw).cast("double").alias(raw), F.col(label).cast("double").alias(label)))


def apply_isotonic(model: IsotonicRegressionModel, df: DataFrame, raw: str, out: str = "p_calibrated") -> DataFrame:
    """Calibrated scores, inside 0 and 1."""
    return model.setFeaturesCol(raw).setPredictionCol(out).transform(df).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(out))))


def save_calibrator(model: IsotonicRegressionModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_calibrator(spark: SparkSession, path: str) -> IsotonicRegressionModel:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return IsotonicRegressionModel.load(path)
