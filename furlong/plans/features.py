"""Feature generation: race, entry and result tables to point-in-time safe training and prediction rows, as one lazy plan."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong import schemas as S
from furlong.functions import parsing as P
from furlong.functions import racing as R
from furlong.operators import windows as W
from furlong.quality.checks import leakage
from furlong.sources.tables import exists, swap

log = logging.getLogger(__name__)

# The feature contract, in order.
RACE = ["race_id", "race_date", "course_name", "distance", "surface", "direction", "weather", "track_condition", "race_number", "grade", "field_size"]
HORSE = ["bracket_num", "horse_number", "sex", "age", "weight_assigned", "horse_weight", "weight_change"]
METRICS = ["finish_position", "last_3f", "corner_4", "finish_time_zscore", "margin_numeric"]
TEXT = ["course_name", "surface", "direction", "weather", "track_condition", "sex", "jockey", "trainer", "grade"]
TARGETS = ["target_top3", "result_status", "is_dnf", "exclude_from_training"]
KEYS = ["horse_entity_key", "horse_name"]
LAGS = [f"prev_{k}_{m}" for k in range(1, 6) for m in METRICS] + [f"prev{n}_{m}_{s}" for n in (3, 5) for m in METRICS for s in ("mean", "std")]
PERSON = ["jockey", "trainer"] + [f"{p}_rolling_{x}" for p in ("jockey", "trainer") for x in ("top3_rate", "win_rate", "rides")]
FEATURES = RACE + HORSE + LAGS + PERSON + ["is_debut"]


def merged(race: DataFrame, entry: DataFrame, result: DataFrame) -> DataFrame:
    """Entries with their race and result, and the entity key that tells horses of one name apart."""
    both = entry.join(race.select(*[c for c in race.columns if c == "race_id" or c not in entry.columns]), "race_id", "left")
    both = both.join(result.drop("race_id"), "horse_race_id")
    return both.withColumn("horse_entity_key", P.entity_key("horse_name", F.substring("race_id", 1, 4).try_cast("int"), "age"))


def generate(race: DataFrame, entry: DataFrame, result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows with targets, prediction rows). A row's features use earlier races alone."""
    order = ["race_date", "race_id"]
    valid = R.valid_start("finish_note")
    df = W.field_size("race_id", "horse_number")(merged(race, entry, result))
    df = df.withColumns({"margin_numeric": P.margin_lengths("margin"), "_seconds": P.clock_seconds("finish_time")})
    df = W.expanding_zscore("race_id", ["course_name", "distance", "surface"], order, "_seconds", out="finish_time_zscore")(df)
    df = W.lag_features("horse_entity_key", order, METRICS, valid)(df)
    place = F.col("finish_position")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    df = df.withColumns({"_ok": valid.cast("int"), "_top3": flag(valid & (place <= 3)), "_win": flag(valid & (place == 1))})
    for person in ("jockey", "trainer"):
        stats = W.rolling_dual(person, "race_id", "race_date", {"top3": "_top3", "win": "_win"}, "_ok")(df)
        df = df.join(stats.withColumnsRenamed({"top3_rate": f"{person}_rolling_top3_rate", "win_rate": f"{person}_rolling_win_rate", "rides": f"{person}_rolling_rides"}), [person, "race_id"], "left")
    status = R.status("finish_note")
    df = df.withColumns({
        "result_status": status, "is_dnf": status.isin("dnf", "disqualified"), "exclude_from_training": status.isin("scratched", "removed"),
        "target_top3": flag(place <= 3).cast("long"),
    })
    df = W.debut("horse_entity_key", order, valid)(df).withColumns({c: P.trim_u(c) for c in TEXT})
    require_features(df.columns)
    return df.select(*FEATURES, *KEYS, *TARGETS), df.select(*FEATURES, *KEYS)


def require_features(columns: list[str]) -> list[str]:
    """Every feature must be there; columns that look like features and are none are named, returned and left out."""
    if lost := [c for c in FEATURES if c not in columns]:
        raise ValueError(f"features are missing: {lost}")
    known = {*FEATURES, *KEYS, *TARGETS}
    if more := [c for c in columns if c.startswith(("prev_", "prev3_", "prev5_", "jockey_rolling_", "trainer_rolling_")) and c not in known]:
        log.warning("features outside of the contract, left out: %s", more)
    return more


def write(spark: SparkSession, standard_dir: str, feature_dir: str, train: str = "features_train", pred: str = "features_pred") -> dict[str, str]:
    """The features of the standard layer as two tables, swapped in together; returns their paths and the late columns that they hold.

    A missing table is an error. The rows that both tables share are computed once: predictions are read back from what was written for training.
    """
    paths = {t: f"{standard_dir}/{t}.parquet" for t in S.CORE}
    if lost := [p for p in paths.values() if not exists(spark, p)]:
        raise FileNotFoundError(f"missing tables: {lost}")
    rows, _ = generate(*(spark.read.parquet(paths[t]) for t in S.CORE))
    out = {n: f"{feature_dir}/{n}.parquet" for n in (train, pred)}
    rows.write.mode("overwrite").parquet(f"{out[train]}.staged")
    spark.read.parquet(f"{out[train]}.staged").select(*FEATURES, *KEYS).write.mode("overwrite").parquet(f"{out[pred]}.staged")
    if late := leakage(rows, S.TABLES["race"], S.TABLES["entry"]):
        log.warning("features hold columns that are known after the event only: %s", late)
    swap(spark, [(f"{p}.staged", p) for p in out.values()])
    return out
