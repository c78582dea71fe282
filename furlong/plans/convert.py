"""Raw CSV files to the five tables of the standard layer, as lazy plans over one all-text scan each."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong import schemas as S
from furlong.functions import parsing as P
from furlong.functions import racing as R
from furlong.operators.relational import coalesce_select, conform, unpivot
from furlong.quality.checks import leakage
from furlong.schemas import columns as C
from furlong.sources.tables import exists, listed, read_csv_text, swap

log = logging.getLogger(__name__)
#: The first day that is kept; races of the kind that is left out; patterns of the two files.
SINCE, LEFT_OUT = "2015-01-01", "障害"
RESULTS_FILE, ODDS_FILE = "*_race_result.csv", "*_odds.csv"


def find_csv(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The file of that name, or the first in order that the pattern fits, or the pattern's name without its beginning; else None."""
    from fnmatch import fnmatchcase

    if exists(spark, f"{folder}/{pattern.replace('*', '')}") and "*" not in pattern:
        return f"{folder}/{pattern}"
    names = listed(spark, folder, folders=False)
    fits = [n for n in names if fnmatchcase(n, pattern)]
    if not fits and pattern.startswith("*_"):
        fits = [n for n in names if n == pattern[2:]]
    return f"{folder}/{fits[0]}" if fits else None


def day_of(c: str) -> Column:
    """A date of either common form; null for anything else."""
    return F.coalesce(F.try_to_date(P.trim_u(c), "yyyy-M-d"), F.try_to_date(P.trim_u(c), "yyyy/M/d"), F.try_to_date(P.trim_u(c)))


def eligible(raw: DataFrame, since: str = SINCE) -> DataFrame:
    """Rows with a date from ``since`` on that are of no kind that is left out; rows without a readable date go."""
    day = day_of("レース日付")
    return raw.where((day >= F.lit(since).cast("date")) & ~F.col("障害区分").eqNullSafe(LEFT_OUT)).withColumn("レース日付", F.date_format(day, "yyyy-MM-dd"))


def undated(raw: DataFrame) -> int:
    """How many rows have no readable date."""
    return raw.where(day_of("レース日付").isNull()).count()


def finish(raw: DataFrame) -> DataFrame:
    """finish_position (null under a note that has no place) and finish_note, in place of their raw columns."""
    place = P.trim_u("着順").try_cast("double")
    known = F.when(R.position_kept("着順注記"), place)
    return raw.withColumns({"finish_position": known, "finish_note": F.col("着順注記")}).drop("着順", "着順注記")


def split(raw: DataFrame) -> dict[str, DataFrame]:
    """race (one row of each id, that of its first runner), entry and result, in the columns and types of the standard layer.

    Races are picked by a partial aggregate: no row of a runner is shuffled for them. A text that is no number fails, named by its column.
    """
    raw = finish(raw)
    own = {t: {c: [s for s in src if s in raw.columns] for c, src in C.sources(t).items()} for t in S.CORE}
    race = coalesce_select(raw.withColumn("_runner", F.col(C.RUNNER_KEY)), {c: s for c, s in own["race"].items() if s} | {"_runner": ["_runner"]})
    rest = [c for c in race.columns if c not in ("race_id", "_runner")]
    race = race.groupBy("race_id").agg(F.min_by(F.struct(*rest), F.coalesce("_runner", F.lit("~"))).alias("_r")).select("race_id", "_r.*")
    flags = {c: P.tri_state(c) for c in rest if c.startswith("race_flag_")}
    race = race.withColumns(flags | {f"race_flag_{f}": F.lit(None).cast("boolean") for f in C.UNMAPPED_FLAGS})
    race = with_grades(race)
    entry = coalesce_select(raw, {c: s for c, s in own["entry"].items() if s})
    result = raw.select("finish_position", "finish_note", *[P.first_filled(*s).alias(c) for c, s in own["result"].items() if s])
    found = {"race": race, "entry": entry, "result": result}
    return {t: S.tagged(conform(numbers(df, t), S.kinds(t)), t) for t, df in found.items()}


def numbers(df: DataFrame, table: str) -> DataFrame:
    """Text columns that the schema wants as numbers, as doubles; a text that is none fails."""
    def one(c: str) -> Column:
        text = P.blank_to_null(P.trim_u(c))
        value = text.try_cast("double")
        return F.when(text.isNull() | value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{table}.{c}: not a number: "), text)).cast("double"))

    kinds, have = S.kinds(table), dict(df.dtypes)
    return df.withColumns({c: one(c) for c, k in kinds.items() if c in have and have[c] == "string" and k in ("bigint", "double")})


def with_grades(race: DataFrame) -> DataFrame:
    """The three grade flags, true also where the grade or the name says so, and never null."""
    wanted = ("graded_stakes", "stakes", "listed")
    if lost := [f for f in wanted if f"race_flag_{f}" not in race.columns]:
        raise KeyError(f"flag columns must exist before grades are merged: {lost}")
    said = R.graded_flags(*(c if c in race.columns else F.lit(None).cast("string") for c in ("grade", "race_name")))
    return race.withColumns({f"race_flag_{f}": P.either(f"race_flag_{f}", said[f]) for f in wanted})


def odds(raw: DataFrame, races: DataFrame) -> dict[str, DataFrame]:
    """odds_trifecta, and payoff with a row for each whole combination; of the races given alone. Payoff odds are in units, not tenths."""
    own = raw.withColumnRenamed(C.RACE_KEY, "race_id").join(races.select("race_id").distinct(), "race_id", "left_semi")
    wide = own.select("race_id", *[F.col(f"`{jp}`").alias(c) if jp in raw.columns else F.lit(None).cast("string").alias(c) for jp, c in C.ODDS.items()])
    trifecta = conform(numbers(wide, "odds_trifecta"), S.kinds("odds_trifecta"))
    combos = ["combo_1", "combo_2", "combo_3"]
    rows = [{x: F.col(f"trifecta{i}_{x}") for x in combos} | {"odds": F.col(f"trifecta{i}_odds") / 10.0} for i in (1, 2, 3)]
    payoff = unpivot(trifecta, ["race_id"], rows, combos).withColumn("payoff_amount", F.lit(None).cast("bigint"))
    return {"odds_trifecta": S.tagged(trifecta, "odds_trifecta"), "payoff": S.tagged(conform(payoff, S.kinds("payoff")), "payoff")}


def convert(spark: SparkSession, raw_dir: str, standard_dir: str, core_dir: str | None = None, since: str = SINCE) -> dict[str, str]:
    """Both CSV files to Parquet tables; returns their paths.

    With ``core_dir`` race, entry and result go to that folder of ``standard_dir``, and the two odds tables are not written
    at all. All tables are written beside their places first and swapped in together at the end.
    """
    paths = {n: find_csv(spark, raw_dir, p) for n, p in (("results", RESULTS_FILE), ("odds", ODDS_FILE))}
    if lost := [n for n, p in paths.items() if p is None]:
        raise FileNotFoundError(f"{raw_dir} lacks the {' and '.join(lost)} file")
    out = split(eligible(read_csv_text(spark, paths["results"]), since))
    if not core_dir:
        out |= odds(read_csv_text(spark, paths["odds"]), out["entry"])
    places = {t: f"{standard_dir}/{core_dir}/{t}.parquet" if core_dir else f"{standard_dir}/{t}.parquet" for t in out}
    for t, df in out.items():
        df.write.mode("overwrite").parquet(f"{places[t]}.staged")
    swap(spark, [(f"{p}.staged", p) for p in places.values()])
    for t in ("race", "entry"):
        if late := leakage(out[t], S.TABLES[t]):
            log.warning("%s has columns that are known after the event only: %s", t, late)
    return places
