"""Integration into the standard layer: strict unions, integrity gates, staged swaps, and the sink of parsed pages."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong import schemas as S
from furlong.operators.relational import conform, multiset_difference, orphans, union_strict
from furlong.quality.checks import duplicate_keys, leakage
from furlong.sources.tables import Upserted, delete, exists, read_months, swap, upsert_months

log = logging.getLogger(__name__)
KEYS = {"race": ["race_id"], "entry": ["horse_race_id"], "result": ["horse_race_id"]}


def integrity(race: DataFrame, entry: DataFrame, result: DataFrame) -> dict[str, int]:
    """Violations by kind: duplicate keys of each table, orphans of the children, entries and results that do not pair."""
    tables = {"race": race, "entry": entry, "result": result}
    found = {f"duplicate {n}": duplicate_keys(df, KEYS[n]).first()["extra_rows"] for n, df in tables.items()}
    found |= {f"orphan {n}": orphans(tables[n], race, "race_id").count() for n in ("entry", "result")}
    pairs = multiset_difference(entry, result, "horse_race_id").first()
    return found | {"unpaired": pairs["only_left"] + pairs["only_right"]}


def samples(race: DataFrame, entry: DataFrame, result: DataFrame, n: int = 5) -> dict[str, list[str]]:
    """The first ``n`` offending keys of each kind, for messages."""
    tables = {"race": race, "entry": entry, "result": result}
    out = {f"duplicate {t}": [r[0] for r in df.groupBy(*KEYS[t]).count().where("count > 1").orderBy(*KEYS[t]).limit(n).collect()] for t, df in tables.items()}
    return out | {f"orphan {t}": [r[0] for r in orphans(tables[t], race, "race_id").orderBy("race_id").limit(n).collect()] for t in ("entry", "result")}


def _refuse(tables: dict[str, DataFrame], kinds: tuple[str, ...]) -> dict[str, int]:
    found = integrity(**tables)
    if bad := {k: n for k, n in found.items() if n and k.startswith(kinds)}:
        raise ValueError(f"integrity violations: {bad}; samples: { {k: s for k, s in samples(**tables).items() if s} }")
    if soft := {k: n for k, n in found.items() if n}:
        log.warning("integrity: %s", soft)
    return found


def integrate(first: dict[str, DataFrame], second: dict[str, DataFrame], target: str | None = None) -> dict[str, DataFrame]:
    """The union of both sources, table by table; any violation is an error. Nothing is deduplicated, and no column is added.

    With ``target`` all tables are written beside it, read again and checked, and only then are all of them swapped in; a
    second run gives the same rows, and repairs a swap that was cut off.
    """
    out = {n: union_strict(first[n], second[n], KEYS[n], check=False) for n in KEYS}
    _refuse(out, ("duplicate", "orphan", "unpaired"))
    if target:
        commit(out, {n: f"{target}/{n}" for n in out})
    return out


def commit(tables: dict[str, DataFrame], places: dict[str, str]) -> None:
    """Write every table beside its place, check all that was written, then swap all of them in."""
    staged = {n: f"{p}.staged-{uuid.uuid4().hex}" for n, p in places.items()}
    spark = next(iter(tables.values())).sparkSession
    try:
        for n, df in tables.items():
            df.write.parquet(staged[n])
        for n, df in tables.items():
            again = spark.read.parquet(staged[n])
            if again.columns != df.columns:
                raise ValueError(f"{n}: what was written has other columns: {again.columns}")
            if again.isEmpty():
                raise ValueError(f"{n}: what was written has no rows")
            if n in KEYS and duplicate_keys(again, KEYS[n]).first()["extra_rows"]:
                raise ValueError(f"{n}: what was written has duplicate keys")
        swap(spark, [(staged[n], places[n]) for n in tables])
    finally:
        for path in staged.values():
            if exists(spark, path):
                delete(spark, path)


def integrate_standard_layer(spark: SparkSession, standard_dir: str, csv_dir: str | None = None) -> dict:
    """The tables of the CSV side and all scraped months, as one corpus in ``standard_dir``; returns the paths and the audit.

    Inputs are never the output paths. Columns must be exactly the schema's on both sides; the race table may hold no column
    that is known after the event only, and the entry table must hold exactly the two that are expected.
    """
    csv_dir = csv_dir or f"{standard_dir}/csv"
    months = read_months(spark, f"{standard_dir}/scraped", KEYS)
    sides: dict[str, dict[str, DataFrame]] = {"csv": {}, "scraped": {}}
    for n in KEYS:
        path = f"{csv_dir}/{n}.parquet"
        if not exists(spark, path):
            raise FileNotFoundError(path)
        for side, df in (("csv", spark.read.parquet(path)), ("scraped", months[n])):
            require_columns(df, n, f"{side} {n}")
            sides[side][n] = S.tagged(conform(df, S.kinds(n)), n)
    out = {n: union_strict(sides["csv"][n], sides["scraped"][n], KEYS[n], check=False) for n in KEYS}
    _refuse(out, ("duplicate", "orphan", "unpaired"))
    audit = {n: leakage(out[n], S.TABLES[n]) for n in ("race", "entry")}
    if audit["race"] or set(audit["entry"]) != set(S.LATE_ENTRY):
        raise ValueError(f"columns that are known after the event only: {audit}; expected in entry: {S.LATE_ENTRY}")
    places = {n: f"{standard_dir}/{n}.parquet" for n in KEYS}
    commit(out, places)
    return places | {"audit": audit}


def require_columns(df: DataFrame, table: str, label: str) -> None:
    """The columns must be exactly those of the schema, in any order."""
    have, want = set(df.columns), set(S.kinds(table))
    if have != want:
        raise ValueError(f"{label}: extra columns {sorted(have - want)}, missing columns {sorted(want - have)}")


def normalise(tables: dict[str, DataFrame], root: str, order: dict[str, list[Column]] | None = None) -> dict[str, Upserted]:
    """Parsed pages to month partitions: races of the left-out kind go with their children, duplicate keys and orphans are errors,
    entries and results that do not pair are only logged; children take their month from their race.

    ``order`` decides between new rows of one key; by default all columns do, so that a repeated run gives the same rows.
    The tables are written once beside the months first, so that pages are parsed once and a lost executor costs little.
    """
    spark = tables["race"].sparkSession
    staged = f"{root}/.parsed-{uuid.uuid4().hex}"
    try:
        for n in KEYS:
            conform(tables[n], S.kinds(n)).write.parquet(f"{staged}/{n}")
        own = {n: S.tagged(spark.read.parquet(f"{staged}/{n}"), n) for n in KEYS}
        race, entry, result = drop_excluded(**own)
        kept = {"race": race, "entry": entry, "result": result}
        _refuse(kept, ("duplicate", "orphan"))
        routes = race.select("race_id", "race_date")
        out = {}
        for n, df in kept.items():
            by = (order or {}).get(n) or [F.xxhash64(*df.columns)]
            out[n] = upsert_months(df, root, n, KEYS[n], by, routes=None if n == "race" else routes)
        return out
    finally:
        if exists(spark, staged):
            delete(spark, staged)


def drop_excluded(race: DataFrame, entry: DataFrame, result: DataFrame, column: str = "obstacle", value: str = "障害") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without races of a kind, and without their children; a null is not of that kind."""
    kept = race.where(~F.col(column).eqNullSafe(value))
    gone = race.where(F.col(column).eqNullSafe(value)).select("race_id")
    return kept, entry.join(gone, "race_id", "left_anti"), result.join(gone, "race_id", "left_anti")
