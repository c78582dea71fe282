"""Validation of a standard layer against its schemas, its source and expected figures. Each check reads only what it needs."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType

from furlong import schemas as S
from furlong.functions import parsing as P
from furlong.functions.racing import VENUES, position_kept
from furlong.operators.relational import multiset_difference, orphans
from furlong.plans.convert import ODDS_FILE, RESULTS_FILE, day_of, find_csv
from furlong.quality.checks import hash_sample, leakage, null_rates, profile, value_ranges
from furlong.schemas import columns as C
from furlong.sources.tables import exists, read_csv_text

log = logging.getLogger(__name__)
TOLERANCE, SAMPLES = 0.01, 5
_WHOLE, _REAL = (LongType, IntegerType, ShortType), (DoubleType, FloatType)
_CHILDREN = ("entry", "result", "odds_trifecta", "payoff")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder that are there."""
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in S.TABLES if exists(spark, f"{folder}/{t}.parquet")}


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> dict[str, bool]:
    """Whether each table has exactly the rows expected; a table that is missing has not."""
    return {t: t in tables and tables[t].count() == n for t, n in expected.items()}


def conformance(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Missing tables and columns, and columns of another type. A whole number may be stored as a double if it is declared so
    or every value is whole; any type will do for an optional column that is all null. Values are read in one pass a table."""
    out = {}
    for table, schema in S.TABLES.items():
        if table not in tables:
            out[table] = [f"Missing table: {table}"]
            continue
        df, errors, open_questions = tables[table], [], {}
        have = {f.name: f.dataType for f in df.schema.fields}
        for f in schema.fields:
            if f.name not in have:
                errors.append(f"Missing column: {f.name}")
                continue
            kind, declared = have[f.name], LongType() if f.metadata.get("declared") == "bigint" else f.dataType
            if isinstance(kind, type(declared)) or (isinstance(declared, LongType) and isinstance(kind, _WHOLE)) or (isinstance(declared, DoubleType) and isinstance(kind, _REAL)):
                continue
            if isinstance(declared, LongType) and isinstance(kind, _REAL):
                if f.name not in S.STORED_AS_DOUBLE:
                    open_questions[f.name] = F.count_if(F.col(f.name) != F.floor(f.name))
            elif isinstance(declared, BooleanType) and isinstance(kind, StringType):
                open_questions[f.name] = F.count_if(~F.lower(f.name).isin("true", "false"))
            elif f.nullable:
                open_questions[f.name] = F.count(f.name)
            else:
                errors.append(f"Type of {f.name}: {kind.simpleString()} for {declared.simpleString()}")
        if open_questions:
            seen = df.agg(*[c.alias(n) for n, c in open_questions.items()]).first()
            errors += [f"Type of {n}: {have[n].simpleString()}, {seen[n]} values do not fit" for n in open_questions if seen[n]]
        out[table] = errors
    return out


def audit(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Of each table, the columns that are known after the event only."""
    return {t: leakage(tables[t], s) if t in tables else [f"Missing: {t}"] for t, s in S.TABLES.items()}


def null_rate_differences(tables: dict[str, DataFrame], stats: dict[str, dict], tolerance: float = TOLERANCE) -> dict[str, dict[str, float]]:
    """Columns whose share of nulls differs from ``stats[table]["null_rates"]`` by more than the tolerance; 1 for a missing column."""
    out: dict[str, dict[str, float]] = {}
    for table, own in stats.items():
        out[table] = {}
        want = own.get("null_rates", {})
        if table in tables and want:
            have = {r["column"]: r["null_rate"] for r in null_rates(tables[table], list(want)).collect()}
            for c, rate in want.items():
                off = 1.0 if c not in tables[table].columns else abs(have[c] - rate)
                if c not in tables[table].columns or off > tolerance:
                    out[table][c] = off
    return out


def distribution_differences(tables: dict[str, DataFrame], stats: dict[str, dict], tolerance: float = TOLERANCE) -> dict[str, dict[str, dict]]:
    """Columns whose min, max or mean differs from ``stats[table]["distributions"]`` by more than the tolerance."""
    out: dict[str, dict[str, dict]] = {}
    for table, own in stats.items():
        out[table] = {}
        want = own.get("distributions", {})
        if table not in tables or not want:
            continue
        there = [c for c in want if c in tables[table].columns]
        out[table] |= {c: {"error": "Column missing"} for c in want if c not in there}
        for r in profile(tables[table], there).collect() if there else []:
            actual, expected = {k: r[k] for k in ("min", "max", "mean")}, want[r["column"]]
            off = {k: abs(v - expected[k]) for k, v in actual.items() if v is not None and expected.get(k) is not None and abs(v - expected[k]) > tolerance}
            if off:
                out[table][r["column"]] = {"expected": expected, "actual": actual, "diffs": off}
    return out


def referential(tables: dict[str, DataFrame], n: int = SAMPLES) -> list[str]:
    """Missing tables, race ids without a race, and entries and results that do not pair one to one."""
    if "race" not in tables:
        return ["Missing race: references cannot be checked"]
    out = []
    for t in _CHILDREN:
        if t not in tables:
            out.append(f"Missing {t}")
            continue
        lost = orphans(tables[t], tables["race"], "race_id")
        if count := lost.count():
            first = [r[0] for r in lost.orderBy("race_id").limit(n).collect()]
            out.append(f"{t} has {count} race ids without a race: {first}")
    if "entry" in tables and "result" in tables:
        d = multiset_difference(tables["entry"].where("horse_race_id is not null"), tables["result"].where("horse_race_id is not null"), "horse_race_id").first()
        if any(d):
            out.append(f"entry and result are not one to one: {d.asDict()}")
    return out


def _cell_ok(name: str, kind: str, sources: list[str], note: Column | None = None) -> Column:
    """Whether a stored value is what its source says; flags are true where any source has a text, and a ``note`` may take a place away."""
    value, first = F.col(f"_v_{name}"), P.null_tokens(F.col(f"_s_{sources[0]}"))
    if name == "race_date":
        first = F.date_format(day_of(f"_s_{sources[0]}"), "yyyy-MM-dd")
    if note is not None:
        first = F.when(position_kept(note), first)
    if kind == "boolean":
        any_text = F.lit(False)
        for s in sources:
            c = P.null_tokens(F.col(f"_s_{s}"))
            any_text = any_text | (c.isNotNull() & (P.trim_u(c) != ""))
        return F.coalesce(value, F.lit(False)) == any_text
    text = value.cast("string")
    number = (text.try_cast("double") == first.try_cast("double")) | (text == first)
    return F.when(value.isNull() | first.isNull(), value.isNull() & first.isNull()).otherwise(F.coalesce(number, F.lit(False)))


def sample_rows(spark: SparkSession, tables: dict[str, DataFrame], source_dir: str, n: int = SAMPLES, seed: int = 42) -> dict[str, bool]:
    """Whether ``n`` rows of each table, picked by a hash of the key, hold what the source files say. An empty table does not; a key
    that the source lacks is no difference; tables without a source file or a comparable column are left out."""
    out = {}
    for table in tables:
        path = find_csv(spark, source_dir, RESULTS_FILE if table in S.CORE else ODDS_FILE)
        if path is None:
            continue
        df, key, feeds = tables[table], S.PRIMARY_KEY[table], C.sources(table)
        source = read_csv_text(spark, path)
        headers = {c: [h for h in feeds[c] if h in source.columns] for c in df.columns if c in feeds}
        headers = {c: h for c, h in headers.items() if h}
        if key not in headers:
            continue
        picked = hash_sample(df, key, n, seed)
        rows = picked.select(F.col(key).cast("string").alias("_k"), *[F.col(c).alias(f"_v_{c}") for c in headers])
        if rows.isEmpty():
            out[table] = False
            continue
        used = sorted({h for hs in headers.values() for h in hs})
        own = source.select(F.col(f"`{headers[key][0]}`").alias("_k"), *[F.col(f"`{h}`").alias(f"_s_{h}") for h in used])
        # a few keys: the source is filtered by them before its first row of each is taken
        near = own.join(F.broadcast(rows.select("_k")), "_k", "left_semi").dropDuplicates(["_k"])
        kinds = dict(df.dtypes)
        note = F.col(f"_s_{headers['finish_note'][0]}") if "finish_note" in headers else None
        checks = [_cell_ok(c, kinds[c], h, note if c == "finish_position" else None) for c, h in headers.items()]
        good = checks[0]
        for c in checks[1:]:
            good = good & c
        out[table] = rows.join(near, "_k").where(~F.coalesce(good, F.lit(False))).isEmpty()
    return out


def ranges(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Values outside their domain: venue codes, distances, brackets, numbers, ages and weights; one pass a table."""
    num = lambda c: F.col(c).cast("string").try_cast("double")
    rules = {
        "race": {"course_code": F.col("course_code").isin(list(VENUES)), "distance": num("distance") > 0},
        "entry": {"bracket_num": num("bracket_num").between(1, 8), "horse_number": num("horse_number") >= 1, "age": num("age") >= 2, "weight_assigned": num("weight_assigned") > 0},
    }
    out = {}
    for table, own in rules.items():
        if table in tables:
            there = {c: r for c, r in own.items() if c in tables[table].columns}
            found = value_ranges(tables[table], there).collect() if there else []
            out[table] = [f"{r['rule']}: {r['violations']} values outside their range" for r in found if r["violations"]]
    return out


def run_all(spark: SparkSession, raw_dir: str, folder: str, counts: dict[str, int] | None = None, stats: dict[str, dict] | None = None) -> dict[str, object]:
    """All eight checks; ``overall_pass`` is true if each passes. Checks without figures to compare pass.

    The audit fails for any late column in race, and for those of entry that are not expected.
    """
    tables = load(spark, folder)
    details = {
        "row_counts": row_counts(tables, counts or {}), "schema_conformance": conformance(tables), "audit": audit(tables),
        "null_rates": null_rate_differences(tables, stats or {}), "distributions": distribution_differences(tables, stats or {}),
        "referential_integrity": referential(tables), "sample_rows": sample_rows(spark, tables, raw_dir), "value_ranges": ranges(tables),
    }
    late = {t: [c for c in details["audit"][t] if not c.startswith("Missing")] for t in ("race", "entry")}
    passed: dict[str, object] = {
        "row_counts": all(details["row_counts"].values()), "schema_conformance": not any(details["schema_conformance"].values()),
        "audit": not late["race"] and set(late["entry"]) <= set(S.LATE_ENTRY), "null_rates": not any(details["null_rates"].values()),
        "distributions": not any(details["distributions"].values()), "referential_integrity": not details["referential_integrity"],
        "sample_rows": all(details["sample_rows"].values()), "value_ranges": not any(details["value_ranges"].values()),
    }
    passed["overall_pass"] = all(passed.values())
    if not passed["overall_pass"]:
        log.warning("validation failed: %s", [k for k, ok in passed.items() if ok is False and k != "overall_pass"])
    return passed | {"details": details}
