"""The five tables of the standard layer: typed columns, each tagged with when its value is known.

A field's metadata holds ``pre_race`` (known before the event), ``table``, and ``declared`` where a whole number is stored as a double.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

_KINDS: dict[str, DataType] = {"string": StringType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}

# The columns of each table in order, their storage types, and an asterisk where a value may be missing.
RACE = {
    "race_id": "string", "race_date": "string", "meeting_num": "bigint", "course_code": "string", "course_name": "string",
    "meeting_day": "bigint", "race_condition": "string", "race_number": "bigint", "grade_revision": "string*", "race_name": "string",
    "grade": "string*", "obstacle": "string*", "surface": "string", "surface_detail": "string*", "direction": "string",
    "course_detail": "string*", "distance": "bigint", "weather": "string*", "track_condition": "string*",
    "track_condition_detail": "string*", "start_time": "string",
}
FLAGS = [
    "handicap", "age_restricted", "filly_only", "colt_only", "gelding_only", "mare_only", "stallion_only", "apprentice", "amateur",
    "female_jockey", "young_horse", "condition_race", "special_weight", "bonus_weight", "stakes", "graded_stakes", "listed", "open",
    "maiden", "allowance",
]
ENTRY = {
    "horse_race_id": "string", "race_id": "string", "bracket_num": "bigint", "horse_number": "bigint", "horse_name": "string",
    "sex": "string", "age": "bigint", "weight_assigned": "double", "jockey": "string", "trainer": "string", "owner": "string",
    "horse_weight": "double*", "weight_change": "double*", "region": "string*", "popularity": "double*", "win_odds": "double*",
}
RESULT = {
    "horse_race_id": "string", "race_id": "string", "finish_position": "bigint*", "finish_note": "string*", "finish_time": "string*",
    "margin": "string*", "corner_1": "double*", "corner_2": "double*", "corner_3": "double*", "corner_4": "double*",
    "last_3f": "double*", "prize_money": "double*",
}
ODDS = {"race_id": "string"} | {f"trifecta{i}_{x}": "bigint*" for i in (1, 2, 3) for x in ("combo_1", "combo_2", "combo_3", "odds", "popularity")}
PAYOFF = {"race_id": "string", "combo_1": "bigint", "combo_2": "bigint", "combo_3": "bigint", "odds": "double*", "payoff_amount": "bigint*"}
#: Whole numbers that are stored as doubles; columns of a pre-event table that are known only after the event.
STORED_AS_DOUBLE = ["corner_1", "corner_2", "corner_3", "corner_4", "horse_weight", "weight_change", "popularity"]
LATE_ENTRY = ["popularity", "win_odds"]


def _schema(table: str, columns: dict[str, str], known) -> StructType:
    def field(name: str, kind: str) -> StructField:
        meta = {"pre_race": known(name), "table": table}
        if name in STORED_AS_DOUBLE:
            meta["declared"] = "bigint"
        return StructField(name, _KINDS[kind.rstrip("*")], kind.endswith("*"), meta)

    return StructType([field(n, k) for n, k in columns.items()])


TABLES: dict[str, StructType] = {
    "race": _schema("race", RACE | {f"race_flag_{f}": "boolean*" for f in FLAGS}, lambda c: True),
    "entry": _schema("entry", ENTRY, lambda c: c not in LATE_ENTRY),
    "result": _schema("result", RESULT, lambda c: False),
    "odds_trifecta": _schema("odds_trifecta", ODDS, lambda c: False),
    "payoff": _schema("payoff", PAYOFF, lambda c: False),
}
PRIMARY_KEY = {"race": "race_id", "entry": "horse_race_id", "result": "horse_race_id", "odds_trifecta": "race_id", "payoff": "race_id"}
CORE = ("race", "entry", "result")


def kinds(table: str) -> dict[str, str]:
    """column -> storage type, in order."""
    return {f.name: f.dataType.simpleString() for f in TABLES[table].fields}


def tagged(df: DataFrame, table: str) -> DataFrame:
    """``df`` with each column's metadata, which then travels with plans and Parquet footers."""
    meta = {f.name: f.metadata for f in TABLES[table].fields}
    for c in df.columns:
        if c in meta:
            df = df.withMetadata(c, meta[c])
    return df


def export(path: str | None = None) -> dict:
    """The schemas with their metadata as JSON values; written to ``path`` (a local file) if one is given."""
    out = {name: schema.jsonValue() for name, schema in TABLES.items()}
    if path:
        from pathlib import Path

        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False), encoding="utf-8")
    return out
