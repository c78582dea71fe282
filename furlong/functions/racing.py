"""Race flags and finish notes of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions.parsing import any_marker, trim_u

# Markers in the condition text, by flag.
MARKERS = {
    "handicap": ["(ハンデ)"], "age_restricted": ["(馬齢)"], "filly_only": ["(牝)"], "colt_only": ["(牡)"], "stallion_only": ["(父)"], "gelding_only": ["せん"],
    "special_weight": ["(別定)", "(特指)"], "allowance": ["(混)", "(市)", "九州産馬"], "bonus_weight": ["(定量)"], "apprentice": ["見習騎手"],
    "condition_race": ["(指)", "[指]", "(抽)", "[抽]"], "open": ["関東配布馬", "関西配布馬", "オープン"], "maiden": ["未勝利", "新馬"],
}
# Markers that count in the condition or the name.
LISTED, STAKES = ["(L)", "（L）", "(リステッド)", "（リステッド）"], ["重賞"]
# Flags that no text sets.
UNSET = ["amateur", "female_jockey", "mare_only", "young_horse"]
# Grade tokens.
GRADE = r"J?G(?:III|II|I|[123])|G[ⅠⅡⅢ]|Ｇ(?:ＩＩＩ|ＩＩ|Ｉ)"
# A grade column that holds a class letter alone, and the flags that it means.
CLASS_LETTERS = {"L": ["listed", "stakes"], "G": ["graded_stakes", "stakes"], "Ｇ": ["graded_stakes", "stakes"]}
# Venues by code.
VENUES = {"01": "札幌", "02": "函館", "03": "福島", "04": "新潟", "05": "東京", "06": "中山", "07": "中京", "08": "京都", "09": "阪神", "10": "小倉"}
# Status by note.
STATUS = {"中": "dnf", "失": "disqualified", "取": "scratched", "除": "removed", "降": "demoted"}
NO_START, NO_POSITION = ["取", "除"], ["中", "取", "失", "除", "再"]


def race_flags(condition: str | Column, name: str | Column) -> dict[str, Column]:
    """The twenty flags as columns: true where the text says so, else null; all null for an empty condition."""
    cond, title = (F.col(c) if isinstance(c, str) else c for c in (condition, name))
    said = cond.isNotNull() & (cond != "")
    both = F.concat_ws(" ", cond, title)
    graded = both.rlike(GRADE)
    flags = {f: F.when(said, any_marker(cond, m)) for f, m in MARKERS.items()}
    flags |= {f: F.lit(None).cast("boolean") for f in UNSET}
    flags["listed"] = F.when(said, any_marker(both, LISTED))
    flags["graded_stakes"] = F.when(said & graded, F.lit(True))
    flags["stakes"] = F.when(said & (graded | F.coalesce(any_marker(both, STAKES), F.lit(False))), F.lit(True))
    return flags


def graded_flags(grade: str | Column, name: str | Column) -> dict[str, Column]:
    """The three flags that a grade column and a name mean; never null where the text says so, null elsewhere."""
    cell, title = (F.col(c) if isinstance(c, str) else c for c in (grade, name))
    text = trim_u(cell)
    # a blank grade must not hide what the name says
    derived = race_flags(F.when(F.coalesce(text, F.lit("")) != "", cell).otherwise(" "), F.coalesce(title, F.lit("")))
    out = {}
    for flag in ("graded_stakes", "stakes", "listed"):
        letters = [x for x, means in CLASS_LETTERS.items() if flag in means]
        out[flag] = F.when(F.coalesce(text.isin(letters), F.lit(False)), F.lit(True)).otherwise(derived[flag])
    return out


def venue_code(name: str | Column) -> Column:
    """The code of a venue's name; null for an unknown one."""
    c = F.col(name) if isinstance(name, str) else name
    return F.create_map(*[F.lit(x) for code, venue in VENUES.items() for x in (venue, code)])[c]


def venue_name(code: str | Column) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.create_map(*[F.lit(x) for pair in VENUES.items() for x in pair])[c]


def status(note: str | Column) -> Column:
    """What became of a runner; a null or other note is a finish."""
    c = F.col(note) if isinstance(note, str) else note
    out = F.when(F.lit(False), F.lit(""))
    for n, s in STATUS.items():
        out = out.when(c == n, s)
    return out.otherwise("finished")


def position_kept(note: str | Column) -> Column:
    """Whether a runner with this note has a place."""
    c = F.col(note) if isinstance(note, str) else note
    return ~F.coalesce(c.isin(NO_POSITION), F.lit(False))


def position(raw: str, note: str) -> Column:
    """The place, null under a note that has none."""
    return F.when(position_kept(note), F.col(raw).try_cast("long"))


def valid_start(note: str) -> Column:
    return ~F.coalesce(F.col(note).isin(NO_START), F.lit(False))
