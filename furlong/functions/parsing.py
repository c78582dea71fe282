"""Column expressions that parse result cells; every one is total: what cannot be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Margin texts and their lengths.
MARGINS = {
    "ハナ": 0.02, "アタマ": 0.05, "クビ": 0.10, "1/2": 0.5, "3/4": 0.75, "1.1/4": 1.25, "1.1/2": 1.5, "1.3/4": 1.75, "2.1/2": 2.5, "3.1/2": 3.5,
    "1": 1.0, "2": 2.0, "3": 3.0, "4": 4.0, "5": 5.0, "6": 6.0, "7": 7.0, "8": 8.0, "9": 9.0, "10": 10.0, "大": 15.0, "同着": 0.0,
}
# Tokens that a CSV reader takes for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What counts as white space at the ends of a text, beyond ASCII too; full-width letters and digits.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
_ASCII = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)
# The forms of result cells.
WEIGHT_CELL = r"^(\d{1,4})(?:\(([+-]?\d{1,3})\))?$"
SEX_AGE_CELL = r"^(牡|牝|セ)(\d{1,2})$"
PASSING_SIGNS = "[-－―]"
DEMOTED_CELL = r"^(\d+)\s*[（(]?降[）)]?$"
REGION_CELL = r"^\[([東西])\]\s*(.+)$"


def trim_u(c: str | Column) -> Column:
    """Without white space at the ends, the ideographic space included."""
    return F.btrim(_col(c), F.lit(SPACE))


def half_width(c: str | Column) -> Column:
    """Full-width letters and digits as ASCII ones."""
    return F.translate(_col(c), _WIDE, _ASCII)


def null_tokens(c: str | Column) -> Column:
    """Null for the texts that mean a missing value."""
    return F.when(~_col(c).isin(NA_TOKENS), _col(c))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(_col(c), F.lit(""))


def margin_lengths(c: str | Column) -> Column:
    """Lengths of a margin text: a known text, or the sum of known texts joined by a plus; else null."""
    known = F.create_map(*[F.lit(x) for pair in MARGINS.items() for x in pair])
    parts = F.transform(F.split(trim_u(c), r"\+"), lambda x: known[trim_u(x)])
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def clock_seconds(c: str | Column) -> Column:
    """Seconds of M:SS.T; null unless there is one colon with a number on each side."""
    parts = F.split(trim_u(c), ":")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double") * 60 + F.get(parts, F.lit(1)).try_cast("double"))


def _group(c: str | Column, pattern: str, group: int) -> Column:
    return blank_to_null(F.regexp_extract(_col(c), pattern, group))


def weight_and_change(c: str | Column) -> Column:
    """struct(weight, change) of 456(+4)."""
    pattern = WEIGHT_CELL
    return F.struct(_group(trim_u(c), pattern, 1).try_cast("double").alias("weight"), _group(trim_u(c), pattern, 2).try_cast("double").alias("change"))


def sex_and_age(c: str | Column) -> Column:
    """struct(sex, age) of a sex sign followed by an age."""
    pattern = SEX_AGE_CELL
    return F.struct(_group(trim_u(c), pattern, 1).alias("sex"), _group(trim_u(c), pattern, 2).try_cast("long").alias("age"))


def corners(c: str | Column) -> Column:
    """Four places of a passing text such as 3-3-2-1: blanks are skipped, other texts are null places."""
    parts = F.filter(F.transform(F.split(_col(c), PASSING_SIGNS), trim_u), lambda x: x != "")
    places = F.transform(parts, lambda x: x.try_cast("double"))
    return F.struct(*[F.get(places, F.lit(i)).alias(f"corner_{i + 1}") for i in range(4)])


def finish_cell(c: str | Column) -> Column:
    """struct(position, note) of a finish cell: a place, a place that was taken away in part (kept, with its note), or a note alone."""
    t = blank_to_null(trim_u(c))
    demoted = _group(t, DEMOTED_CELL, 1).try_cast("long")
    place = F.coalesce(demoted, t.try_cast("long"))
    return F.struct(place.alias("position"), F.when(demoted.isNotNull(), F.lit("降")).when(place.isNull(), t).alias("note"))


def region_and_name(c: str | Column) -> Column:
    """struct(region, name) of a name with a bracketed region in front."""
    t = trim_u(c)
    return F.struct(_group(t, REGION_CELL, 1).alias("region"), blank_to_null(F.coalesce(trim_u(_group(t, REGION_CELL, 2)), t)).alias("name"))


def tri_state(c: str | Column) -> Column:
    """True where there is a text; null, never false, elsewhere."""
    return F.when(_col(c).isNotNull() & (_col(c) != ""), F.lit(True))


def any_marker(c: str | Column, markers: list[str]) -> Column:
    """True where one of the markers is in the text; null, never false, elsewhere."""
    found = F.lit(False)
    for m in markers:
        found = found | F.coalesce(_col(c).contains(m), F.lit(False))
    return F.when(found, F.lit(True))


def either(old: str | Column, new: str | Column) -> Column:
    """Or, with null as false: never null."""
    return F.coalesce(_col(old), F.lit(False)) | F.coalesce(_col(new), F.lit(False))


def first_filled(*sources: str | Column) -> Column:
    """The first source that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in sources])


def entity_key(name: str | Column, year: str | Column, age: str | Column) -> Column:
    """name_birthyear; null if any part is."""
    return F.concat(_col(name), F.lit("_"), (_col(year).cast("long") - _col(age).cast("long")).cast("string"))


def composite_key(group: str | Column, number: str | Column) -> Column:
    """The group's id followed by a number of two digits or more."""
    n = _col(number).cast("string")
    return F.concat(_col(group).cast("string"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n))


def not_in(c: str | Column, values: list) -> Column:
    """Not one of the values; a null is none of them."""
    return ~F.coalesce(_col(c).isin(values), F.lit(False))
