"""Saved result pages to the race, entry and result tables.

A page's tree is read in a Python worker, in Arrow batches, and only its texts leave it: the header texts and the cells of the
result table by header. Every field is then parsed by column expressions, so the forms of cells are those of
:mod:`furlong.functions.parsing`, and what cannot be parsed is null. Pages are narrow rows; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong import schemas as S
from furlong.functions import parsing as P
from furlong.functions import racing as R

# The class of the result table and of the line under the title, and the headers of the result table by field.
TABLE_CLASS, LINE_CLASS = "race_table_01", "smalltxt"
HEADERS = {
    "finish_position": ["着順"], "bracket_num": ["枠番"], "horse_number": ["馬番"], "horse_name": ["馬名"], "sex_age": ["性齢"],
    "weight_assigned": ["斤量"], "jockey": ["騎手"], "finish_time": ["タイム"], "margin": ["着差"], "passing": ["通過"],
    "last_3f": ["上り", "上がり"], "win_odds": ["単勝"], "popularity": ["人気"], "horse_weight": ["馬体重"], "trainer": ["調教師"],
    "owner": ["馬主"], "prize_money": ["賞金"],
}
# The forms of header texts.
DATE = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
MEETING = r"(\d+)回(\S+?)(\d+)日目"
COURSE = r"(芝|ダート|ダ)\s*(右|左|直線|直)(?:\s*(外))?\s*(\d+)m"
OBSTACLE_DISTANCE = r"障.{0,40}?(\d{3,5})m"
WEATHER, TRACK, START = r"天候\s*[:：]\s*(\S+)", r"(?:芝|ダート)\s*[:：]\s*(\S+)", r"発走\s*[:：]\s*(\d{1,2}:\d{2})"
REVISION = r"第(\d+)回"
GRADE_TOKEN = r"(GIII|GII|GI|JGIII|JGII|JGI|G3|G2|G1|JG3|JG2|JG1|ＧＩＩＩ|ＧＩＩ|ＧＩ|\(L\)|（L）|リステッド)"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MUTE = frozenset("script style template".split())
#: An opening tag ends the open ones of its row, up to the nearest tag of its scope.
_ENDS = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th", "thead", "tbody"), "p": ("p",), "li": ("li",)}
_SCOPE = {"tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "thead": {"table"}, "p": {"td", "th", "div", "table"}, "li": {"ul", "ol"}}


class Node:
    """An element: its name, attributes and children (elements and texts)."""

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, name: str) -> list[Node]:
        return [n for n in self.walk() if n.name == name and n is not self]

    def strings(self) -> list[str]:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.name not in _MUTE or node is self:
                todo += reversed(node.children)
        return out

    def text(self) -> str:
        """Its texts, each trimmed, joined by nothing."""
        return "".join(s.strip() for s in self.strings())

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in _SCOPE.get(tag, ()):
                break
            if self.open[k].name in _ENDS.get(tag, ()):
                del self.open[k:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return
            if self.open[k].name == "table" and tag in ("tr", "td", "th"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


_WIDE = str.maketrans(P._WIDE, P._ASCII)


def columns_by_header(table: Node, headers: dict[str, list[str]] = HEADERS) -> dict[str, int]:
    """field -> index of its cell, from the first row that has header cells; fields without a header are left out."""
    cells = next((ths for tr in table.all("tr") if (ths := tr.all("th"))), [])
    texts = ["".join(th.strings()).translate(_WIDE).strip() for th in cells]
    return {field: texts.index(own[0]) for field, names in headers.items() if (own := [t for t in texts if t in names])}


def page_texts(html: str | None) -> dict:
    """The texts of a page: line, title, h1s, all text, and the result table's rows as cells by field."""
    root = tree(html or "")
    line = next((n for n in root.walk() if n.name == "p" and n.has_class(LINE_CLASS)), None)
    title = next((n for n in root.walk() if n.name == "title"), None)
    tables = root.all("table")
    found = next((t for t in tables if t.has_class(TABLE_CLASS)), None) or next((t for t in tables if t.all("th")), None)
    rows = []
    if found:
        at = columns_by_header(found)
        for tr in found.all("tr"):
            if cells := tr.all("td"):
                rows.append({f: cells[i].text() for f, i in at.items() if i < len(cells)})
    return {
        "line": "".join(line.strings()) if line else "", "title": title.text() if title else "", "h1": [n.text() for n in root.all("h1")],
        "said": " ".join(root.strings()), "rows": [{f: r.get(f) for f in HEADERS} for r in rows],
    }


_ROW = pa.struct([(f, pa.string()) for f in HEADERS])
_TEXTS = pa.schema([("race_id", pa.string()), ("line", pa.string()), ("title", pa.string()), ("h1", pa.list_(pa.string())), ("said", pa.string()), ("rows", pa.list_(_ROW))])
_DDL = "race_id string, line string, title string, h1 array<string>, said string, rows array<struct<" + ", ".join(f"{f}: string" for f in HEADERS) + ">>"


def texts(pages: DataFrame, id_col: str = "race_id", html_col: str = "html") -> DataFrame:
    """One row of texts for each page whose id is a race's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"race_id": i, **page_texts(h)} for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_TEXTS)

    return pages.where(F.col(id_col).rlike(r"^\d{12}$")).select(id_col, html_col).mapInArrow(run, _DDL)


def _found(c: Column, pattern: str, group: int) -> Column:
    return P.blank_to_null(F.regexp_extract(c, f"(?U){pattern}", group))


def _number(c: Column, pattern: str, group: int) -> Column:
    return P.half_width(_found(c, pattern, group)).try_cast("long")


def _race(t: DataFrame) -> DataFrame:
    line, said = F.col("line"), F.col("said")
    day = [_number(line, DATE, k) for k in (1, 2, 3)]
    condition = P.blank_to_null(P.trim_u(F.regexp_extract(line, f"(?Us){MEETING}(.*)$", 4)))
    segment = F.when(F.col("title").contains("｜"), F.split_part("title", F.lit("｜"), F.lit(1))).when(F.col("title").contains("|"), F.split_part("title", F.lit("|"), F.lit(1)))
    name = F.coalesce(P.blank_to_null(P.trim_u(segment)), P.blank_to_null("title"), P.blank_to_null(F.get("h1", F.lit(0))))
    df = t.withColumns({"_condition": condition, "_name": name, "_graded": F.get(F.filter("h1", lambda h: h.rlike(GRADE_TOKEN)), F.lit(0))})
    own = F.coalesce("_name", F.lit(""))
    df = df.withColumn("_hay", F.when(F.col("_graded").isNotNull() & ~own.contains(F.col("_graded")), P.trim_u(F.concat(own, F.lit(" "), F.col("_graded")))).otherwise(own))
    token = F.regexp_replace(_found(F.col("_hay"), GRADE_TOKEN, 1), "[()（）]", "")
    over = F.coalesce(F.col("_condition").contains("障害"), F.lit(False))
    surface, way = _found(said, COURSE, 1), _found(said, COURSE, 2)
    venue = _found(line, MEETING, 2)
    fields = {
        "race_id": F.col("race_id"),
        "race_date": _iso(*day),
        "meeting_num": _number(line, MEETING, 1), "course_code": R.venue_code(venue), "course_name": venue, "meeting_day": _number(line, MEETING, 3),
        "race_condition": F.col("_condition"), "race_number": F.substring("race_id", 11, 2).try_cast("long"),
        "grade_revision": _found(F.col("_hay"), REVISION, 1), "race_name": F.col("_name"), "grade": F.when(token == "リステッド", "L").otherwise(token),
        "obstacle": F.when(over, "障害"), "surface": F.when(over, F.when(said.contains("ダ"), "ダート")).when(surface == "ダ", "ダート").otherwise(surface),
        "direction": F.when(~over, F.when(way == "直", "直線").otherwise(way)),
        "distance": F.when(over, P.half_width(P.blank_to_null(F.regexp_extract(said, f"(?Ud){OBSTACLE_DISTANCE}", 1))).try_cast("long")).otherwise(_number(said, COURSE, 4)),
        "weather": _found(said, WEATHER, 1), "track_condition": _found(said, TRACK, 1), "start_time": _found(said, START, 1),
    }
    flags = R.race_flags("_condition", "_hay")
    fields |= {f"race_flag_{f}": flags[f] for f in S.FLAGS}
    return df.select(*[fields.get(c, F.lit(None)).cast(k).alias(c) for c, k in S.kinds("race").items()])


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.when(day.isNotNull(), F.format_string("%04d-%02d-%02d", year, month, day))


def _whole(c: str) -> Column:
    return P.trim_u(c).try_cast("long")


def _real(c: str) -> Column:
    return P.trim_u(c).try_cast("double")


def _runners(t: DataFrame) -> DataFrame:
    rows = t.select("race_id", F.inline("rows")).withColumn("_no", _whole("horse_number")).where("_no is not null")
    return rows.withColumn("horse_race_id", P.composite_key("race_id", "_no")).where(F.col("horse_race_id").rlike(r"^\d{14}$"))


def tables(pages: DataFrame, id_col: str = "race_id", html_col: str = "html") -> dict[str, DataFrame]:
    """race, entry and result of the pages, in the columns and types of the standard layer.

    Rows without a number of the runner, or whose key has not 14 digits, are no runners. Pages whose id has not
    twelve digits are left out; :func:`rejected` names them.
    """
    read = texts(pages, id_col, html_col)
    runners = _runners(read)
    body, region = P.weight_and_change("horse_weight"), P.region_and_name("trainer")
    sex, places, finish = P.sex_and_age("sex_age"), P.corners("passing"), P.finish_cell("finish_position")
    entry = runners.select(
        "horse_race_id", "race_id", _whole("bracket_num").alias("bracket_num"), F.col("_no").alias("horse_number"), "horse_name", sex["sex"].alias("sex"), sex["age"].alias("age"),
        _real("weight_assigned").alias("weight_assigned"), "jockey", region["name"].alias("trainer"), "owner", body["weight"].alias("horse_weight"),
        body["change"].alias("weight_change"), region["region"].alias("region"), _whole("popularity").alias("popularity"), _real("win_odds").alias("win_odds"),
    )
    result = runners.select(
        "horse_race_id", "race_id", finish["position"].alias("finish_position"), finish["note"].alias("finish_note"), "finish_time", "margin",
        *[places[f"corner_{k}"].alias(f"corner_{k}") for k in (1, 2, 3, 4)], _real("last_3f").alias("last_3f"), _real("prize_money").alias("prize_money"),
    )
    cast = lambda df, n: S.tagged(df.select(*[F.col(c).cast(k).alias(c) for c, k in S.kinds(n).items()]), n)
    return {"race": S.tagged(_race(read), "race"), "entry": cast(entry, "entry"), "result": cast(result, "result")}


def rejected(pages: DataFrame, id_col: str = "race_id") -> DataFrame:
    """The pages whose id is not twelve digits."""
    return pages.where(~F.coalesce(F.col(id_col).rlike(r"^\d{12}$"), F.lit(False)))
