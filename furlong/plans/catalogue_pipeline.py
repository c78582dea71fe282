"""The pipeline's operators on the given tables: raw files, result pages, month partitions, validation and training, with SQL that says the same.

The tables hold no races, so each query first writes orders and their lines as raw CSV columns or pages would; from there on only the
library works, and the SQL starts from the same tables by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong import schemas as S
from furlong.functions import parsing as P
from furlong.functions import racing as R
from furlong.ml import metrics as M
from furlong.ml import run as T
from furlong.ml.models import DateFolds
from furlong.operators import relational as O
from furlong.plans import convert as C
from furlong.plans import integrate as G
from furlong.plans.catalogue import QUERIES, SQL, _auc_sql, _scored, query, r6, t
from furlong.quality import checks as Q
from furlong.quality import validate as V
from furlong.session import ensure_checkpoint_dir
from furlong.sources import pages as L
from furlong.sources import result_pages as RP
from furlong.sources import tables as TB

__all__ = ["QUERIES", "SQL"]

# ---- raw files -------------------------------------------------------------------------------------------------------

#: One line of each order and line number, with its order: what the raw columns below are made of.
_BASE = """WITH b AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS race, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS runner,
    l_orderkey AS o, l_linenumber AS n, s, q, cust, day FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
  JOIN (SELECT o_orderkey, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day FROM orders) ON o_orderkey = l_orderkey
), k AS (SELECT * FROM b WHERE o % 50 <> 0 AND o % 11 <> 0 AND day >= DATE '1997-01-01') """


def _lines(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    od = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").cast("date").alias("day"))
    race = F.lpad(F.col("l_orderkey").cast("string"), 12, "0")
    return li.join(od, "l_orderkey").select(
        race.alias("race"), P.composite_key(race, "l_linenumber").alias("runner"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "s", "q", "cust", "day"
    )


def _raw(spark, d) -> DataFrame:
    """The columns of the raw results file, all of them text."""
    o, cust, s, text = F.col("o"), F.col("cust"), F.col("s"), lambda c: c.cast("string")
    made = {
        "レース馬番ID": F.col("runner"), "レースID": F.col("race"),
        "レース日付": F.when(o % 50 == 0, "?").when(o % 2 == 0, F.date_format("day", "yyyy/M/d")).otherwise(text(F.col("day"))),
        "障害区分": F.when(o % 11 == 0, "障害"), "競馬場コード": F.lpad(text(cust % 10 + 1), 2, "0"), "レース番号": text(o % 12 + 1), "距離(m)": F.concat(text(1000 + o % 20 * 100), F.lit(".0")),
        "レース記号/(混)": F.when(cust % 3 == 0, "(混)"), "レース記号/(市)": F.when(cust % 5 == 0, "(市)"), "レース記号/牝": F.when(cust % 4 == 0, "牝").otherwise("NA"),
        "リステッド・重賞競走": F.when(o % 7 == 0, "G1").when(o % 7 == 1, "L").when(o % 7 == 2, " Ｇ").when(o % 7 == 3, ""), "レース名": F.when(o % 13 == 0, "某賞(GIII)").otherwise("某"),
        "着順": text(F.col("n")), "着順注記": F.when(s % 9 == 0, "中").when(s % 9 == 1, "降").when(s % 9 == 2, "再"), "枠番": text(F.col("n") % 8 + 1), "馬番": text(F.col("n")),
        "馬名": F.concat(F.lit("馬"), text(s)), "馬体重": F.when(s % 4 != 0, text(F.col("q") + 400)), "単勝": text(F.col("q") / 2), "着差": F.lit("N/A"), "1コーナー": text(F.col("n")),
    }
    return _lines(spark, d).select(*[P.null_tokens(c).alias(n) for n, c in made.items()])


def _split(spark, d, table: str) -> DataFrame:
    return C.split(C.eligible(_raw(spark, d), "1997-01-01"))[table]


@query(_BASE + """SELECT DISTINCT race AS race_id, CAST(day AS VARCHAR) AS race_date, lpad(CAST(cust % 10 + 1 AS VARCHAR), 2, '0') AS course_code, CAST(o % 12 + 1 AS BIGINT) AS race_number,
  CAST(1000 + o % 20 * 100 AS BIGINT) AS distance, CASE WHEN cust % 3 = 0 OR cust % 5 = 0 THEN 1 END AS allowance, CASE WHEN cust % 4 = 0 THEN 1 END AS filly_only,
  CAST(o % 7 IN (0, 2) OR o % 13 = 0 AS INTEGER) AS graded_stakes, CAST(o % 7 IN (0, 1, 2) OR o % 13 = 0 AS INTEGER) AS stakes, CAST(o % 7 = 1 AS INTEGER) AS listed FROM k""")
def convert_race(spark, d):
    flags = ["allowance", "filly_only", "graded_stakes", "stakes", "listed"]
    return _split(spark, d, "race").select("race_id", "race_date", "course_code", "race_number", "distance", *[F.col(f"race_flag_{f}").cast("int").alias(f) for f in flags])


@query(_BASE + """SELECT runner AS horse_race_id, race AS race_id, CAST(n % 8 + 1 AS BIGINT) AS bracket_num, CAST(n AS BIGINT) AS horse_number, '馬' || s AS horse_name,
  CASE WHEN s % 4 <> 0 THEN q + 400 END AS horse_weight, q / 2 AS win_odds FROM k""")
def convert_entry(spark, d):
    return _split(spark, d, "entry").select("horse_race_id", "race_id", "bracket_num", "horse_number", "horse_name", "horse_weight", "win_odds")


@query(_BASE + """SELECT runner AS horse_race_id, race AS race_id, CASE WHEN s % 9 IN (0, 2) THEN NULL ELSE CAST(n AS BIGINT) END AS finish_position,
  CASE s % 9 WHEN 0 THEN '中' WHEN 1 THEN '降' WHEN 2 THEN '再' END AS finish_note, CAST(NULL AS VARCHAR) AS margin, CAST(n AS DOUBLE) AS corner_1 FROM k""")
def convert_result(spark, d):
    return _split(spark, d, "result").select("horse_race_id", "race_id", "finish_position", "finish_note", "margin", "corner_1")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderdate >= '1997-01-01' AND o_orderkey % 11 <> 0")
def date_bound_and_kind(spark, d):
    raw = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, "x").otherwise(F.date_format("o_orderdate", "yyyy/M/d")).alias("レース日付"), F.when(F.col("o_orderkey") % 11 == 0, "障害").alias("障害区分"))
    return C.eligible(raw, "1997-01-01").select("o_orderkey")


def _odds(spark, d) -> dict[str, DataFrame]:
    o, text = F.col("o_orderkey"), lambda c: c.cast("string")
    made = {"レースID": F.lpad(text(o), 12, "0")}
    for i in (1, 2, 3):
        made |= {f"三連複{i}_組合せ{j}": F.when(o % 4 >= i - 1, text(o % 6 + j)) for j in (1, 2)}
        made |= {f"三連複{i}_組合せ3": F.when(o % 5 != i, text(o % 6 + 3)), f"三連複{i}_オッズ": F.when(o % 3 != 0, text(o % 900 + i)), f"三連複{i}_人気": text(o % 9)}
    races = t(spark, d, "orders").where("o_orderkey % 3 < 2").select(F.lpad(text(o), 12, "0").alias("race_id"))
    return C.odds(t(spark, d, "orders").select(*[c.alias(n) for n, c in made.items()]), races)


_COMBO = "CASE WHEN o % 4 >= {i} - 1 THEN o % 6 + {j} END"
_THIRD = "CASE WHEN o % 5 <> {i} THEN o % 6 + 3 END"
_ODDS_SQL = "WITH r AS (SELECT o_orderkey AS o, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS race_id FROM orders WHERE o_orderkey % 3 < 2) "


@query(_ODDS_SQL + "SELECT race_id, " + ", ".join(
    f"{_COMBO.format(i=i, j=1)} AS trifecta{i}_combo_1, {_COMBO.format(i=i, j=2)} AS trifecta{i}_combo_2, {_THIRD.format(i=i)} AS trifecta{i}_combo_3, CASE WHEN o % 3 <> 0 THEN o % 900 + {i} END AS trifecta{i}_odds, o % 9 AS trifecta{i}_popularity" for i in (1, 2, 3)
) + " FROM r")
def convert_odds(spark, d):
    return _odds(spark, d)["odds_trifecta"]


@query(_ODDS_SQL + " UNION ALL ".join(
    f"SELECT race_id, o % 6 + 1 AS combo_1, o % 6 + 2 AS combo_2, o % 6 + 3 AS combo_3, round(CASE WHEN o % 3 <> 0 THEN (o % 900 + {i}) / 10.0 END::DOUBLE, 6) AS odds, CAST(NULL AS BIGINT) AS payoff_amount FROM r WHERE o % 4 >= {i} - 1 AND o % 5 <> {i}" for i in (1, 2, 3)
))
def convert_payoff(spark, d):
    return r6(_odds(spark, d)["payoff"], "odds")


# ---- result pages ----------------------------------------------------------------------------------------------------


def _pages(spark, d) -> DataFrame:
    """A result page for each order: its lines are the runners."""
    n, q, s = F.col("n"), F.col("q"), F.col("s")
    cells = [
        F.when(s % 9 == 0, "取").when(s % 9 == 1, F.concat(n.cast("string"), F.lit("（降）"))).otherwise(n.cast("string")), (n % 8 + 1).cast("string"), n.cast("string"),
        F.concat(F.lit("<a href='x'>馬&amp;"), s.cast("string"), F.lit("</a>")), F.concat(F.when(s % 2 == 0, "牡").otherwise("牝"), (n + 2).cast("string")), q.cast("string"),
        F.concat(F.lit("1:2"), (n % 10).cast("string"), F.lit(".5")), F.concat(n.cast("string"), F.lit("-x-"), (n + 1).cast("string")),
        F.when(s % 4 == 0, "計不").otherwise(F.concat((q + 400).cast("int").cast("string"), F.lit("(-2)"))), F.concat(F.when(s % 3 == 0, "[東] ").otherwise(""), F.lit("師"), s.cast("string")),
    ]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td> "), c, F.lit("\n")) for c in cells])
    head = "<table class='x race_table_01'><tr>" + "".join(f"<th>{h}</th>" for h in ("着順", "枠番", "馬番", "馬名", "性齢", "斤量", "タイム", "通過", "馬体重", "調教師")) + "</tr>"
    cond = F.when(F.col("o") % 11 == 0, "障害3歳").when(F.col("o") % 4 == 0, "3歳未勝利 (混)(定量)").otherwise("オープン")
    venue = F.coalesce(R.venue_name(F.lpad((F.col("cust") % 11 + 1).cast("string"), 2, "0")), F.lit("某所"))
    top = F.concat(
        F.lit("<html><head><title>第"), F.col("o").cast("string"), F.lit("回某賞"), F.when(F.col("o") % 13 == 0, "(GIII)").otherwise(""), F.lit("｜x</title></head><body><h1>logo</h1><p class='smalltxt'>"),
        F.date_format("day", "yyyy年M月d日"), F.lit(" 2回"), venue, F.lit("4日目 "), cond, F.lit("</p><span>"), F.when(F.col("o") % 11 == 0, "障芝 ダート3110m").otherwise(F.concat(F.lit("ダ右"), (1000 + F.col("o") % 20 * 100).cast("string"), F.lit("m"))),
        F.lit(" / 天候 : 晴 / ダート : 良 / 発走 : 09:55</span>"),
    )
    per = _lines(spark, d).groupBy("race", "o", "cust", "day").agg(F.concat_ws("", F.array_sort(F.collect_list(row))).alias("rows"))
    return per.select(F.col("race").alias("race_id"), F.concat(top, F.lit(head), "rows", F.lit("<tr><td colspan=9>-</td></tr></table></body></html>")).alias("html"))


_VENUE = "CASE cust % 11 " + " ".join(f"WHEN {int(c) - 1} THEN '{v}'" for c, v in R.VENUES.items()) + " ELSE '某所' END"


@query(_BASE + f"""SELECT DISTINCT race AS race_id, CAST(day AS VARCHAR) AS race_date, 2::BIGINT AS meeting_num, CASE WHEN cust % 11 < 10 THEN lpad(CAST(cust % 11 + 1 AS VARCHAR), 2, '0') END AS course_code,
  {_VENUE} AS course_name, 4::BIGINT AS meeting_day, CASE WHEN o % 11 = 0 THEN '障害3歳' WHEN o % 4 = 0 THEN '3歳未勝利 (混)(定量)' ELSE 'オープン' END AS race_condition, o % 100 AS race_number,
  CAST(o AS VARCHAR) AS grade_revision, '第' || o || '回某賞' || CASE WHEN o % 13 = 0 THEN '(GIII)' ELSE '' END AS race_name, CASE WHEN o % 13 = 0 THEN 'GIII' END AS grade,
  CASE WHEN o % 11 = 0 THEN '障害' END AS obstacle, 'ダート' AS surface, CASE WHEN o % 11 <> 0 THEN '右' END AS direction, CASE WHEN o % 11 = 0 THEN 3110 ELSE 1000 + o % 20 * 100 END AS distance,
  '晴' AS weather, '良' AS track_condition, '09:55' AS start_time, CASE WHEN o % 11 <> 0 AND o % 4 = 0 THEN 1 END AS maiden, CASE WHEN o % 13 = 0 THEN 1 END AS graded_stakes FROM b""")
def page_race(spark, d):
    out = RP.tables(_pages(spark, d))["race"]
    cols = ["race_id", "race_date", "meeting_num", "course_code", "course_name", "meeting_day", "race_condition", "race_number", "grade_revision", "race_name", "grade", "obstacle", "surface", "direction", "distance", "weather", "track_condition", "start_time"]
    return out.select(*cols, F.col("race_flag_maiden").cast("int").alias("maiden"), F.col("race_flag_graded_stakes").cast("int").alias("graded_stakes"))


@query(_BASE + """SELECT runner AS horse_race_id, race AS race_id, CAST(n % 8 + 1 AS BIGINT) AS bracket_num, CAST(n AS BIGINT) AS horse_number, '馬&' || s AS horse_name, CASE WHEN s % 2 = 0 THEN '牡' ELSE '牝' END AS sex,
  CAST(n + 2 AS BIGINT) AS age, q AS weight_assigned, '師' || s AS trainer, CASE WHEN s % 3 = 0 THEN '東' END AS region, CASE WHEN s % 4 <> 0 THEN floor(q) + 400 END AS horse_weight, CASE WHEN s % 4 <> 0 THEN -2.0::DOUBLE END AS weight_change FROM b""")
def page_entry(spark, d):
    return RP.tables(_pages(spark, d))["entry"].select("horse_race_id", "race_id", "bracket_num", "horse_number", "horse_name", "sex", "age", "weight_assigned", "trainer", "region", "horse_weight", "weight_change")


@query(_BASE + """SELECT runner AS horse_race_id, race AS race_id, CASE WHEN s % 9 <> 0 THEN CAST(n AS BIGINT) END AS finish_position, CASE s % 9 WHEN 0 THEN '取' WHEN 1 THEN '降' END AS finish_note,
  '1:2' || (n % 10) || '.5' AS finish_time, CAST(n AS DOUBLE) AS corner_1, CAST(NULL AS DOUBLE) AS corner_2, CAST(n + 1 AS DOUBLE) AS corner_3 FROM b""")
def page_result(spark, d):
    return RP.tables(_pages(spark, d))["result"].select("horse_race_id", "race_id", "finish_position", "finish_note", "finish_time", "corner_1", "corner_2", "corner_3")


@query("""WITH l AS (SELECT event_id AS e, CASE WHEN event_id % 5 = 0 THEN '20231399' ELSE strftime(ts, '%Y%m%d') END AS digits FROM events)
SELECT DISTINCT strptime(digits, '%Y%m%d')::DATE AS day, 'b/race/list/' || digits || '/' AS url FROM l WHERE digits <> '20231399'""")
def calendar_days(spark, d):
    digits = F.when(F.col("event_id") % 5 == 0, "20231399").otherwise(F.date_format("ts", "yyyyMMdd"))
    html = t(spark, d, "events").select(F.concat(F.lit('<a href="/race/list/'), digits, F.lit('/">x</a><a href="/horse/list/20200101/">y</a><a href="/race/list/2020/">z</a>')).alias("html"))
    return L.day_links(html, base="b").select("day", "url")


@query("""WITH r AS (SELECT '2020' || lpad(CAST(user_id % 14 AS VARCHAR), 2, '0') || lpad(CAST(user_id AS VARCHAR), 6, '0') AS race_id, CAST(ts AS DATE) AS day, user_id % 14 AS v FROM events)
SELECT race_id, min(day) AS day FROM r WHERE v BETWEEN 1 AND 10 GROUP BY 1""")
def day_race_refs(spark, d):
    own = F.concat(F.lit("2020"), F.lpad((F.col("user_id") % 14).cast("string"), 2, "0"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    html = t(spark, d, "events").select(F.concat(F.lit('<a href="/race/'), own, F.lit('/">x</a><a href="/race/12345/">y</a>')).alias("html"), F.col("ts").cast("date").alias("day"))
    return L.race_refs(html)


@query("SELECT c_custkey, CASE c_nationkey % 12 " + " ".join(f"WHEN {int(c)} THEN '{c}'" for c in R.VENUES) + " END AS code FROM customer")
def venue_lookup(spark, d):
    name = R.venue_name(F.lpad((F.col("c_nationkey") % 12).cast("string"), 2, "0"))
    return t(spark, d, "customer").select("c_custkey", R.venue_code(F.coalesce(name, F.lit("?"))).alias("code"))


@query("SELECT c_custkey, translate(c_name, '#', '') AS plain FROM customer")
def header_text(spark, d):
    wide = F.translate(F.translate("c_name", "#", ""), P._ASCII, P._WIDE)
    return t(spark, d, "customer").select("c_custkey", P.trim_u(P.half_width(F.concat(F.lit("　"), wide, F.lit("  ")))).alias("plain"))


# ---- months ----------------------------------------------------------------------------------------------------------


def _standard(spark, d) -> dict[str, DataFrame]:
    race = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("race_id"), F.col("o_orderdate").cast("date").cast("string").alias("race_date"), F.col("o_orderstatus").alias("race_name"), F.when(F.col("o_orderkey") % 11 == 0, "障害").alias("obstacle"))
    runner = _lines(spark, d).select(F.col("runner").alias("horse_race_id"), F.col("o").cast("string").alias("race_id"), "n", "q")
    fill = lambda df, n: O.conform(df, S.kinds(n))
    return {
        "race": fill(race, "race"), "entry": fill(runner.withColumn("horse_number", F.col("n").cast("long")), "entry"),
        "result": fill(runner.withColumn("last_3f", F.col("q")), "result"),
    }


_ROOTS: dict[tuple[str, str], str] = {}


def _stored(spark, d) -> str:
    """The folder of parsed tables in months, where some races came again under another name; stored once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _ROOTS or not TB.exists(spark, _ROOTS[key]):
        root = f"{ensure_checkpoint_dir(spark)}/months-{uuid.uuid4().hex}"
        tables = _standard(spark, d)
        G.normalise(tables, root)
        again = {n: df.where(F.col("race_id").cast("long") % 10 == 0) for n, df in tables.items()}
        G.normalise(again | {"race": again["race"].withColumn("race_name", F.lit("new"))}, root)
        _ROOTS[key] = root
    return _ROOTS[key]


@query("SELECT CAST(o_orderkey AS VARCHAR) AS race_id, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS race_name, strftime(o_orderdate, '%Y%m') AS month FROM orders WHERE o_orderkey % 11 <> 0")
def months_upsert(spark, d):
    path = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{6})/race\.parquet/", 1)
    return TB.read_months(spark, _stored(spark, d), S.CORE)["race"].select("race_id", "race_name", path.alias("month"))


@query(_BASE.rsplit(", k AS", 1)[0] + " SELECT runner AS horse_race_id, q AS last_3f, strftime(day, '%Y%m') AS month FROM b WHERE o % 11 <> 0")
def months_routed(spark, d):
    path = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{6})/result\.parquet/", 1)
    return TB.read_months(spark, _stored(spark, d), S.CORE)["result"].select("horse_race_id", "last_3f", path.alias("month"))


@query(_BASE.rsplit(", k AS", 1)[0] + """, x AS (
  SELECT strftime(o_orderdate, '%Y%m') AS month, 'race' AS "table", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT strftime(day, '%Y%m'), v.kind, NULL FROM b, (VALUES ('entry'), ('result')) v(kind) WHERE o % 11 <> 0)
SELECT month, "table", count(DISTINCT "table") AS tables, count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM x GROUP BY GROUPING SETS ((month, "table"), (month), ("table"))""")
def months_status(spark, d):
    return TB.month_summary(spark, _stored(spark, d))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y%m') END AS month FROM orders""")
def month_key(spark, d):
    text = F.when(F.col("o_orderkey") % 9 == 0, "2020-13-01").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return t(spark, d, "orders").select("o_orderkey", TB.month_of(text).alias("month"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS race_id, '1' AS race_name, CAST(NULL AS VARCHAR) AS grade, CAST(o_orderkey AS BIGINT) AS distance FROM orders")
def reindex_to_schema(spark, d):
    df = t(spark, d, "orders").select(F.col("o_orderkey").alias("race_id"), F.lit(1).alias("race_name"), F.col("o_orderkey").cast("double").alias("distance"), F.lit("gone").alias("unknown"))
    return O.conform(df, S.kinds("race")).select("race_id", "race_name", "grade", "distance")


# ---- validation ------------------------------------------------------------------------------------------------------


def _checked(spark, d) -> dict[str, DataFrame]:
    """Tables with known faults: entries without a race, values out of range, and a fraction in a whole column."""
    out = _standard(spark, d)
    num = F.col("horse_race_id").cast("decimal(20,0)")
    entry = out["entry"].withColumns({"race_id": F.when(num % 97 == 0, "none").otherwise(F.col("race_id")), "bracket_num": F.col("horse_number") * 2, "age": F.lit(3).cast("double") + F.when(num % 7 == 0, 0.5).otherwise(0.0), "weight_assigned": F.lit(1.0)})
    race = out["race"].withColumns({"course_code": F.lpad((F.col("race_id").cast("long") % 12).cast("string"), 2, "0"), "distance": F.col("race_id").cast("long") % 100})
    return out | {"race": race, "entry": entry, "result": out["result"].where(num % 89 != 0)}


def _report(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "kind string, violations long")


@query(_BASE + """SELECT 'orphan entry' AS kind, count(DISTINCT race) FILTER (x) AS violations FROM (SELECT 'none' AS race, CAST(runner AS DECIMAL(20,0)) % 97 = 0 AS x FROM b)
UNION ALL SELECT 'duplicate entry', 0 UNION ALL SELECT 'unpaired', (SELECT count(*) FROM b WHERE CAST(runner AS DECIMAL(20,0)) % 89 = 0)""")
def integrity_report(spark, d):
    x = _checked(spark, d)
    found = G.integrity(x["race"], x["entry"], x["result"])
    return _report(spark, [(k, found[k]) for k in ("orphan entry", "duplicate entry", "unpaired")])


@query(_BASE + """SELECT 'course_code' AS kind, (SELECT count(*) FROM orders WHERE o_orderkey % 12 IN (0, 11)) AS violations UNION ALL SELECT 'distance', (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0)
UNION ALL SELECT 'bracket_num', (SELECT count(*) FROM b WHERE n * 2 NOT BETWEEN 1 AND 8)""")
def domain_report(spark, d):
    found = [line for own in V.ranges(_checked(spark, d)).values() for line in own]
    return _report(spark, [(line.split(":")[0], int(line.split()[1])) for line in found])


@query(_BASE + """SELECT 'entry.age' AS kind, (SELECT count(*) FROM b WHERE CAST(runner AS DECIMAL(20,0)) % 7 = 0) AS violations
UNION ALL SELECT 'odds_trifecta', 1 UNION ALL SELECT 'payoff', 1""")
def schema_report(spark, d):
    found = V.conformance(_checked(spark, d))
    rows = [(f"entry.{line.split()[2].rstrip(':')}", int(line.split()[4])) for line in found["entry"]]
    return _report(spark, rows + [(n, len(found[n])) for n in ("odds_trifecta", "payoff")] + [(n, 1) for n in ("race", "result") if found[n]])


@query("SELECT * FROM (VALUES ('race', 1::BIGINT), ('entry', 0::BIGINT), ('payoff', 0::BIGINT)) v(kind, violations)")
def row_count_report(spark, d):
    tables = _standard(spark, d)
    found = V.row_counts(tables, {"race": t(spark, d, "orders").count(), "entry": 1, "payoff": 0})
    return _report(spark, [(k, int(ok)) for k, ok in found.items()])


@query("""SELECT 'entry.popularity' AS kind, 1::BIGINT AS violations UNION ALL SELECT 'entry.win_odds', 1 UNION ALL SELECT 'race', 0""")
def leakage_report(spark, d):
    found = V.audit(_standard(spark, d))
    return _report(spark, [(f"entry.{c}", 1) for c in found["entry"]] + [("race", len(found["race"]))])


@query(_BASE + """SELECT 'null rate horse_weight' AS kind, round(abs(avg(CASE WHEN s % 4 = 0 THEN 1.0 ELSE 0.0 END) - 0.9) * 1000000)::BIGINT AS violations FROM k
UNION ALL SELECT 'mean win_odds', round(abs(avg(q / 2) - 1) * 1000000)::BIGINT FROM k""")
def statistics_report(spark, d):
    tables = {"entry": _split(spark, d, "entry")}
    nulls = V.null_rate_differences(tables, {"entry": {"null_rates": {"horse_weight": 0.9, "horse_name": 0.0}}})["entry"]
    means = V.distribution_differences(tables, {"entry": {"distributions": {"win_odds": {"mean": 1.0}}}})["entry"]
    return _report(spark, [(f"null rate {c}", round(x * 1e6)) for c, x in nulls.items()] + [(f"mean {c}", round(x["diffs"]["mean"] * 1e6)) for c, x in means.items()])


# ---- training --------------------------------------------------------------------------------------------------------


def _features(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("race_id"), F.col("o_orderdate").cast("date").cast("string").alias("race_date"), (F.col("o_custkey") % 18 + 1).alias("horse_number"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target_top3"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 10 == 1).alias("exclude_from_training"),
    )


@query("SELECT o_orderkey AS race_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS race_date FROM orders WHERE o_orderdate >= '1996-01-01' AND CAST(o_orderdate AS DATE) <= '1998-12-31' AND o_orderkey % 10 <> 1")
def window_split(spark, d):
    return T.window(_features(spark, d), "1996-01-01", "1998-12-31").select("race_id", "race_date")


@query("""SELECT o_orderkey AS race_id, o_custkey % 18 + 1 AS horse_number, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey, o_custkey) AS place FROM orders QUALIFY place <= 50""")
def chronological_head(spark, d):
    first = _features(spark, d).orderBy("race_date", "race_id", "horse_number").limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy("race_date", "race_id", "horse_number"))).select("race_id", "horse_number", F.col("place").cast("long").alias("place"))


@query("SELECT round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM orders WHERE o_orderkey % 10 <> 1")
def target_rate(spark, d):
    return r6(_features(spark, d).where(P.either(~F.coalesce("exclude_from_training", F.lit(False)), F.lit(False))).agg(F.avg("target_top3").alias("rate")), "rate")


@query(_auc_sql("-pop").replace("-l_linenumber AS place FROM lineitem", "CASE WHEN l_linenumber <> 4 THEN CAST(l_linenumber AS DOUBLE) END AS pop FROM lineitem").replace("FROM s GROUP BY 1", "FROM s WHERE pop IS NOT NULL GROUP BY 1").replace(" AS auc FROM g x, g z", " AS baseline_auc, (SELECT CAST(sum(a + b) AS BIGINT) FROM g) AS n_rows FROM g x, g z"))
def popularity_baseline(spark, d):
    li = t(spark, d, "lineitem").select(F.xxhash64("*").alias("race_id"), F.col("l_linenumber").alias("horse_number"), (F.col("l_returnflag") == "R").cast("int").alias("target_top3"))
    entry = t(spark, d, "lineitem").select(F.xxhash64("*").alias("race_id"), F.col("l_linenumber").alias("horse_number"), F.when(F.col("l_linenumber") != 4, F.col("l_linenumber").cast("double")).alias("popularity"))
    return r6(M.popularity_baseline(li, entry), "baseline_auc")


@query("""WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_discount * 5 AS p FROM lineitem),
b AS (SELECT CAST(len(list_filter([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE], lambda e : p >= e)) AS INTEGER) AS bin, count(*) AS n, avg(y) AS a, avg(p) AS c FROM s GROUP BY 1)
SELECT i AS bin, coalesce(n, 0) AS n, round(a, 6) AS accuracy, round(coalesce(c, (i + 0.5) / 4), 6) AS confidence FROM (SELECT unnest([0, 1, 2, 3]) AS i) LEFT JOIN b ON bin = i""")
def reliability_bins(spark, d):
    return r6(M.reliability(_scored(spark, d).withColumn("p", F.col("p") / 2), "y", "p", 4), "accuracy", "confidence")


@query("""WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS c FROM x),
f AS (SELECT day, CASE WHEN i < (c % 4) * (c // 4 + 1) THEN i // (c // 4 + 1) ELSE (c % 4) + (i - (c % 4) * (c // 4 + 1)) // (c // 4) END AS chunk FROM n),
o AS (SELECT o_orderkey AS race_id, chunk FROM orders JOIN f ON day = CAST(o_orderdate AS DATE))
SELECT CAST(k AS INTEGER) AS fold, chunk <= k AS train, race_id FROM o, (SELECT unnest([0, 1, 2]) AS k) WHERE chunk <= k + 1""")
def fold_frames(spark, d):
    out = None
    for k, (train, val) in enumerate(DateFolds(3).split(_features(spark, d).select("race_id", "race_date"))):
        for df, is_train in ((train, True), (val, False)):
            own = df.select(F.lit(k).alias("fold"), F.lit(is_train).alias("train"), "race_id")
            out = own if out is None else out.unionByName(own)
    return out


@query("SELECT o_orderkey, CAST(chunk - 1 AS VARCHAR) AS fold, TRUE AS probable FROM orders JOIN (" + SQL["date_block_folds"] + ") f ON f.day = CAST(o_orderdate AS DATE) WHERE chunk > 0")
def gbt_oof_rows(spark, d):
    """The rows that the production job scores, by fold, and that every score is a probability."""
    return QUERIES["gbt_oof"](spark, d).select("o_orderkey", "fold", F.coalesce(F.col("p_raw").between(0, 1), F.lit(False)).alias("probable"))


@query("""WITH x AS (SELECT l_orderkey, l_shipdate < lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS late FROM lineitem)
SELECT l_orderkey, count(*) FILTER (late) AS violations FROM x GROUP BY 1 HAVING violations > 0""")
def sortedness(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return Q.out_of_order(li, "l_shipdate", ["l_linenumber", "l_partkey", "l_extendedprice"], ["l_orderkey"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS race_id, o_orderkey % 100 < 10 AS late FROM orders")
def key_shapes(spark, d):
    """Keys of exactly fourteen digits, from a race's twelve and a number of up to two."""
    race = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    df = t(spark, d, "orders").select("o_orderkey", P.composite_key(race, F.col("o_orderkey") % 100).alias("k")).where(F.col("k").rlike(r"^\d{14}$"))
    return df.select(F.col("o_orderkey").cast("string").alias("race_id"), (F.substring("k", 13, 1) == "0").alias("late"))


