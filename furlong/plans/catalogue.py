"""The operators on the given tables: QUERIES by name, and SQL that says the same independently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import parsing as P
from furlong.functions import racing as R
from furlong.ml import metrics as M
from furlong.operators import relational as O
from furlong.operators import windows as W
from furlong.quality import checks as Q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- windows ---------------------------------------------------------------------------------------------------------

_LAGS = [f"prev_{k}_value" for k in range(1, 6)]


def _lagged(spark, d):
    ev = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value").withColumn("value", F.when(F.col("event_type") != "signup", F.col("value")))
    return W.lag_features("user_id", ["ts", "event_id"], ["value"], P.not_in("event_type", ["error"]))(ev)


@query(f"""
WITH v AS (SELECT event_id, {', '.join(f"lag(CASE WHEN event_type <> 'signup' THEN value END, {k}) OVER w AS prev_{k}_value" for k in range(1, 6))}
  FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, {', '.join(_LAGS)} FROM events LEFT JOIN v USING (event_id)""")
def lag_raw_1_5(spark, d):
    return _lagged(spark, d).select("event_id", *_LAGS)


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'signup' THEN value END AS x FROM events WHERE event_type <> 'error'),
v AS (SELECT event_id, """ + ", ".join(
    f"avg(x) OVER w{n} AS prev{n}_value_mean, CASE WHEN count(x) OVER w{n} >= 2 THEN stddev_samp(x) OVER w{n} END AS prev{n}_value_std" for n in (3, 5)
) + """ FROM e WINDOW w3 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(prev3_value_mean, 6) AS prev3_value_mean, round(prev3_value_std, 6) AS prev3_value_std, round(prev5_value_mean, 6) AS prev5_value_mean, round(prev5_value_std, 6) AS prev5_value_std
FROM events LEFT JOIN v USING (event_id)""")
def trailing_mean_std_3_5(spark, d):
    cols = [f"prev{n}_value_{s}" for n in (3, 5) for s in ("mean", "std")]
    return r6(_lagged(spark, d).select("event_id", *cols), *cols)


@query("""
SELECT event_id, event_type <> 'error' AND NOT EXISTS (
  SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type <> 'error' AND (b.ts, b.event_id) < (a.ts, a.event_id)) AS is_debut
FROM events a""")
def debut_flag(spark, d):
    ev = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return W.debut("user_id", ["ts", "event_id"], P.not_in("event_type", ["error"]))(ev).select("event_id", "is_debut")


@query("""
WITH r AS (SELECT l_orderkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, count(m) OVER w AS c, avg(m) OVER w AS a, stddev_samp(m) OVER w AS sd FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
  WHERE m IS NOT NULL WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(CASE WHEN c >= 5 AND sd > 0 THEN (l_extendedprice - a) / sd END, 6) AS zscore
FROM lineitem JOIN s ON l_orderkey = o_orderkey""")
def expanding_zscore(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    both = li.join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority", "o_orderstatus"), "l_orderkey")
    out = W.expanding_zscore("l_orderkey", ["o_orderpriority", "o_orderstatus"], ["o_orderdate", "l_orderkey"], "l_extendedprice")(both)
    return r6(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "zscore"), "zscore")


def _entries(spark, d, person: str):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    od = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    if person == "c_nationkey":
        both = both.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    valid = F.col("l_returnflag") != "R"
    return both.withColumns({"valid": valid.cast("int"), "is_top": (valid & (F.col("l_linenumber") <= 3)).cast("int"), "is_win": (valid & (F.col("l_linenumber") == 1)).cast("int"), "day": F.col("o_orderdate").cast("date")})


def _rolling_sql(person: str) -> str:
    more = " JOIN customer ON c_custkey = o_custkey" if person == "c_nationkey" else ""
    return f"""
WITH e AS (SELECT {person} AS p, l_orderkey AS r, CAST(min(o_orderdate) AS DATE) AS day, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS v,
  sum(CASE WHEN l_returnflag <> 'R' AND l_linenumber <= 3 THEN 1 ELSE 0 END) AS t3, sum(CASE WHEN l_returnflag <> 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END) AS w
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey{more} GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY day, r) AS k FROM e WHERE v > 0),
b AS (SELECT a.p, a.r, a.day, (SELECT count(*) FROM n x WHERE x.p = a.p AND (x.day, x.r) < (a.day, a.r)) AS before FROM e a),
j AS (SELECT b.p, b.r, sum(n.v) AS v, sum(n.t3) AS t3, sum(n.w) AS w FROM b LEFT JOIN n ON n.p = b.p AND n.k <= b.before AND n.k > b.before - 100 AND n.day >= b.day - 365 GROUP BY 1, 2)
SELECT p AS {person}, r AS l_orderkey, round(t3 / nullif(v, 0), 6) AS top3_rate, round(w / nullif(v, 0), 6) AS win_rate, CAST(coalesce(v, 0) AS DOUBLE) AS rides FROM j"""


def _rolling(spark, d, person):
    out = W.rolling_dual(person, "l_orderkey", "day", {"top3": "is_top", "win": "is_win"}, "valid")(_entries(spark, d, person))
    return r6(out, "top3_rate", "win_rate")


@query(_rolling_sql("l_suppkey"))
def rolling_dual_supplier(spark, d):
    return _rolling(spark, d, "l_suppkey")


@query(_rolling_sql("c_nationkey"))
def rolling_dual_nation(spark, d):
    return _rolling(spark, d, "c_nationkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(l_quantity) OVER (PARTITION BY l_orderkey) AS field_size FROM lineitem")
def field_size(spark, d):
    return W.field_size("l_orderkey", "l_quantity")(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).drop("l_quantity")


@query("""
WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS c FROM x)
SELECT day, CAST(CASE WHEN i < (c % 6) * (c // 6 + 1) THEN i // (c // 6 + 1) ELSE (c % 6) + (i - (c % 6) * (c // 6 + 1)) // (c // 6) END AS INTEGER) AS chunk FROM n""")
def date_block_folds(spark, d):
    return W.date_folds(t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day", 5).select("day", F.col("chunk").cast("int").alias("chunk"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) <= greatest(1, floor((SELECT count(*) FROM orders) * 0.2)) AS is_val FROM orders""")
def inner_tail_split(spark, d):
    return W.inner_tail(t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), "o_orderkey", "day", 0.2)


# ---- expressions -----------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'scratched' WHEN 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'dnf' ELSE 'finished' END ELSE 'finished' END AS status,
  l_returnflag = 'R' AS exclude_from_training, l_returnflag = 'A' AND l_linestatus = 'F' AS is_dnf FROM lineitem""")
def status_case(spark, d):
    note = F.when(F.col("l_returnflag") == "R", "取").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "中")
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", note.alias("note")).withColumn("status", R.status("note"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "status", F.col("status").isin("scratched", "removed").alias("exclude_from_training"), F.col("status").isin("dnf", "disqualified").alias("is_dnf"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(1 + (SELECT count(*) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_extendedprice > a.l_extendedprice) <= 3 AS BIGINT) AS target FROM lineitem a""")
def target_topk(spark, d):
    from pyspark.sql import Window

    place = F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc()))
    df = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").withColumn("place", place)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.coalesce((F.col("place") <= 3).cast("long"), F.lit(0)).alias("target"))


@query("SELECT c_custkey, c_name || '_' || (2000 - nullif(c_nationkey, 7)) AS entity_key FROM customer")
def entity_key(spark, d):
    return t(spark, d, "customer").select("c_custkey", P.entity_key("c_name", F.lit(2000), F.nullif(F.col("c_nationkey"), F.lit(7))).alias("entity_key"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || CASE WHEN l_linenumber * 30 < 10 THEN '0' ELSE '' END || (l_linenumber * 30 - 29) AS k FROM lineitem WHERE l_linenumber * 30 - 29 >= 10 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || '0' || (l_linenumber * 30 - 29) FROM lineitem WHERE l_linenumber * 30 - 29 < 10")
def composite_key(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.composite_key("l_orderkey", F.col("l_linenumber") * 30 - 29).alias("k"))


_SIZE = "CASE p_size % 9 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} WHEN 5 THEN {5} WHEN 6 THEN {6} WHEN 7 THEN {7} ELSE {8} END"


@query("SELECT p_partkey, CAST(" + _SIZE.format("0.02", "0.10", "1.5", "15", "1.35", "NULL", "NULL", "0", "NULL") + " AS DOUBLE) AS lengths FROM part")
def margin_parse(spark, d):
    text = F.expr(_SIZE.format("'ハナ'", "' クビ　'", "'1.1/2'", "'大'", "'1.1/4+クビ'", "'2.1/4'", "''", "'同着'", "NULL"))
    return t(spark, d, "part").select("p_partkey", F.round(P.margin_lengths(text), 6).alias("lengths"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 6 OR l_linenumber = 7 THEN NULL ELSE round(60 + l_quantity + l_linenumber / 10.0, 6) END AS seconds FROM lineitem""")
def clock_parse(spark, d):
    good = F.concat(F.lit("1:"), F.col("l_quantity").cast("int").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    text = F.when(F.col("l_linenumber") == 6, "1:2:3").when(F.col("l_linenumber") == 7, "x:1").otherwise(good)
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(P.clock_seconds(text), 6).alias("seconds"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(400 + p_size AS DOUBLE) END AS weight, CASE WHEN p_size % 5 = 0 OR p_size % 5 = 1 THEN NULL ELSE CAST(p_size - 25 AS DOUBLE) END AS change FROM part""")
def weight_parse(spark, d):
    w, c = (F.col("p_size") + 400).cast("string"), F.col("p_size") - 25
    text = F.when(F.col("p_size") % 5 == 0, "計不").when(F.col("p_size") % 5 == 1, w).otherwise(F.concat(w, F.lit("("), F.when(c > 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string")), F.lit(")")))
    return t(spark, d, "part").select("p_partkey", P.weight_and_change(text).alias("x")).select("p_partkey", "x.*")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '牡' WHEN 1 THEN '牝' WHEN 2 THEN 'セ' END AS sex, CASE WHEN p_size % 4 < 3 THEN CAST(p_size AS BIGINT) END AS age FROM part""")
def sexage_parse(spark, d):
    sign = F.when(F.col("p_size") % 4 == 0, "牡").when(F.col("p_size") % 4 == 1, "牝").when(F.col("p_size") % 4 == 2, "セ").otherwise("x")
    return t(spark, d, "part").select("p_partkey", P.sex_and_age(F.concat(sign, F.col("p_size").cast("string"))).alias("x")).select("p_partkey", "x.*")


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS corner_1, CAST(NULL AS DOUBLE) AS corner_2, CAST(p_size + 1 AS DOUBLE) AS corner_3, CASE WHEN p_size % 2 = 0 THEN CAST(7 AS DOUBLE) END AS corner_4 FROM part""")
def corners_parse(spark, d):
    n = F.col("p_size")
    text = F.concat(n.cast("string"), F.lit("-x- -"), (n + 1).cast("string"), F.when(n % 2 == 0, "－7-9").otherwise(""))
    return t(spark, d, "part").select("p_partkey", P.corners(text).alias("x")).select("p_partkey", "x.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1, 2) THEN CAST(p_size % 18 AS BIGINT) END AS position, CASE p_size % 5 WHEN 1 THEN '降' WHEN 2 THEN '降' WHEN 3 THEN '中' END AS note FROM part""")
def finish_cell_parse(spark, d):
    n, k = (F.col("p_size") % 18).cast("string"), F.col("p_size") % 5
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit("(降)"))).when(k == 2, F.concat(n, F.lit("降"))).when(k == 3, "中").otherwise(" ")
    return t(spark, d, "part").select("p_partkey", P.finish_cell(text).alias("x")).select("p_partkey", "x.*")


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '東' WHEN 1 THEN '西' END AS region, s_name AS name FROM supplier""")
def region_split(spark, d):
    k = F.col("s_suppkey") % 3
    text = F.concat(F.when(k == 0, "[東] ").when(k == 1, "[西]").otherwise("　"), F.col("s_name"))
    return t(spark, d, "supplier").select("s_suppkey", P.region_and_name(text).alias("x")).select("s_suppkey", "x.*")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 END AS flag FROM part")
def flags_tristate(spark, d):
    return t(spark, d, "part").select("p_partkey", P.tri_state(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, "")).cast("int").alias("flag"))


_COND = {0: "3歳(混)(牝)未勝利", 1: "オープン(別定)(L)", 2: "", 3: "重賞(ハンデ)", 4: "古馬[指](定量)"}


@query("""SELECT p_partkey, CASE WHEN k = 3 THEN 1 END AS handicap, CASE WHEN k = 0 THEN 1 END AS filly_only, CASE WHEN k = 0 THEN 1 END AS maiden, CASE WHEN k = 1 THEN 1 END AS listed,
  CASE WHEN k = 3 OR (k <> 2 AND p_size % 7 = 0) THEN 1 END AS stakes, CASE WHEN k <> 2 AND p_size % 7 = 0 THEN 1 END AS graded_stakes, CASE WHEN k = 4 THEN 1 END AS condition_race FROM (SELECT *, p_size % 5 AS k FROM part)""")
def flags_derive(spark, d):
    cond = F.when(F.lit(False), "")
    for k, text in _COND.items():
        cond = cond.when(F.col("p_size") % 5 == k, text)
    df = t(spark, d, "part").select("p_partkey", cond.alias("cond"), F.when(F.col("p_size") % 7 == 0, "某記念(GII)").alias("name"))
    flags = R.race_flags("cond", "name")
    return df.select("p_partkey", *[flags[f].cast("int").alias(f) for f in ("handicap", "filly_only", "maiden", "listed", "stakes", "graded_stakes", "condition_race")])


@query("SELECT p_partkey, coalesce(p_size % 2 = 0 AND p_size % 3 <> 0, FALSE) OR p_size % 5 = 0 AS merged FROM part")
def grade_or_merge(spark, d):
    old = F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 2 == 0)
    return t(spark, d, "part").select("p_partkey", P.either(old, F.when(F.col("p_size") % 5 == 0, True)).alias("merged"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name END AS label FROM customer")
def coalesce_select(spark, d):
    k = F.col("c_custkey") % 3
    df = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "").alias("a"), F.when(k != 2, F.col("c_name")).otherwise("").alias("b"))
    return O.coalesce_select(df, {"id": ["id"], "label": ["a", "b"]}).select(F.col("id").cast("long").alias("c_custkey"), "label")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_prop(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderstatus IS DISTINCT FROM 'F'")
def date_obstacle_filter(spark, d):
    return t(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & ~F.col("o_orderstatus").eqNullSafe("F")).select("o_orderkey", "o_totalprice")


# ---- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate::DATE AS day, o_orderpriority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey")
def join_left_dim(spark, d):
    od = t(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(od, "l_orderkey", "left")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_inner_1to1(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi_valid(spark, d):
    ok = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("k"))
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.join(ok, li.l_orderkey.cast("string") == ok.k, "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_orphans(spark, d):
    return O.orphans(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("""
WITH x AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), y AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1),
j AS (SELECT coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b FROM x FULL JOIN y USING (k))
SELECT count(*) FILTER (a > b) AS only_left, count(*) FILTER (b > a) AS only_right, count(*) FILTER (a <> b AND a > 0 AND b > 0) AS count_mismatch FROM j""")
def full_outer_multiset(spark, d):
    li = t(spark, d, "lineitem").select("l_partkey", "l_linenumber")
    return O.multiset_difference(li.where("l_linenumber <= 3"), li.where("l_linenumber > 2"), "l_partkey")


@query("SELECT round((SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))::DOUBLE / (SELECT count(DISTINCT o_orderkey) FROM orders), 6) AS overlap")
def key_overlap_rate(spark, d):
    return r6(O.key_overlap(t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k"), "overlap")


# ---- aggregates ------------------------------------------------------------------------------------------------------


@query("""SELECT l_suppkey, l_orderkey, sum(CASE WHEN l_returnflag <> 'R' AND l_linenumber <= 3 THEN 1 ELSE 0 END)::BIGINT AS top3, sum(CASE WHEN l_returnflag <> 'R' AND l_linenumber = 1 THEN 1 ELSE 0 END)::BIGINT AS win,
  sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::BIGINT AS valid, min(o_orderdate)::DATE AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def person_race_sums(spark, d):
    return _entries(spark, d, "l_suppkey").groupBy("l_suppkey", "l_orderkey").agg(F.sum("is_top").alias("top3"), F.sum("is_win").alias("win"), F.sum("valid").alias("valid"), F.min("day").alias("day"))


@query("SELECT l_orderkey, round(avg(l_extendedprice), 6) AS mean_price, count(*) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY 1")
def race_means(spark, d):
    return r6(t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("mean_price"), F.count("*").alias("n"), F.max("l_returnflag").alias("flag")), "mean_price")


@query("""SELECT strftime(o_orderdate, '%Y%m') AS month, o_orderstatus, count(*) AS n, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders
GROUP BY GROUPING SETS ((strftime(o_orderdate, '%Y%m'), o_orderstatus), (strftime(o_orderdate, '%Y%m')), (o_orderstatus), ())""")
def status_summary_grouping_sets(spark, d):
    df = t(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"), "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    m, s = F.col("month"), F.col("o_orderstatus")
    return df.groupingSets([[m, s], [m], [s], []], m, s).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


# ---- dedup and sets --------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_keep_first(spark, d):
    return O.keep_first(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders
UNION ALL SELECT o_orderkey + 100000000, 'new' FROM orders WHERE o_orderkey % 10 = 0""")
def upsert_keep_last(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    new = old.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("new"))
    return O.upsert(old, new.unionByName(new.withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)), ["o_orderkey"], [F.col("o_orderstatus")])


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 100000000, s_name FROM supplier")
def union_strict(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return O.union_strict(a, t(spark, d, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") + 100_000_000).alias("k")), ["k"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_ids(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(t(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_ids(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(t(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber > 3")
def exceptall_multiset(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_linenumber")
    return li.where("l_linenumber <= 3").select("k").exceptAll(li.where("l_linenumber > 3").select("k"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, 'quantity' AS kind, round(l_quantity / 10, 6) AS value FROM lineitem WHERE l_quantity > 5
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'discount', round(l_discount / 10, 6) FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'tax', round(l_tax / 10, 6) FROM lineitem""")
def unpivot_3(spark, d):
    value = {"quantity": F.when(F.col("l_quantity") > 5, F.col("l_quantity")), "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    wide = [{"kind": F.lit(k), "value": F.round(v / 10, 6)} for k, v in value.items()]
    return O.unpivot(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], wide, ["value"])


# ---- quality ---------------------------------------------------------------------------------------------------------


def _holed(spark, d):
    return t(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))


@query("""SELECT 'o_orderkey' AS "column", 0.0::DOUBLE AS null_rate UNION ALL SELECT 'o_totalprice', round(avg(CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM orders UNION ALL SELECT 'absent', 1.0""")
def null_rates(spark, d):
    return r6(Q.null_rates(_holed(spark, d), ["o_orderkey", "o_totalprice", "absent"]), "null_rate")


@query("""SELECT 'o_totalprice' AS "column", round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 'o_orderstatus', NULL, NULL, NULL""")
def profile_min_max_mean(spark, d):
    return r6(Q.profile(_holed(spark, d), ["o_totalprice", "o_orderstatus"]), "min", "max", "mean")


@query("""SELECT 'quantity' AS rule, count(*) FILTER (l_quantity > 49) AS violations FROM lineitem UNION ALL SELECT 'line', count(*) FILTER (l_linenumber NOT BETWEEN 1 AND 6) FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem""")
def value_ranges(spark, d):
    rules: dict[str, Column] = {"quantity": F.col("l_quantity") <= 49, "line": F.col("l_linenumber").between(1, 6), "flag": F.col("l_returnflag").isin("A", "N")}
    return Q.value_ranges(t(spark, d, "lineitem"), rules)


@query("WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT count(*) FILTER (n > 1) AS duplicate_keys, sum(n - 1)::BIGINT AS extra_rows FROM c")
def dup_keys(spark, d):
    return Q.duplicate_keys(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH c AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey) SELECT max(n) AS most, count(*) FILTER (n > 1) AS violations FROM c")
def fd_check(spark, d):
    return Q.functional_dependency(t(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT 'orders' AS child, count(DISTINCT o_custkey) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) UNION ALL SELECT 'lineitem', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def ref_integrity(spark, d):
    a = O.orphans(t(spark, d, "orders").select(F.col("o_custkey").alias("k")), t(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k")), "k")
    b = O.orphans(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k")
    return a.agg(F.count("*").alias("orphans")).select(F.lit("orders").alias("child"), "orphans").unionByName(b.agg(F.count("*").alias("orphans")).select(F.lit("lineitem").alias("child"), "orphans"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 5")
def hash_sample(spark, d):
    return Q.hash_sample(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5)


# ---- metrics ---------------------------------------------------------------------------------------------------------


def _scored(spark, d):
    return t(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"), (-F.col("l_linenumber")).alias("place"))


_S = "WITH s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS y, l_discount * 10 AS p, -l_linenumber AS place FROM lineitem), "
_B = "b AS (SELECT len(list_filter([0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE], lambda e : p >= e)) AS bin, y, p FROM s)"


@query(_S + _B + " SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(y), 6) AS accuracy, round(avg(p), 6) AS confidence FROM b GROUP BY 1")
def ece_bins(spark, d):
    return r6(M.ece_bins(_scored(spark, d), "y", "p"), "accuracy", "confidence")


@query(_S + _B + " SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(y) AS a, avg(p) AS c FROM b GROUP BY bin)")
def ece(spark, d):
    return r6(M.ece(_scored(spark, d), "y", "p"), "ece")


@query(_S[:-2] + " SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM s")
def brier(spark, d):
    return r6(M.brier(_scored(spark, d), "y", "p"), "brier")


@query(_S[:-2] + " SELECT round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS logloss FROM (SELECT y, greatest(least(p, 1 - 2.220446049250313e-16::DOUBLE), 2.220446049250313e-16::DOUBLE) AS q FROM s)")
def logloss(spark, d):
    return r6(M.log_loss(_scored(spark, d), "y", "p"), "logloss")


def _auc_sql(score: str) -> str:
    return _S + f"""g AS (SELECT {score} AS p, sum(y) AS a, sum(1 - y) AS b FROM s GROUP BY 1)
SELECT round(sum(x.a * z.b * CASE WHEN x.p > z.p THEN 1 WHEN x.p = z.p THEN 0.5 ELSE 0 END) / ((SELECT sum(a) FROM g) * (SELECT sum(b) FROM g)), 6) AS auc FROM g x, g z"""


@query(_auc_sql("p"))
def auc_ties(spark, d):
    return r6(M.auc(_scored(spark, d), "y", "p"), "auc")


@query(_auc_sql("place"))
def baseline_auc(spark, d):
    return r6(M.auc(_scored(spark, d), "y", "place", empty=0.5), "auc")


def _modelled(spark, d):
    from furlong.ml.models import out_of_fold

    days = W.date_folds(t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day", 5)
    own = t(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", F.length("o_orderpriority").alias("width"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return out_of_fold(own.join(days, "day"), ["o_totalprice", "width"], "y", "chunk", 5, "o_orderkey", "day")


@query()
def gbt_oof(spark, d):
    return r6(_modelled(spark, d).select("o_orderkey", "fold", "p_raw"), "p_raw")


#: The isotonic fit of few distinct scores, by its definition: the largest, over starts at or below, of the least mean to an end at or above.
@query(_S[:-2] + """, g AS (SELECT p, sum(y) AS k, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT a.p AS lo, b.p AS hi, (SELECT sum(k) / sum(n) FROM g WHERE p BETWEEN a.p AND b.p) AS mean FROM g a JOIN g b ON a.p <= b.p)
SELECT g.p, round(k / n, 6) AS y, n, round((SELECT max(least_mean) FROM (SELECT lo, min(mean) AS least_mean FROM m WHERE lo <= g.p AND hi >= g.p GROUP BY lo)), 6) AS p_calibrated FROM g""")
def isotonic_apply(spark, d):
    from furlong.ml.models import apply_isotonic, fit_isotonic

    scored = _scored(spark, d).groupBy("p").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    return r6(apply_isotonic(fit_isotonic(_scored(spark, d), "p", "y"), scored, "p"), "y", "p_calibrated")


# ---- pages -----------------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages""")
def html_title_h1(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS pos FROM pages)
SELECT page_id, link, CAST(min(pos) AS BIGINT) AS first_position FROM l GROUP BY 1, 2""")
def html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "link")).groupBy("page_id", "link").agg((F.min("pos") + 1).cast("long").alias("first_position"))


@query("SELECT strftime(m, '%Y%m') AS month FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)")
def range_enumeration(spark, d):
    ends = t(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    months = F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month")))
    return ends.select(months.alias("m")).select(F.date_format("m", "yyyyMM").alias("month"))


@query("SELECT page_id, html IS NULL OR length(html) < 500 OR regexp_matches(lower(html), 'アクセス制限|robot|captcha|403 forbidden') OR html NOT LIKE '%<article>%' AS blocked FROM pages")
def block_page(spark, d):
    from furlong.sources.pages import blocked

    return t(spark, d, "pages").select("page_id", blocked("html", "<article>").alias("blocked"))
