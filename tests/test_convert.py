"""Raw CSV files and result pages to the standard layer, its validation, integration and status."""

import datetime

import pytest
from pyspark.sql import functions as F

from furlong import cli
from furlong import schemas as S
from furlong.plans import convert as C
from furlong.plans import integrate as G
from furlong.quality import checks as Q
from furlong.quality import validate as V
from furlong.schemas import columns as H
from furlong.sources import result_pages as RP
from furlong.sources import scrape as X
from furlong.sources import tables as T

RUNNER = {
    "開催回数": "1", "競馬場コード": "05", "競馬場名": "東京", "開催日数": "2", "競争条件": "4歳以上", "レース番号": "1", "レース名": "某", "芝・ダート区分": "芝",
    "右左回り・直線区分": "左", "距離(m)": "1600", "天候": "晴", "馬場状態1": "良", "発走時刻": "09:55", "枠番": "1", "馬名": "甲", "性別": "牡", "馬齢": "4", "斤量": "55.0",
    "騎手": "乙", "タイム": "1:35.0", "着差": "クビ", "単勝": "3.5", "人気": "2", "馬体重": "480", "場体重増減": "-2", "調教師": "丙", "馬主": "丁", "賞金(万円)": "100.0",
}


def csv_files(folder):
    """Two flat races of 2015, one of a kind that is left out, one of 2014 and one without a date."""
    headers = [*H.RESULTS, H.UNUSED_FLAG]
    rows = []
    for race, day, kind, runners in [("201505010101", "2015-01-05", "", 3), ("201505010102", "2015/1/5", "", 2), ("201505010103", "2015-01-05", "障害", 2), ("201405010101", "2014-12-28", "", 1), ("201505010109", "", "", 1)]:
        for n in range(1, runners + 1):
            note = {2: "降", 3: "中"}.get(n, "")
            row = RUNNER | {"レース馬番ID": f"{race}{n:02d}", "レースID": race, "レース日付": day, "障害区分": kind, "馬番": str(n), "着順": str(n), "着順注記": note}
            row |= {"レース記号/(混)": "(混)" if race.endswith("01") else "", "レース記号/(市)": "(市)" if n == 9 else "", "リステッド・重賞競走": "L" if race.endswith("02") else ""}
            rows.append(",".join(row.get(h, "") for h in headers))
    (folder / "x_race_result.csv").write_text("﻿" + "\n".join([",".join(headers), *rows]) + "\n", encoding="utf-8")
    odds = [H.RACE_KEY, *H.ODDS]
    lines = ["201505010101,1,2,3,990,1,1,2,,,2,,,,,", "201505010103,1,2,3,100,1,,,,,,,,,,", "209905010101,1,2,3,100,1,,,,,,,,,,"]
    (folder / "x_odds.csv").write_text("﻿" + "\n".join([",".join(odds), *lines]) + "\n", encoding="utf-8")


def test_schemas(tmp_path):
    assert [len(s.fields) for s in S.TABLES.values()] == [41, 16, 12, 16, 6] and len(H.RESULTS) == 65 and len(H.text_columns()) == 25
    assert Q.post_event_columns(S.TABLES["race"]) == [] and Q.post_event_columns(S.TABLES["entry"]) == S.LATE_ENTRY
    assert len(Q.post_event_columns(S.TABLES["result"])) == 12
    out = S.export(f"{tmp_path}/a/s.json")
    assert set(out) == set(S.TABLES) and "pre_race" in (tmp_path / "a/s.json").read_text()
    assert set(H.sources("race")["race_flag_allowance"]) == {"レース記号/(混)", "レース記号/(市)", "レース記号/九州産馬"}


def test_convert_and_validate(spark, tmp_path):
    raw, std = tmp_path / "raw", f"{tmp_path}/std"
    raw.mkdir()
    with pytest.raises(FileNotFoundError, match="results and odds"):
        C.convert(spark, str(raw), std)
    csv_files(raw)
    assert C.undated(T.read_csv_text(spark, C.find_csv(spark, str(raw), C.RESULTS_FILE))) == 1
    paths = C.convert(spark, str(raw), std)
    assert set(paths) == set(S.TABLES)
    got = {t: {r[S.PRIMARY_KEY[t]]: r for r in spark.read.parquet(p).collect()} for t, p in paths.items()}
    assert set(got["race"]) == {"201505010101", "201505010102"} and len(got["entry"]) == len(got["result"]) == 5
    one, two = got["race"]["201505010101"], got["race"]["201505010102"]
    assert one.race_flag_allowance is True and two.race_flag_allowance is None and one.race_date == two.race_date == "2015-01-05"
    assert two.race_flag_listed and two.race_flag_stakes and not one.race_flag_listed and one.race_flag_maiden is None
    r = got["result"]
    assert [(r[f"20150501010{k}"].finish_position, r[f"20150501010{k}"].finish_note) for k in ("101", "102", "103")] == [(1, None), (2, "降"), (None, "中")]
    assert got["odds_trifecta"]["201505010101"].trifecta1_odds == 990 and set(got["odds_trifecta"]) == {"201505010101"}
    assert [(p.combo_1, p.odds, p.payoff_amount) for p in got["payoff"].values()] == [(1, 99.0, None)]
    assert spark.read.parquet(paths["entry"]).schema["win_odds"].metadata["pre_race"] is False
    stats = {"race": {"null_rates": {"grade": 0.5}, "distributions": {"distance": {"min": 1600, "max": 1600, "mean": 1600}}}}
    done = V.run_all(spark, str(raw), std, {"race": 2, "entry": 5}, stats)
    assert done["overall_pass"], done
    tables = V.load(spark, std)
    assert V.row_counts(tables, {"race": 3, "none": 0}) == {"race": False, "none": False}
    bad = tables | {"race": tables["race"].drop("grade").withColumns({"distance": F.lit(0.5), "course_code": F.lit("11"), "surface": F.lit(1)}), "result": tables["result"].limit(1)}
    assert V.conformance(bad)["race"] == ["Missing column: grade", "Type of surface: int for string", "Type of distance: double, 2 values do not fit"]
    assert len(V.ranges(bad)["race"]) == 1 and "one to one" in V.referential(bad)[0]
    assert V.null_rate_differences(bad, {"race": {"null_rates": {"grade": 0.5, "weather": 0.0}}}) == {"race": {"grade": 1.0}}
    assert not V.sample_rows(spark, tables | {"entry": tables["entry"].withColumn("age", F.lit(9))}, str(raw))["entry"]
    assert not V.sample_rows(spark, tables | {"race": tables["race"].withColumn("race_flag_allowance", F.lit(False))}, str(raw))["race"]
    assert V.sample_rows(spark, {"race": tables["race"].limit(0)}, str(raw)) == {"race": False}
    with pytest.raises(KeyError, match="flag"):
        C.with_grades(tables["race"].drop("race_flag_listed"))
    core = C.convert(spark, str(raw), f"{tmp_path}/two", "csv")
    assert set(core) == set(S.CORE) and not T.exists(spark, f"{tmp_path}/two/payoff.parquet")


LINES = [("1", "3", "6", "<a href='/horse/1/'>馬&amp;甲</a>", "牡4", "58.0", "乙", "2:09.7", "", "2-2-1-1", "35.7", "4.5", "2", "470(-4)", "[西]\n丙", "丁", "20000.0"), ("3(降)", "4", "7", "馬乙", "セ5", "58", "乙", "2:10.0", "クビ", "3-3-3-3-9", "36.0", "10", "5", "計不", "丙", "丁", ""), ("取", "5", "8", "馬丙", "牝3", "54", "乙", "", "", "", "", "---", "", "400", "[東]丙", "丁", "1,0")]
HEAD = ("着順", "枠番", "馬番", "馬名", "性齢", "斤量", "騎手", "タイム", "着差", "通過", "上り", "単勝", "人気", "馬体重", "調教師", "馬主", "賞金")


def page(condition="3歳以上オープン (国際)(指)(定量)", course="芝右 外2200m", day="2023年6月25日"):
    body = "".join("<tr>" + "".join(f"<td>{c}" for c in line) + "</tr>" for line in LINES)
    return f"""<html><head><title>宝塚記念｜2023年 | site</title><script>var s = "天候 : 偽";</script></head><body><h1>logo</h1><h1>第64回宝塚記念(GI)</h1>
<p class="smalltxt">{day} 3回阪神8日目 {condition}</p><span>{course} / 天候 : 晴 / 芝 : 良 / 発走 : 15:40</span><p>{"x" * 400}
<table class="race_table_01 nk"><tr>{"".join(f"<th>{h}" for h in HEAD)}</tr>{body}<tr><td colspan=17>注</td></tr></table></body></html>"""


def test_pages(spark):
    over = page("障害4歳以上未勝利", "障芝 ダート3110m")
    df = spark.createDataFrame([("202309030811", page()), ("202309030801", over), ("foo", page()), ("202309030802", None), ("202309030803", "<table><tr><th>馬番<tr><td>x<tr><td>５</table>")], "race_id string, html string")
    out = RP.tables(df)
    race = {r.race_id: r for r in out["race"].collect()}
    r = race["202309030811"]
    assert (r.race_date, r.meeting_num, r.course_code, r.meeting_day, r.race_condition) == ("2023-06-25", 3, "09", 8, "3歳以上オープン (国際)(指)(定量)")
    assert (r.race_name, r.grade, r.grade_revision, r.surface, r.direction, r.distance, r.weather, r.track_condition, r.start_time, r.race_number) == ("宝塚記念", "GI", "64", "芝", "右", 2200, "晴", "良", "15:40", 11)
    assert r.race_flag_graded_stakes and r.race_flag_stakes and r.race_flag_open and r.race_flag_bonus_weight and r.race_flag_condition_race and r.race_flag_listed is None
    o = race["202309030801"]
    assert (o.obstacle, o.surface, o.direction, o.distance) == ("障害", "ダート", None, 3110)
    assert race["202309030802"].race_date is None and [r.race_id for r in RP.rejected(df).collect()] == ["foo"]
    e = {x.horse_race_id: x for x in out["entry"].where("race_id = '202309030811'").collect()}
    a, b, c = (e[f"2023090308110{k}"] for k in (6, 7, 8))
    assert (a.horse_name, a.sex, a.age, a.horse_weight, a.weight_change, a.region, a.trainer, a.win_odds, a.popularity) == ("馬&甲", "牡", 4, 470.0, -4.0, "西", "丙", 4.5, 2.0)
    assert (b.horse_weight, b.region, b.trainer) == (None, None, "丙") and (c.win_odds, c.horse_weight, c.region) == (None, 400.0, "東")
    f = {x.horse_race_id[-2:]: x for x in out["result"].where("race_id = '202309030811'").collect()}
    assert [(f[k].finish_position, f[k].finish_note) for k in ("06", "07", "08")] == [(1, None), (3, "降"), (None, "取")]
    assert (f["06"].corner_4, f["07"].corner_4, f["08"].corner_1, f["06"].prize_money, f["08"].prize_money) == (1.0, 3.0, None, 20000.0, None)
    assert out["race"].schema["race_id"].metadata["pre_race"] is True and out["entry"].columns == list(S.kinds("entry"))


class Site:
    """A month with three days, of which the last lies outside the range, and a race that has no page."""

    def __init__(self):
        self.asked = []
        self.pages = {
            "https://s.example/race/list/202306/": "".join(f'<a href="/race/list/{d}/">x</a>' for d in ("20230610", "20230610", "20230611", "20231399", "20230630")) + '<a href="/horse/1">y</a>',
            "https://s.example/race/list/20230610/": '<a href="/race/202309030811/">a</a><a href="/race/202309030811">b</a><a href="/race/202399030811/">c</a><a href="/race/12/">d</a>',
            "https://s.example/race/list/20230611/": '<a href="/race/202309030811/">a</a><a href="/race/202309030812/">e</a><a href="/race/202309030801/">f</a>',
            "https://s.example/race/202309030811/": page(), "https://s.example/race/202309030801/": page("障害4歳以上"), "https://s.example/race/202309030812/": "captcha" * 200,
        }

    def __call__(self, url):
        self.asked.append(url)
        return self.pages.get(url)


def test_scrape_status_and_integration(spark, tmp_path, capsys):
    site, raw, std = Site(), f"{tmp_path}/raw", f"{tmp_path}/std"
    a, b = datetime.date(2023, 6, 1), datetime.date(2023, 6, 20)
    cli.status(spark, std)
    assert "no scraped data" in capsys.readouterr().out
    for _ in range(2):
        done = X.scrape(spark, a, b, site, "https://s.example", raw, std)
        assert done["race"].rows == {"202306": 1} and done["entry"].rows == {"202306": 3} and not done["entry"].skipped
    # list pages and good race pages are asked for once, a refused one again
    assert site.asked.count("https://s.example/race/list/202306/") == 1 and site.asked.count("https://s.example/race/202309030811/") == 1 and site.asked.count("https://s.example/race/202309030812/") == 2
    assert [r.race_id for r in X.enumerate_races(a, b, site, "https://s.example")] == ["202309030811", "202309030812", "202309030801"]
    cli.status(spark, std)
    said = capsys.readouterr().out
    assert "race=1 entry=3 result=3" in said and "202306   3      1" in said and "2023-06-25 ~ 2023-06-25" in said
    with pytest.raises(ValueError, match="transport"):
        X.scrape(spark, a, b, None, "https://s.example", raw, std)
    with pytest.raises(FileNotFoundError):
        G.integrate_standard_layer(spark, std)
    folder = tmp_path / "csv"
    folder.mkdir()
    csv_files(folder)
    C.convert(spark, str(folder), std, "csv")
    for _ in range(2):
        out = G.integrate_standard_layer(spark, std)
        assert out["audit"] == {"race": [], "entry": S.LATE_ENTRY} and spark.read.parquet(out["entry"]).count() == 8
    spark.read.parquet(f"{std}/csv/race.parquet").drop("grade").write.parquet(f"{tmp_path}/less")
    T.swap(spark, [(f"{tmp_path}/less", f"{std}/csv/race.parquet")])
    with pytest.raises(ValueError, match="missing columns \\['grade'\\]"):
        G.integrate_standard_layer(spark, std)
    with pytest.raises(ValueError, match="month"):
        T.read_months(spark, f"{tmp_path}/raw", ["race"])


def test_sessions_and_paths(tmp_path):
    slept, tries = [], []

    def get(url):
        tries.append(url)
        raise OSError("no")

    with X.Session(get, sleep=slept.append) as s:
        assert s("u") is None
    assert len(tries) == 3 and slept == [2.0, 4.0, 2.0, 6.0, 2.0]
    assert X.cache_path("https://s/race/list/202306/", "r").as_posix() == "r/2023/calendar/06.html"
    assert X.cache_path("https://s/race/list/20230610", "r").as_posix() == "r/2023/06/20230610_day.html" and X.cache_path("https://s/race/1/", "r") is None
    assert X.page_path(X.RaceRef("202309030811", datetime.date(2022, 1, 5)), "r").as_posix() == "r/2022/01/202309030811.html"
    with pytest.raises(ValueError):
        X.page_path(X.RaceRef("1", datetime.date(2022, 1, 5)), "r")
    assert X.is_blocked(None) and X.is_blocked("x" * 600) and not X.is_blocked(page()) and X.is_blocked(page() + "CAPTCHA")
    assert X.months_between(datetime.date(2022, 11, 5), datetime.date(2023, 2, 1)) == [(2022, 11), (2022, 12), (2023, 1), (2023, 2)]
    a = cli.parser().parse_args(["scrape", "--start", "2023-01-01", "--end", "2023-01-31", "--base", "https://s", "--max-races", "3"])
    assert a.max_races == 3 and a.start == datetime.date(2023, 1, 1)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["scrape", "--start", "2023-13-01", "--end", "2023-01-31", "--base", "https://s"])


def test_months_route_and_recover(spark, tmp_path):
    root = f"{tmp_path}/m"
    kids = spark.createDataFrame([("a1", "a"), ("b1", "b"), ("c1", "c")], "horse_race_id string, race_id string")
    races = spark.createDataFrame([("a", "2023-01-05"), ("b", "2023-02-05"), ("c", None)], "race_id string, race_date string")
    with pytest.raises(KeyError, match="routes"):
        T.upsert_months(kids, root, "entry", ["horse_race_id"], [F.col("race_id")])
    done = T.upsert_months(kids, root, "entry", ["horse_race_id"], [F.col("race_id")], routes=races)
    assert done.rows == {"202301": 1, "202302": 1} and done.skipped == 1
    # another column set replaces the month, which is said; of two new rows of a key the last in the order stays
    wide = spark.createDataFrame([("a1", "a", 1), ("a1", "a", 2)], "horse_race_id string, race_id string, x int")
    done = T.upsert_months(wide, root, "entry", ["horse_race_id"], [F.col("x")], routes=races)
    assert done.replaced == {"202301": 1} and [r.x for r in spark.read.parquet(f"{root}/202301/entry.parquet").collect()] == [2]
    done = T.upsert_months(kids.limit(0), f"{tmp_path}/e", "entry", ["horse_race_id"], [F.col("race_id")], routes=races)
    assert not done.rows and spark.read.parquet(f"{tmp_path}/e/entry.parquet").count() == 0
    # a swap that was cut off between its renames comes back
    import os

    os.rename(f"{root}/202302/entry.parquet", f"{root}/202302/entry.parquet.old")
    assert T.read_months(spark, root, ["entry"], None)["entry"].count() == 2
