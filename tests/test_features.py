import datetime

import pytest

from furlong.plans import features as G


def tables(spark, days=9):
    race, entry, result = [], [], []
    for d in range(days):
        rid = f"20200501{d // 4 + 1:02d}{d % 4 + 1:02d}"
        race.append((rid, str(datetime.date(2020, 1, 1) + datetime.timedelta(7 * d)), "東京", 1600, "芝", "左", "晴", "良", d + 1, None))
        for h in range(3):
            hid = f"{rid}{h + 1:02d}"
            entry.append((hid, rid, h + 1, h + 1, f"馬{h}", " 牡　", 4, 55.0, 480.0, 0.0, f"J{h}", "T"))
            note = "取" if (d, h) == (2, 1) else "中" if (d, h) == (3, 1) else None
            pos = None if note else (h + d) % 3 + 1
            result.append((hid, rid, pos, note, f"1:{30 + h + d}.0" if pos else None, "クビ" if pos == 2 else None, float(h), 35.0 + d))
    mk = spark.createDataFrame
    return (
        mk(race, "race_id string, race_date string, course_name string, distance long, surface string, direction string, weather string, track_condition string, race_number long, grade string"),
        mk(entry, "horse_race_id string, race_id string, bracket_num long, horse_number long, horse_name string, sex string, age long, weight_assigned double, horse_weight double, weight_change double, jockey string, trainer string"),
        mk(result, "horse_race_id string, race_id string, finish_position long, finish_note string, finish_time string, margin string, corner_4 double, last_3f double"),
    )


def test_contract_and_prefix(spark):
    assert len(G.FEATURES) == 72
    race, entry, result = tables(spark)
    train, pred = G.generate(race, entry, result)
    assert train.columns == G.FEATURES + G.KEYS + G.TARGETS and pred.columns == G.FEATURES + G.KEYS
    rows = {(r.race_id, r.horse_number): r for r in train.collect()}
    assert len(rows) == 27
    first = min(rows)
    assert rows[first].is_debut and rows[first].jockey_rolling_rides == 0 and rows[first].prev_1_finish_position is None and rows[first].sex == "牡"
    ids = sorted({k[0] for k in rows})
    assert rows[ids[2], 2].exclude_from_training and rows[ids[2], 2].prev_1_last_3f is None
    assert rows[ids[3], 2].is_dnf and rows[ids[4], 2].prev_1_finish_position is None and rows[ids[4], 2].prev_1_last_3f == 38.0
    assert rows[ids[1], 1].trainer_rolling_rides == 3 and rows[ids[4], 2].jockey_rolling_rides == 3
    assert rows[ids[6], 1].prev_1_finish_time_zscore is not None and rows[ids[5], 1].prev_1_finish_time_zscore is None
    early = [r.race_id for r in race.where("race_date < '2020-02-10'").collect()]
    keep = lambda df: df.where(df.race_id.isin(early))
    part = {(r.race_id, r.horse_number): r for r in G.generate(keep(race), keep(entry), keep(result))[0].collect()}
    assert part and all(rows[k] == r for k, r in part.items())


def test_written_features(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        G.write(spark, f"{tmp_path}/std", f"{tmp_path}/f")
    for name, df in zip(("race", "entry", "result"), tables(spark), strict=True):
        df.write.parquet(f"{tmp_path}/std/{name}.parquet")
    for _ in range(2):
        out = G.write(spark, f"{tmp_path}/std", f"{tmp_path}/f")
    train, pred = (spark.read.parquet(p) for p in out.values())
    assert train.columns == G.FEATURES + G.KEYS + G.TARGETS and pred.columns == G.FEATURES + G.KEYS and train.count() == pred.count() == 27
    assert G.require_features([*G.FEATURES, "prev_9_x", "weather2"]) == ["prev_9_x"]
    with pytest.raises(ValueError, match="is_debut"):
        G.require_features(G.FEATURES[:-1])
