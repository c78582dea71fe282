import pytest

from furlong.plans import integrate as G


def side(spark, year, n=3):
    mk = spark.createDataFrame
    ids = [f"{year}05010{i}" for i in range(n)]
    kids = [(f"{r}0{h}", r) for r in ids for h in (1, 2)]
    return {"race": mk([(r, "障害" if i == 0 else None) for i, r in enumerate(ids)], "race_id string, obstacle string"), "entry": mk(kids, "horse_race_id string, race_id string"), "result": mk(kids, "horse_race_id string, race_id string")}


def test_integrate(spark, tmp_path):
    a, b = side(spark, 2019), side(spark, 2020)
    for _ in range(2):
        out = G.integrate(a, b, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/entry").count() == 12 == out["entry"].count()
    with pytest.raises(ValueError, match="duplicate race"):
        G.integrate(a, a)
    with pytest.raises(ValueError, match="orphan entry"):
        G.integrate(a, b | {"race": b["race"].limit(1)})
    with pytest.raises(ValueError, match="unpaired"):
        G.integrate(a, b | {"result": b["result"].limit(1)})
    race, entry, result = G.drop_excluded(**a)
    assert (race.count(), entry.count(), result.count()) == (2, 4, 4)
