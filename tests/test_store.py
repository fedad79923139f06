import pytest
from pyspark.sql import functions as F

from touchline.operators import store as S

ROWS = "match_key string, home_win double, market_home double, ai_summary string, created_at long, updated_at long"


def _store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "store"))


def _rows(df):
    return {r["match_key"]: tuple(r)[1:] for r in df.collect()}


def test_upsert_writes_touched_buckets_only_and_once_per_tag(spark, tmp_path):
    s = _store(spark, tmp_path)
    first = spark.createDataFrame([(f"k{i}", 0.1, 0.2, "s", 1, 1) for i in range(200)], ROWS)
    assert s.read("predictions") is None and s.upsert("predictions", first, tag="a") and not s.upsert("predictions", first.limit(3), tag="a")
    before = s.manifest().folders["predictions"]
    again = spark.createDataFrame([("k7", 0.5, None, None, 9, 5), ("k7", 0.4, 0.9, "t", 8, 4), ("new", 0.3, None, None, 7, 2), (None, 0.3, None, None, 7, 2)], ROWS)
    assert s.upsert("predictions", again, tag="b")
    after = s.manifest()
    assert len([b for b in before if after.folders["predictions"][b] != before[b]]) <= 2 and after.version == 2 and set(after.tags) == {"a", "b"}
    got = _rows(s.read("predictions"))
    assert len(got) == 201 and got["k7"] == (0.5, 0.2, "s", 1, 5) and got["new"] == (0.3, None, None, 7, 2)
    assert _rows(s.read("predictions", version=1))["k7"] == (0.1, 0.2, "s", 1, 1)  # a version stays as it was
    assert s.sweep() == 0 or _rows(s.read("predictions")) == got
    assert _rows(s.read("predictions")) == got


def test_a_change_of_several_tables_is_made_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    s = _store(spark, tmp_path)
    keys = [f"k{i}" for i in range(30)]
    s.upsert("fixtures", spark.createDataFrame([(k, 0, 1) for k in keys], "match_key string, progress int, updated_at long"))
    s.upsert("predictions", spark.createDataFrame([(k, 0.1, 0.2, "s", 1, 1) for k in keys[:20]], ROWS))
    gone = spark.createDataFrame([(k,) for k in keys[10:]] + [("other",)], "match_key string")
    names = ["fixtures", "predictions", "ai_insights"]
    assert {r["table"]: r["n"] for r in s.would_go(gone, names).collect()} == {"fixtures": 20, "predictions": 10}
    write, version = S.Store._write, s.manifest().version

    def fails(self, name, rows, touched):
        if name == "predictions":
            raise OSError("lost")
        return write(self, name, rows, touched)

    monkeypatch.setattr(S.Store, "_write", fails)
    with pytest.raises(OSError):
        s.delete(gone, names)
    assert s.manifest().version == version and s.read("fixtures").count() == 30 and s.read("predictions").count() == 20
    monkeypatch.setattr(S.Store, "_write", write)
    assert s.delete(gone, names, tag="r") and not s.delete(gone, names, tag="r")
    assert s.read("fixtures").count() == 10 and s.read("predictions").count() == 10 and s.sweep() > 0
    assert s.read("fixtures").count() == 10


def test_of_two_changes_at_once_one_fails(spark, tmp_path):
    s, other = _store(spark, tmp_path), _store(spark, tmp_path)
    row = spark.createDataFrame([("k", 0.1, 0.2, "s", 1, 1)], ROWS)

    def meanwhile(m):
        other.upsert("predictions", row)
        return {"predictions": (row, list(range(64)))}

    with pytest.raises(S.Conflict):
        s._changed(None, meanwhile)
    assert s.manifest().version == 1 and s.read("predictions").count() == 1


def test_a_days_digest_is_kept_once(spark, tmp_path):
    s, now = _store(spark, tmp_path), F.lit("2024-05-01").cast("timestamp")
    text = lambda t: spark.createDataFrame([(t,)], "text string")
    assert [S.once_a_day(s, text(t), d, now) for t, d in (("a", "2024-05-01"), ("b", "2024-05-01"), ("c", "2024-05-02"))] == [True, False, True]
    assert {r["day"]: r["text"] for r in s.read("digests").collect()} == {"2024-05-01": "a", "2024-05-02": "c"}


def test_badges_and_market_rows_follow_their_policies(spark, tmp_path):
    s = _store(spark, tmp_path)
    badge = lambda *r: spark.createDataFrame([r], "team string, badge_url string, matched_name string, confidence double, league string, updated_at long")
    s.upsert("team_assets", badge("A", "u", "a", 3.0, "L", 1))
    s.upsert("team_assets", badge("A", None, "b", 0.0, "M", 2))
    assert tuple(s.read("team_assets").first()) == ("A", "u", "b", 0.0, "M", 2)
    odds = lambda *r: spark.createDataFrame([r], "league string, payload string, fetched_at long, remaining int")
    s.upsert("market_odds", odds("L", "x", 1, 9))
    s.upsert("market_odds", odds("L", None, 2, 8))
    assert tuple(s.read("market_odds").first()) == ("L", None, 2, 8)
