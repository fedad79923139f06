import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import store as S
from touchline.streaming import stateful as T

GROUPS = ["scheduled", "off", "in_play", "finished"]


def _rows(n):
    rng = random.Random(5)
    out = []
    for i in range(n):
        g = rng.choice([0, 0, 1, 2, 2, 3])
        at = dt.datetime(2024, 5, 1) + dt.timedelta(minutes=rng.randrange(3000))
        score = rng.randrange(4) if g >= 2 and rng.random() < 0.7 else None
        kickoff = dt.datetime(2024, 5, 1) + dt.timedelta(hours=rng.randrange(40)) if rng.random() < 0.8 else dt.datetime(2094, 5, 1)
        out.append((f"k{rng.randrange(25)}", f"S{i % 7}", GROUPS[g], g, rng.choice([None, 10, 45]), kickoff, "L", rng.choice([None, "E"]), rng.choice([None, "2023/24"]), score, score, None, at))
    return out


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, T.ROCKS)
    yield
    spark.conf.set(key, was) if was else spark.conf.unset(key)


def test_stream_equals_batch_after_restarts_and_in_any_order(spark, tmp_path, rocks):
    rows = _rows(160)
    random.Random(1).shuffle(rows)
    store = S.Store(spark, str(tmp_path / "store"), {"fixture_states": S.Table("match_key", {}, buckets=4, last=())})
    for part in range(3):  # each part comes to a query that is started anew
        spark.createDataFrame(rows[part::3], T.COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = T.keep(spark.readStream.schema(T.COLUMNS).parquet(str(tmp_path / "in")), store, str(tmp_path / "checkpoint"))
        q.awaitTermination()
    want = T.settled(spark.createDataFrame(rows, T.COLUMNS), F.current_timestamp())
    got = store.read("fixture_states").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["status_group"] for r in got.collect()} >= {"off", "finished"} and any(r["stalled"] for r in got.collect())
    assert len(store.manifest().tags) == 3


def test_fold_ignores_order():
    rows = [{**dict(zip([c.split()[0] for c in T.COLUMNS.split(", ")], r))} for r in _rows(40)]
    rows = [{k: T._iso(v) for k, v in r.items()} for r in rows]
    said = set()
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        fold = T.Fold()
        for i, r in enumerate(rows):
            fold.take(r)
            if i == 20:
                fold = T.Fold(fold.dumps())
        said.add(repr((sorted(fold.row.items(), key=str), fold.first)))
    assert len(said) == 1
