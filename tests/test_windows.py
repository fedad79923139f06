"""A side's past by a stream of its team's rows against windows, and how the matrix joins."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from touchline.operators import features
from touchline.operators import windows as W

COLUMNS = "seq long, date date, season string, league string, home string, away string, home_score int, away_score int, home_shots int, away_shots int, home_shots_on_target {0}, away_shots_on_target {0}, home_corners int, away_corners int"


def _by_windows(df):
    rows = W._with_form(W.team_rows(df), (5, 10), W.ALL_MEASURES)
    return W._with_rest(W._with_standing(W._with_venue(rows, 10)), 30).select("seq", "is_home", *W.OWN)


@pytest.mark.parametrize("kind", ["int", "double"])
def test_past_equals_windows(spark, kind):
    rng, rows = random.Random(2), []
    maybe = lambda x: None if rng.random() < 0.15 else x
    target = lambda: maybe(rng.randrange(9) if kind == "int" else rng.random())
    for i in range(400):
        home, away = rng.sample(["A", "B", "C", "D", "E", None], 2)
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(600))
        rows.append((i, maybe(day), rng.choice(["20", "21", None]), rng.choice("LM"), home, away, maybe(rng.randrange(4)), maybe(rng.randrange(4)), maybe(7), maybe(i), target(), target(), maybe(i % 5), maybe(3)))
    df = spark.createDataFrame(rows, COLUMNS.format(kind))
    want = _by_windows(df)
    order = {(r["seq"], r["is_home"]): tuple(r) for r in want.collect()}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = W.own_past(df)
            assert got.dtypes == want.dtypes
            assert {(r["seq"], r["is_home"]): tuple(r) for r in got.collect()} == order and len(order) == 800
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert W.own_past(df.where(F.lit(False))).collect() == []


def test_no_window_holds_a_teams_rows(spark):
    df = spark.createDataFrame([], COLUMNS.format("int"))
    assert "Window" not in W.own_past(df)._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_matches_is_broadcast(spark):
    row = (1, dt.date(2020, 7, 1), "20", "L", "A", "B", 1, 0, 3, 4, 2, 1, 5, 6, 1, 2.0, 3.0, 4.0)
    df = spark.createDataFrame([row], COLUMNS.format("int") + ", outcome int, odds_home double, odds_draw double, odds_away double")
    plan = features.matrix(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[seq", plan) and not re.search(r"BroadcastHashJoin \[seq", plan)
