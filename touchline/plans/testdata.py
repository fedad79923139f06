"""Matches and predictions over the star-schema test tables, by fixed arithmetic on orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalar as X


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    # nation and region have at most 25 and 5 rows, whatever the scale
    nation = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    seq, price, h = F.col("o_orderkey"), F.col("o_totalprice"), F.col("c_nationkey")
    o = o.withColumn("_a", ((h + 5 * (1 + seq % 4)) % 25).cast("int"))
    home = nation.select(F.col("n_nationkey").alias("_hk"), F.col("n_name").alias("home"), F.col("r_name").alias("league"))
    away = nation.select(F.col("n_nationkey").alias("_ak"), F.col("n_name").alias("away"))
    o = o.join(F.broadcast(home), h == F.col("_hk")).join(F.broadcast(away), F.col("_a") == F.col("_ak"))
    hs, as_ = (F.floor(price) % 5).cast("int"), (F.floor(price / 10) % 4).cast("int")
    day = F.to_date("o_orderdate")
    shots = lambda d, m=20: F.when(seq % 10 != 0, (F.floor(price / d) % m).cast("int"))
    odds = lambda base, m: F.when(seq % 6 != 0, base + (seq % m) / 4.0)
    group = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "in_play").otherwise("scheduled")
    rows = o.select(
        seq.alias("seq"), day.alias("date"), X.season_label(day).alias("season"), "league", "home", "away", hs.alias("home_score"), as_.alias("away_score"), X.outcome(hs, as_).alias("outcome"),
        group.alias("status_group"), F.substring("o_orderpriority", 1, 1).cast("int").alias("trust"), shots(100).alias("home_shots"), shots(1000).alias("away_shots"),
        shots(20, 9).alias("home_shots_on_target"), shots(200, 8).alias("away_shots_on_target"), shots(50, 12).alias("home_corners"), shots(500, 11).alias("away_corners"),
        odds(1.2, 17).alias("odds_home"), odds(2.5, 7).alias("odds_draw"), odds(1.3, 13).alias("odds_away"),
    )
    return rows.withColumns({"match_key": X.match_key(F.col("date"), F.col("home"), F.col("away")), "progress": X.progress(F.col("status_group"))})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority <> '5-LOW'").select(k.alias("seq"))

    def shares(mods: tuple[int, int, int], names: tuple[str, str, str], where) -> dict:
        w = [1 + F.col("seq") % m for m in mods]
        return {n: F.when(where, x / (w[0] + w[1] + w[2])) for n, x in zip(names, w)}

    return rows.withColumns(shares((7, 4, 5), ("home_win", "draw", "away_win"), F.lit(True)) | shares((5, 3, 6), ("market_home", "market_draw", "market_away"), F.col("seq") % 4 != 0))


SQL = """
WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
m0 AS (SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS date, h.r_name AS league, h.n_name AS home, a.n_name AS away,
    CAST(floor(o_totalprice) AS BIGINT) % 5 AS home_score, CAST(floor(o_totalprice / 10) AS BIGINT) % 4 AS away_score,
    CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'in_play' ELSE 'scheduled' END AS status_group,
    CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 0 END AS progress, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS trust,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) % 20 END AS home_shots,
    CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice / 1000) AS BIGINT) % 20 END AS away_shots,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(1.2 AS DOUBLE) + (o_orderkey % 17) / CAST(4 AS DOUBLE) END AS odds_home,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(2.5 AS DOUBLE) + (o_orderkey % 7) / CAST(4 AS DOUBLE) END AS odds_draw,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(1.3 AS DOUBLE) + (o_orderkey % 13) / CAST(4 AS DOUBLE) END AS odds_away
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN n h ON c_nationkey = h.n_nationkey
    JOIN n a ON a.n_nationkey = (c_nationkey + 5 * (1 + o_orderkey % 4)) % 25),
m AS (SELECT *, CASE WHEN home_score > away_score THEN 1 WHEN away_score > home_score THEN 3 ELSE 2 END AS outcome,
    CAST(year(date) - CASE WHEN month(date) < 7 THEN 1 ELSE 0 END AS VARCHAR) || '/' || lpad(CAST((year(date) - CASE WHEN month(date) < 7 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season,
    strftime(date, '%Y-%m-%d') || '|' || home || '|' || away AS match_key FROM m0),
p0 AS (SELECT o_orderkey AS seq, 1 + o_orderkey % 7 AS a, 1 + o_orderkey % 4 AS b, 1 + o_orderkey % 5 AS c, 1 + o_orderkey % 5 AS d, 1 + o_orderkey % 3 AS e, 1 + o_orderkey % 6 AS f FROM orders WHERE o_orderpriority <> '5-LOW'),
p AS (SELECT seq, a / CAST(a + b + c AS DOUBLE) AS home_win, b / CAST(a + b + c AS DOUBLE) AS draw, c / CAST(a + b + c AS DOUBLE) AS away_win,
    CASE WHEN seq % 4 <> 0 THEN d / CAST(d + e + f AS DOUBLE) END AS market_home, CASE WHEN seq % 4 <> 0 THEN e / CAST(d + e + f AS DOUBLE) END AS market_draw,
    CASE WHEN seq % 4 <> 0 THEN f / CAST(d + e + f AS DOUBLE) END AS market_away FROM p0),
l AS (SELECT seq, date, season, league, TRUE AS is_home, home AS team, away AS opponent, home_score AS gf, away_score AS ga, home_shots AS shots_for, away_shots AS shots_against FROM m
  UNION ALL SELECT seq, date, season, league, FALSE, away, home, away_score, home_score, away_shots, home_shots FROM m),
t AS (SELECT *, CAST(gf > ga AS INTEGER) AS win, CAST(gf = ga AS INTEGER) AS draw, 3 * CAST(gf > ga AS INTEGER) + CAST(gf = ga AS INTEGER) AS pts FROM l),
s AS (SELECT *, pick = outcome AS hit, favourite = outcome AS market_hit, CASE outcome WHEN 1 THEN home_win WHEN 2 THEN draw ELSE away_win END AS p_actual,
    CASE outcome WHEN 1 THEN market_home WHEN 2 THEN market_draw ELSE market_away END AS q_actual FROM (
  SELECT m.*, home_win, draw, away_win, market_home, market_draw, market_away,
    CASE WHEN home_win IS NULL THEN NULL WHEN home_win >= draw AND home_win >= away_win THEN 1 WHEN draw >= away_win THEN 2 ELSE 3 END AS pick,
    CASE WHEN market_home IS NULL THEN NULL WHEN market_home >= market_draw AND market_home >= market_away THEN 1 WHEN market_draw >= market_away THEN 2 ELSE 3 END AS favourite,
    CASE WHEN home_win IS NOT NULL THEN greatest(home_win, draw, away_win) END AS confidence
  FROM m LEFT JOIN p USING (seq) WHERE status_group = 'finished'))
"""
