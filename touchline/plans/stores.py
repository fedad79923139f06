"""Queries of the bucketed store: each makes a store in the shared folder from the test tables, changes it, and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import store as S
from touchline.plans import testdata as D
from touchline.plans.queries import NOW, query
from touchline.plans.session import scratch


def _store(spark: SparkSession) -> S.Store:
    return S.Store(spark, scratch(spark, "store"))


def _predictions(spark, d) -> DataFrame:
    """Predictions as rows of the store, in three batches by their number's remainder."""
    seq = F.col("seq")
    pick = F.when((F.col("home_win") >= F.col("draw")) & (F.col("home_win") >= F.col("away_win")), 1).when(F.col("draw") >= F.col("away_win"), 2).otherwise(3)
    rows = D.predictions(spark, d).join(D.matches(spark, d).select("seq", "match_key"), "seq")
    return rows.select("match_key", "home_win", "draw", "away_win", pick.alias("predicted_outcome"), "market_home", "market_draw", "market_away", F.when(seq % 5 == 0, F.concat(F.lit("s"), seq)).alias("ai_summary"), F.when(seq % 7 == 0, F.concat(F.lit("p"), seq)).alias("payload_json"), seq.alias("created_at"), seq.alias("updated_at"), (seq % 3).alias("_b"))


_P = """, q AS (SELECT match_key, home_win, draw, away_win, CASE WHEN home_win >= draw AND home_win >= away_win THEN 1 WHEN draw >= away_win THEN 2 ELSE 3 END AS predicted_outcome, market_home, market_draw, market_away,
 CASE WHEN seq % 5 = 0 THEN 's' || seq END AS ai_summary, CASE WHEN seq % 7 = 0 THEN 'p' || seq END AS payload_json, seq AS created_at, seq AS updated_at, seq % 3 AS b FROM p JOIN m USING (seq)),
b0 AS (SELECT * FROM q WHERE b = 0 QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY updated_at DESC) = 1), b1 AS (SELECT * FROM q WHERE b = 1 QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY updated_at DESC) = 1),
st AS (SELECT coalesce(n.match_key, o.match_key) AS match_key, coalesce(n.home_win, o.home_win) AS home_win, coalesce(n.draw, o.draw) AS draw, coalesce(n.away_win, o.away_win) AS away_win, coalesce(n.predicted_outcome, o.predicted_outcome) AS predicted_outcome,
 coalesce(n.market_home, o.market_home) AS market_home, coalesce(n.market_draw, o.market_draw) AS market_draw, coalesce(n.market_away, o.market_away) AS market_away, coalesce(n.ai_summary, o.ai_summary) AS ai_summary, coalesce(n.payload_json, o.payload_json) AS payload_json,
 coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at FROM b0 o FULL JOIN b1 n ON o.match_key = n.match_key) """


@query(_P + "SELECT * FROM st")
def store_predictions(spark, d):
    """Two batches; the second comes twice, and changes the store once."""
    s, rows = _store(spark), _predictions(spark, d)
    for b in (0, 1, 1):
        s.upsert("predictions", rows.where(F.col("_b") == b).drop("_b"), tag=f"batch-{b}")
    return s.read("predictions")


@query(_P + f""", fx AS (SELECT match_key, max(progress) AS progress, min(league) AS league FROM m WHERE seq % 2 = 0 GROUP BY match_key), k AS (SELECT DISTINCT match_key FROM m WHERE seq % 3 <> 0),
doomed AS (SELECT fx.match_key FROM fx WHERE CAST(substr(match_key, 1, 10) AS TIMESTAMP) < TIMESTAMP '{NOW}' - INTERVAL 180 DAY AND league <> 'EUROPE' AND (progress <> 3 OR match_key IN (SELECT match_key FROM k)))
SELECT 'fixtures' AS "table", count(*) AS n FROM doomed UNION ALL SELECT 'predictions', count(*) FROM b0 WHERE match_key IN (SELECT match_key FROM doomed)
UNION ALL SELECT 'ai_insights', count(*) FROM (SELECT DISTINCT match_key FROM m WHERE seq % 4 = 0) WHERE match_key IN (SELECT match_key FROM doomed)""")
def retention_dry_run(spark, d):
    """What retention would take from fixtures and from what depends on them."""
    return S.retention(_retained(spark, d), D.matches(spark, d).where("seq % 3 <> 0").select("match_key"), F.lit(NOW).cast("timestamp"))


def _retained(spark, d) -> S.Store:
    s, m, now = _store(spark), D.matches(spark, d), F.lit(NOW).cast("timestamp")
    rows = m.where("seq % 2 = 0").groupBy("match_key", "date").agg(F.max("progress").alias("progress"), F.min("league").alias("country"))
    names = F.create_map(F.lit(0), F.lit("scheduled"), F.lit(1), F.lit("off"), F.lit(2), F.lit("in_play"), F.lit(3), F.lit("finished"))
    # one country is kept, as the library's default keeps one
    country = F.when(F.col("country") == "EUROPE", "South Africa").otherwise(F.col("country"))
    s.upsert("fixtures", rows.select("match_key", "progress", F.element_at(names, F.col("progress")).alias("status_group"), F.col("date").cast("timestamp").alias("kickoff_utc"), country.alias("country"), now.alias("updated_at")))
    s.upsert("predictions", _predictions(spark, d).where("_b = 0").drop("_b"))
    s.upsert("ai_insights", m.where("seq % 4 = 0").select("match_key", F.lit("x").alias("payload"), F.col("seq").alias("updated_at"), F.lit(1).alias("refresh_count"), F.col("seq").alias("created_at")))
    return s


@query(_P + f""", fx AS (SELECT match_key, max(progress) AS progress, min(league) AS league FROM m WHERE seq % 2 = 0 GROUP BY match_key), k AS (SELECT DISTINCT match_key FROM m WHERE seq % 3 <> 0),
doomed AS (SELECT fx.match_key FROM fx WHERE CAST(substr(match_key, 1, 10) AS TIMESTAMP) < TIMESTAMP '{NOW}' - INTERVAL 180 DAY AND league <> 'EUROPE' AND (progress <> 3 OR match_key IN (SELECT match_key FROM k)))
SELECT 'fixtures' AS "table", match_key FROM fx WHERE match_key NOT IN (SELECT match_key FROM doomed) UNION ALL SELECT 'predictions', match_key FROM b0 WHERE match_key NOT IN (SELECT match_key FROM doomed)""")
def retention_cascade(spark, d):
    """What is left of fixtures and predictions after retention, in one version of the store."""
    s = _retained(spark, d)
    S.retention(s, D.matches(spark, d).where("seq % 3 <> 0").select("match_key"), F.lit(NOW).cast("timestamp"), dry=False)
    left = [s.read(t).select(F.lit(t).alias("table"), "match_key") for t in ("fixtures", "predictions")]
    return left[0].unionByName(left[1])


@query("""WITH c AS (SELECT c_name AS team, c_mktsegment AS league, c_custkey AS k FROM customer), o AS (SELECT team, CASE WHEN k % 3 <> 0 THEN 'u' || k END AS badge_url, 'm' || k AS matched_name, (k % 10) / CAST(4 AS DOUBLE) AS confidence, league, k AS updated_at FROM c WHERE k % 4 <> 0),
n AS (SELECT team, CASE WHEN k % 5 = 0 THEN 'v' || k END AS badge_url, 'n' || k AS matched_name, (k % 7) / CAST(4 AS DOUBLE) AS confidence, league, k AS updated_at FROM c WHERE k % 4 <> 1)
SELECT coalesce(n.team, o.team) AS team, CASE WHEN n.team IS NULL THEN o.badge_url ELSE coalesce(n.badge_url, o.badge_url) END AS badge_url, coalesce(n.matched_name, o.matched_name) AS matched_name, coalesce(n.confidence, o.confidence) AS confidence, coalesce(n.league, o.league) AS league, coalesce(n.updated_at, o.updated_at) AS updated_at FROM o FULL JOIN n ON o.team = n.team""", bare=True)
def store_badges(spark, d):
    """Badges of as many clubs as there are customers; an empty answer loses none."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("team"), F.col("c_mktsegment").alias("league"), F.col("c_custkey").alias("k"))
    k, s = F.col("k"), _store(spark)
    row = lambda r, has, u, m, div: r.select("team", F.when(has, F.concat(F.lit(u), k)).alias("badge_url"), F.concat(F.lit(m), k).alias("matched_name"), ((k % div) / 4.0).alias("confidence"), "league", k.alias("updated_at"))
    s.upsert("team_assets", row(c.where("k % 4 <> 0"), k % 3 != 0, "u", "m", 10))
    s.upsert("team_assets", row(c.where("k % 4 <> 1"), k % 5 == 0, "v", "n", 7))
    return s.read("team_assets")


@query("""SELECT event_type AS league, arg_max(props, ts) AS payload, max(ts) AS fetched_at, arg_max(event_id % 500, ts) AS remaining FROM events GROUP BY event_type""", bare=True)
def store_market(spark, d):
    """A cache of one row a key, replaced by each newer batch."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("league"), F.col("props").alias("payload"), F.col("ts").alias("fetched_at"), (F.col("event_id") % 500).alias("remaining"))
    middle = e.agg(F.avg(F.unix_micros(F.col("fetched_at").cast("timestamp")))).first()[0]
    at = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    s = _store(spark)
    s.upsert("market_odds", e.where(at < middle))
    s.upsert("market_odds", e.where(at >= middle))
    return s.read("market_odds")


@query("SELECT CAST(date AS VARCHAR) AS day, CAST(count(*) AS VARCHAR) || ' matches' AS text FROM m WHERE date >= DATE '1997-01-01' AND date < DATE '1997-01-06' GROUP BY date")
def digest_once_a_day(spark, d):
    """Five days' digests, each made twice, the second time with another text: the first one stays."""
    s, rows = _store(spark), D.matches(spark, d)
    for day in (f"1997-01-0{i}" for i in range(1, 6)):
        n = rows.where(F.col("date") == F.lit(day).cast("date")).agg(F.concat(F.count("*").cast("string"), F.lit(" matches")).alias("text"), F.count("*").alias("n")).where("n > 0")
        for text in (n, n.withColumn("text", F.lit("again"))):
            S.once_a_day(s, text, day, F.lit(NOW).cast("timestamp"))
    return s.read("digests").select("day", "text")
