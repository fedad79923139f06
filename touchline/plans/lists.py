"""Queries of fixtures, badges, names and the model over the test tables, beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalar as X
from touchline.operators import badges, boosting, features, fixtures, market, model, quality, record, state, windows
from touchline.plans import testdata as D
from touchline.plans.queries import NOW, query
from touchline.plans.session import scratch
from touchline.sources import files


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """Matches as a feed's fixtures: kickoffs through the day, times of writing, sources and statuses."""
    seq = F.col("seq")
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    return D.matches(spark, d).withColumns({
        "kickoff_utc": F.col("date").cast("timestamp") + hours(seq % 24), "updated_at": F.when(seq % 7 != 0, _now() - hours(seq % 30)), "home_team": F.col("home"), "away_team": F.col("away"), "country": F.col("league"),
        "source": F.when(F.col("trust") == 1, "API-Football").when(F.col("trust") == 2, "football-data.org").when(F.col("trust") == 3, "TheSportsDB").otherwise("other"),
        "status": F.when(F.col("status_group") == "finished", "ft").when(F.col("status_group") == "in_play", " 1H").otherwise("NS"),
    })


_F = f""", f AS (SELECT *, CAST(date AS TIMESTAMP) + INTERVAL (seq % 24) HOUR AS kickoff_utc, CASE WHEN seq % 7 <> 0 THEN TIMESTAMP '{NOW}' - INTERVAL (seq % 30) HOUR END AS updated_at, home AS home_team, away AS away_team, league AS country,
 CASE trust WHEN 1 THEN 'API-Football' WHEN 2 THEN 'football-data.org' WHEN 3 THEN 'TheSportsDB' ELSE 'other' END AS source, CASE trust WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 9 END AS p_source FROM m) """


@query(_F + f"SELECT seq, coalesce(status_group = 'in_play' AND updated_at >= TIMESTAMP '{NOW}' - INTERVAL 2 HOUR, FALSE) AS live, status_group = 'in_play' AND NOT coalesce(updated_at >= TIMESTAMP '{NOW}' - INTERVAL 2 HOUR, FALSE) AS stalled FROM f")
def fixture_liveness(spark, d):
    return fixtures.liveness(_feed(spark, d), _now()).select("seq", "live", "stalled")


@query(_F + f"SELECT league, max(updated_at) >= TIMESTAMP '{NOW}' - INTERVAL 2 HOUR AS live_trusted, max(updated_at) >= TIMESTAMP '{NOW}' - INTERVAL 12 HOUR AS feed_trusted FROM f WHERE seq % 30 >= 5 OR league < 'B' GROUP BY league")
def feed_staleness(spark, d):
    """Each league's feed; those beyond the first letter lack their newest writes, so that both windows matter."""
    rows = _feed(spark, d).where("seq % 30 >= 5 or league < 'B'")
    return fixtures.staleness(rows, _now(), "league").select("league", "live_trusted", "feed_trusted")


@query(_F + "SELECT seq, match_key FROM f WHERE kickoff_utc >= TIMESTAMP '1995-03-01 06:00:00' AND kickoff_utc < TIMESTAMP '1995-03-31 06:00:00'")
def kickoff_range(spark, d):
    return fixtures.between(_feed(spark, d), F.lit("1995-03-01 06:00:00").cast("timestamp"), F.lit("1995-03-31 06:00:00").cast("timestamp")).select("seq", "match_key")


def _unique(rows: DataFrame) -> DataFrame:
    """Keys repeat in these tables; seq makes them unique where an order needs it."""
    return rows.withColumn("match_key", F.lpad(F.col("seq").cast("string"), 20, "0"))


@query(_F + "SELECT seq FROM (SELECT * FROM f WHERE status_group = 'finished' ORDER BY kickoff_utc DESC, seq DESC LIMIT 1000) WHERE strftime(kickoff_utc, '%Y-%m-%d') BETWEEN '2001-06-20' AND '2001-07-10'")
def history_days(spark, d):
    """The range of days works on the newest 1000, both ends included."""
    return fixtures.history_page(_unique(_feed(spark, d)).where("status_group = 'finished'"), "2001-06-20", "2001-07-10").select("seq")


@query(_F + "SELECT seq, source FROM f QUALIFY row_number() OVER (PARTITION BY date, home_team, away_team ORDER BY p_source, kickoff_utc, source, seq) = 1")
def fixture_dedupe(spark, d):
    return fixtures.dedupe(_feed(spark, d).withColumn("source_match_id", F.lpad(F.col("seq").cast("string"), 20, "0"))).select("seq", "source")


@query(_F + "SELECT seq::VARCHAR AS source_match_id, match_key, status_group, progress, CASE WHEN status_group = 'finished' THEN outcome END AS outcome, status_group = 'finished' AS ended FROM f")
def store_rows(spark, d):
    rows = fixtures.store_rows(_feed(spark, d).withColumn("source_match_id", F.col("seq").cast("string")), _now())
    return rows.select("source_match_id", "match_key", "status_group", "progress", "outcome", F.col("finished_at").isNotNull().alias("ended"))


@query(_F + "SELECT league, count(*) AS n, count(*) FILTER (status_group = 'in_play') AS live, strftime(max(kickoff_utc), '%Y-%m-%d %H') AS last_kickoff FROM f WHERE status_group <> 'finished' GROUP BY league")
def unfinished_tallies(spark, d):
    return fixtures.tallies(fixtures.unfinished(_feed(spark, d))).withColumn("last_kickoff", F.date_format("last_kickoff", "yyyy-MM-dd HH"))


_RENAMES = [("NATION_3", "NATION_8"), ("NATION_7", "BRITAIN")]
_RENAMED = "CASE {0} WHEN 'NATION_3' THEN 'NATION_8' WHEN 'NATION_7' THEN 'BRITAIN' ELSE {0} END"


@query(_F + f""", r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY seq) = 1), z AS (SELECT r.*, {_RENAMED.format("home")} AS h, {_RENAMED.format("away")} AS a FROM r),
 k AS (SELECT *, strftime(kickoff_utc, '%Y-%m-%d') || '|' || h || '|' || a AS nk FROM z) SELECT nk AS match_key, h AS home_team, a AS away_team, progress FROM k QUALIFY row_number() OVER (PARTITION BY nk ORDER BY progress DESC, (match_key <> nk)::INT, match_key) = 1""")
def rename_fixtures(spark, d):
    stored = windows.first_of(_feed(spark, d), ["match_key"], [F.col("seq")]).select("match_key", "kickoff_utc", "home_team", "away_team", "progress")
    return fixtures.rename(stored, spark.createDataFrame(_RENAMES, "team string, name string")).select("match_key", "home_team", "away_team", "progress")


@query(_F + "SELECT seq FROM f WHERE status_group = 'scheduled' AND kickoff_utc >= TIMESTAMP '1997-01-01' ORDER BY kickoff_utc, seq LIMIT 5")
def next_upcoming(spark, d):
    return fixtures.next_upcoming(_unique(_feed(spark, d)), F.lit("1997-01-01").cast("timestamp")).select("seq")


@query("SELECT seq, round(c, 6) AS confidence, (SELECT greatest(count(*) - 25, 0) FROM p WHERE greatest(home_win, draw, away_win) > 0.5) AS more FROM (SELECT seq, greatest(home_win, draw, away_win) AS c FROM p) WHERE c > 0.5 ORDER BY c DESC, seq LIMIT 25")
def confident_capped(spark, d):
    rows = D.predictions(spark, d).withColumn("confidence", X.top_probability(F.col("home_win"), F.col("draw"), F.col("away_win")))
    return fixtures.confident_list(_unique(rows)).select("seq", F.round("confidence", 6).alias("confidence"), "more")


@query("SELECT DISTINCT date FROM m ORDER BY date DESC LIMIT 30")
def slip_dates(spark, d):
    return fixtures.slip_dates(D.matches(spark, d).select("date"))


@query(_F + """, z AS (SELECT *, CAST(kickoff_utc + INTERVAL 2 HOUR AS DATE) AS local_day FROM f) SELECT seq FROM z WHERE local_day = (SELECT min(local_day) FROM z WHERE status_group = 'scheduled' AND local_day > DATE '1996-02-10')""")
def next_day(spark, d):
    return fixtures.next_day(_feed(spark, d), F.lit("1996-02-10 12:00:00").cast("timestamp")).select("seq")


def _board(spark, d, **filters) -> DataFrame:
    rows = _feed(spark, d).join(D.predictions(spark, d), "seq").withColumn("confidence", X.top_probability(F.col("home_win"), F.col("draw"), F.col("away_win")))
    return fixtures.board(rows, _now(), **filters)


@query(_F + f"SELECT seq FROM f JOIN p USING (seq) WHERE status_group = 'in_play' AND updated_at >= TIMESTAMP '{NOW}' - INTERVAL 2 HOUR AND greatest(home_win, draw, away_win) > 0.5 AND match_key IN (SELECT match_key FROM m WHERE trust <= 3) AND contains(lower(home || ' ' || away || ' ' || league), 'ation_1')")
def board_filters(spark, d):
    slip = D.matches(spark, d).where("trust <= 3").select("match_key").distinct()
    return _board(spark, d, live=True, confident=True, slip=slip, words=" ÁTION_1 ").select("seq")


@query(_F + f"SELECT CASE WHEN status_group = 'in_play' AND coalesce(updated_at >= TIMESTAMP '{NOW}' - INTERVAL 2 HOUR, FALSE) THEN 'live' ELSE strftime(kickoff_utc, '%Y-%m-%d') END AS heading, count(*) AS n FROM f JOIN p USING (seq) WHERE league = 'ASIA' GROUP BY 1")
def board_groups(spark, d):
    return fixtures.groups(_board(spark, d, league="ASIA"))


#: Names for the test tables' 25 nations, whose own differ in a number only.
CLUBS = ["Arden", "Brixby", "Corvin", "Dunmore", "Elswick", "Farrow", "Glenrae", "Hartle", "Ivybrook", "Jarrow", "Kestrel", "Lunford", "Marske", "Norwell", "Oakham", "Penrith", "Quarley", "Rushden", "Selby", "Thirsk", "Upwey", "Varley", "Wexcombe", "Yarm", "Zennor"]


def _club(nation: str) -> Column:
    return F.upper(F.element_at(F.array(*(F.lit(c) for c in CLUBS)), F.substring(nation, 8, 2).cast("int") + 1))


_K = f""", k AS (SELECT * REPLACE (upper(({CLUBS})[CAST(substr(home, 8) AS INTEGER) + 1]) AS home, upper(({CLUBS})[CAST(substr(away, 8) AS INTEGER) + 1]) AS away) FROM m) """


def _clubs(spark, d) -> DataFrame:
    return D.matches(spark, d).withColumns({"home": _club("home"), "away": _club("away")})


@query(_K + ", e AS (SELECT league, home, away, count(*) AS n FROM k WHERE trust = 1 GROUP BY ALL) SELECT seq, round(e.n / CAST(e.n + 1 AS DOUBLE), 6) AS share FROM k JOIN e USING (league, home, away) WHERE trust = 2 AND home <> 'SELBY'")
def match_odds(spark, d):
    """Events are the pairs of teams of one source, spelt otherwise; another source's fixtures find them. One club has two events
    for each pair, so it finds none."""
    m = _clubs(spark, d)
    spelt = lambda c: F.when(F.col(c) == "ARDEN", "Arden FC").otherwise(F.concat(F.lit("AFC "), F.initcap(c), F.lit(" 1904")))
    pairs = m.where("trust = 1").groupBy("league", "home", "away").agg(F.count("*").alias("_k"))
    events = pairs.select("league", spelt("home").alias("home"), spelt("away").alias("away"), F.round(F.col("_k") / (F.col("_k") + 1), 6).alias("probs"))
    events = events.unionByName(events.where("home like '%Selby%'"))
    own = lambda c: F.when(F.col(c) == "ARDEN", "United Árden").otherwise(F.col(c))
    ours = m.where("trust = 2").select(F.col("seq").cast("string").alias("match_key"), "league", own("home").alias("home_team"), own("away").alias("away_team"))
    return N.match_odds(ours, events).select(F.col("match_key").cast("long").alias("seq"), F.col("probs").alias("share"))


_CLUBS = """WITH n AS (SELECT n_nationkey AS k, n_name AS team, r_name AS league FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT a.team, CASE WHEN (a.k + b.k) % 5 = 4 THEN 'Basketball' ELSE 'Soccer' END AS sport, CASE WHEN a.k = b.k AND a.k % 3 = 0 THEN b.team ELSE b.team || ' ROVERS' END AS name, b.league AS its_league,
 b.team AS its_country, CASE WHEN (a.k + b.k) % 4 <> 0 THEN 'u' || b.k END AS badge_url, a.league AS own, a.team AS t FROM n a JOIN n b ON (b.k - a.k + 25) % 25 < 6),
 sc AS (SELECT *, CASE WHEN name = t THEN 3.0 WHEN contains(name, t) THEN 1.5 ELSE 0.0 END + CASE WHEN its_league = own THEN 2 ELSE 0 END + CASE WHEN its_country = t THEN 1 ELSE 0 END + CASE WHEN badge_url IS NOT NULL THEN 0.5 ELSE 0 END AS score FROM c WHERE sport = 'Soccer'),
 b AS (SELECT team, badge_url, name AS matched_name, CASE WHEN badge_url IS NULL THEN 0.0 ELSE score END::DOUBLE AS confidence FROM sc QUALIFY row_number() OVER (PARTITION BY team ORDER BY score DESC, name) = 1) """


def _badges(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("team"), F.col("r_name").alias("league"))
    a, b = n.alias("a"), n.alias("b")
    both = a.join(b, (F.col("b.k") - F.col("a.k") + 25) % 25 < 6)
    total = F.col("a.k") + F.col("b.k")
    name = F.when((F.col("a.k") == F.col("b.k")) & (F.col("a.k") % 3 == 0), F.concat(F.lit("FC "), F.initcap("b.team"))).otherwise(F.concat(F.col("b.team"), F.lit(" ROVERS")))
    candidates = both.select(F.col("a.team").alias("team"), F.when(total % 5 == 4, "Basketball").otherwise("Soccer").alias("sport"), name.alias("name"), F.col("b.league").alias("its_league"), F.col("b.team").alias("its_country"), F.when(total % 4 != 0, F.concat(F.lit("u"), F.col("b.k").cast("string"))).alias("badge_url"))
    return badges.best_badge(n.select("team", "league", F.col("team").alias("country")), candidates)


@query(_CLUBS + "SELECT team, badge_url, confidence FROM b", bare=True)
def best_badges(spark, d):
    return _badges(spark, d).select("team", "badge_url", "confidence")


@query(_CLUBS + "SELECT team, confidence FROM b WHERE confidence < 2.0 ORDER BY confidence, team LIMIT 20", bare=True)
def weakest_badges(spark, d):
    return badges.weakest(_badges(spark, d)).select("team", "confidence")


@query(_CLUBS + "SELECT n.team FROM n LEFT JOIN b ON n.team = b.team WHERE b.badge_url IS NULL", bare=True)
def clubs_without_badge(spark, d):
    return badges.without_badge(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("team")), _badges(spark, d))


@query(_CLUBS.replace("WITH n AS", D.SQL.strip() + ", nn AS").replace(" FROM n a JOIN n b", " FROM nn a JOIN nn b") + "SELECT seq, h.badge_url AS home_badge, a.badge_url AS away_badge FROM m LEFT JOIN b h ON m.home = h.team LEFT JOIN b a ON m.away = a.team", bare=True)
def crest_lookup(spark, d):
    rows = D.matches(spark, d).select("seq", F.col("home").alias("home_team"), F.col("away").alias("away_team"))
    return badges.crests(rows, _badges(spark, d)).select("seq", "home_badge", "away_badge")


_SPLIT = """, o AS (SELECT match_key, trust AS payload, seq AS updated_at, 1 AS refresh_count, seq AS created_at FROM m WHERE trust <= 3 QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY seq) = 1),
 w AS (SELECT match_key, trust AS payload, seq AS updated_at, 1 AS refresh_count, seq AS created_at FROM m WHERE trust >= 3 QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY seq DESC) = 1) """


@query(_SPLIT + "SELECT coalesce(o.match_key, w.match_key) AS match_key, coalesce(w.payload, o.payload) AS payload, coalesce(w.updated_at, o.updated_at) AS updated_at, CASE WHEN o.match_key IS NULL THEN 1 WHEN w.match_key IS NULL THEN o.refresh_count ELSE o.refresh_count + 1 END AS refresh_count, coalesce(o.created_at, w.created_at) AS created_at FROM o FULL JOIN w ON o.match_key = w.match_key")
def insight_upsert(spark, d):
    rows = D.matches(spark, d).select("match_key", F.col("trust").alias("payload"), F.col("seq").alias("updated_at"), F.lit(1).alias("refresh_count"), F.col("seq").alias("created_at"))
    old = windows.first_of(rows.where("payload <= 3"), ["match_key"], [F.col("updated_at")])
    new = windows.first_of(rows.where("payload >= 3"), ["match_key"], [F.col("updated_at").desc()])
    return state.merge(old, new, "match_key", badges.INSIGHT_POLICY)


def _spelt(spark, d) -> DataFrame:
    """Matches whose teams are spelt in several ways by several sources."""
    m = _clubs(spark, d)
    spell = lambda c, k: F.when((F.col("seq") + k) % 5 == 0, F.concat(F.lit("Club  "), F.col(c))).when((F.col("seq") + k) % 5 == 1, F.concat(F.col(c), F.lit(" FC"))).when((F.col("seq") + k) % 5 == 2, F.initcap(c)).otherwise(F.col(c))
    source = F.when(F.col("trust") == 1, "betexplorer").when(F.col("trust") == 2, "football-data.co.uk").otherwise("other")
    return m.select("seq", "date", "season", "league", F.lit(None).cast("string").alias("country"), spell("home", 0).alias("home_team"), spell("away", 1).alias("away_team"), "home_score", "away_score", "outcome", "odds_home", "home_shots", source.alias("source"))


def _aliases(spark) -> DataFrame:
    return spark.createDataFrame([("arden", "Gaul")], "alias string, name string")


_CAP = "upper({0}[1]) || lower({0}[2:])"
_NAMED = _K + f""", x AS (SELECT seq, date, home, away, odds_home, home_shots, home_score, away_score, league, CASE trust WHEN 1 THEN 'betexplorer' WHEN 2 THEN 'football-data.co.uk' ELSE 'other' END AS source, CASE trust WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 9 END AS pr,
  CASE seq % 5 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS hv, CASE (seq + 1) % 5 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS av FROM k),
 y AS (SELECT home AS tm, hv AS v, pr FROM x UNION ALL SELECT away, av, pr FROM x), w AS (SELECT tm, CASE v WHEN 1 THEN 'Club ' || tm WHEN 2 THEN {_CAP.format("tm")} ELSE tm END AS sp, count(*) AS n, min(pr) AS pr FROM y GROUP BY tm, v),
 c AS (SELECT tm, CASE WHEN tm = 'ARDEN' THEN 'Gaul' ELSE sp END AS name FROM w QUALIFY row_number() OVER (PARTITION BY tm ORDER BY n DESC, pr, length(sp), sp) = 1) """


@query(_NAMED + "SELECT x.date, h.name AS home_team, a.name AS away_team, x.source FROM x JOIN c h ON x.home = h.tm JOIN c a ON x.away = a.tm QUALIFY row_number() OVER (PARTITION BY x.date, h.name, a.name ORDER BY pr, (odds_home IS NOT NULL)::INT + (home_shots IS NOT NULL)::INT DESC, league, source, home_score, away_score) = 1")
def normalize_matches(spark, d):
    return N.normalize(_spelt(spark, d), _aliases(spark)).select("date", "home_team", "away_team", "source")


@query(_NAMED + "SELECT DISTINCT league, 'FC ' || home AS team, name FROM k JOIN c ON home = tm")
def align_names(spark, d):
    rows = _spelt(spark, d)
    spelt = N.renamed(rows, N.canonical(N.stacked(rows).select("team").distinct(), _aliases(spark)))
    best = N.collapse_variants(N.stacked(spelt).withColumn("priority", X.trust(F.col("source"))))
    vocabulary = N.stacked(N.renamed(spelt, best)).select("league", "team").distinct()
    asked = _clubs(spark, d).select("league", F.concat(F.lit("FC "), F.col("home")).alias("team")).distinct()
    return N.align(asked, vocabulary, _aliases(spark))


_LONG = _K + """, v AS (SELECT CASE WHEN home = 'HARTLE' AND trust > 2 THEN 'HARTLE REPUBLIC' ELSE home END AS h, CASE WHEN away = 'HARTLE' AND trust > 2 THEN 'HARTLE REPUBLIC' ELSE away END AS a FROM k) """


@query(_LONG + ", cn AS (SELECT tm, count(*) AS n FROM (SELECT h AS tm FROM v UNION ALL SELECT a FROM v) GROUP BY tm) SELECT (SELECT tm FROM cn WHERE tm LIKE 'HARTLE%' ORDER BY n LIMIT 1) AS team, (SELECT tm FROM cn WHERE tm LIKE 'HARTLE%' ORDER BY n DESC LIMIT 1) AS name")
def merge_split_clubs(spark, d):
    """One club under two spellings that never met: the rarer goes by the commoner. All other teams are unlike each other."""
    long = lambda c: F.when((F.col(c) == "HARTLE") & (F.col("trust") > 2), "HARTLE REPUBLIC").otherwise(F.col(c))
    source = F.when(F.col("trust") == 1, "betexplorer").when(F.col("trust") == 2, "football-data.co.uk").otherwise("other")
    rows = _clubs(spark, d).select("league", long("home").alias("home_team"), long("away").alias("away_team"), source.alias("source"))
    return N.merge_split_clubs(rows, spark.createDataFrame([], "name string"))


_SPELLING = "CASE ({1}) % 5 WHEN 0 THEN 'Club  ' || {0} WHEN 1 THEN {0} || ' FC' WHEN 2 THEN " + _CAP + " ELSE {0} END"


@query(_K + f""", g AS (SELECT league, home AS tm, {_SPELLING.format("home", "seq")} AS team FROM k UNION SELECT league, away, {_SPELLING.format("away", "seq + 1")} FROM k)
 SELECT l.league, l.team AS a, r.team AS b, CAST(1 AS DOUBLE) AS ratio FROM g l JOIN g r ON l.league = r.league AND l.tm = r.tm AND l.team < r.team AND lower(l.team) = lower(r.team)""")
def audit_suspects(spark, d):
    """Spellings that differ in case only have ratio 1."""
    return N.suspects(_spelt(spark, d)).where("ratio = 1.0").select("league", "a", "b", "ratio")


@query(_K + "SELECT seq, home AS name, FALSE AS exact FROM k")
def resolve_names(spark, d):
    """Other spellings find the stores' names by key."""
    m = _clubs(spark, d)
    asked = m.select("seq", F.concat(F.lit("FC "), F.lower("home"), F.lit(" 1904")).alias("team"))
    found = N.resolve(asked, m.select(F.col("home").alias("team")).union(m.select("away")).distinct())
    return asked.join(found, "team").select("seq", "name", "exact")


_LAST = "SELECT *, row_number() OVER (PARTITION BY team ORDER BY date DESC, seq DESC) AS i, row_number() OVER (PARTITION BY team, is_home ORDER BY date DESC, seq DESC) AS iv FROM t"


@query(f""" SELECT team, {", ".join(f"round(avg({m}) FILTER (i <= {n}), 3) AS {m}_{n}" for n in (5, 10) for m in ("win", "draw", "gf", "ga", "pts"))}, round(avg(pts) FILTER (is_home AND iv <= 10), 3) AS venue_home_pts, round(avg(ga) FILTER (NOT is_home AND iv <= 10), 3) AS venue_away_ga,
 string_agg(CASE WHEN i <= 5 THEN CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END END, '' ORDER BY i DESC) AS form, count(*) AS matches_played, max(date) AS last_match_date FROM ({_LAST}) GROUP BY team""")
def form_store(spark, d):
    """Means to three places: those of five and ten whole numbers have no more than one."""
    s = windows.form_store(D.matches(spark, d))
    means = [f"{m}_{n}" for n in (5, 10) for m in ("win", "draw", "gf", "ga", "pts")] + ["venue_home_pts", "venue_away_ga"]
    return s.select("team", *(F.round(c, 3).alias(c) for c in means), F.array_join("form_summary", "").alias("form"), "matches_played", "last_match_date")


@query(None)
def ordered_features(spark, d):
    """The model's 81 features in its order; tested against the matrix."""
    return features.ordered(features.matrix(D.matches(spark, d))).select("seq", "outcome", *(F.round(c, 6).alias(c) for c in features.feature_names()))


@query(None)
def model_batch(spark, d):
    """A small ensemble trained on the finished matches predicts the scheduled ones; its trees are tested against a fit on one machine."""
    m = D.matches(spark, d)
    done = m.where("status_group = 'finished'")
    fitted, _ = model.train(done, settings=boosting.Settings(rate=0.1, rounds=5, patience=2), seeds=2)
    return model.batch(fitted, m.where("status_group = 'scheduled'"), done)


@query("""SELECT league, season, count(*) AS n, count(DISTINCT home) AS teams, round(avg((outcome = 1)::INT), 6) AS home_share, round(avg((outcome = 2)::INT), 6) AS draw_share, round(avg((outcome = 3)::INT), 6) AS away_share,
 round(avg((odds_home IS NOT NULL)::INT), 6) AS odds_share, round(avg((home_shots IS NOT NULL)::INT), 6) AS stats_share FROM m GROUP BY GROUPING SETS ((league, season), (league), (season), ())""")
def dataset_report(spark, d):
    return quality.dataset_report(D.matches(spark, d))


@query(""", k AS (SELECT * FROM s WHERE hit IS NOT NULL), z AS (SELECT avg((outcome = 1)::INT) AS s1, avg((outcome = 2)::INT) AS s2, avg((outcome = 3)::INT) AS s3 FROM k)
SELECT league, count(*) AS n, round(avg(hit::INT), 6) AS accuracy, round(avg(-ln(greatest(p_actual, 1e-15))), 6) AS log_loss, round(avg(((home_win - (outcome = 1)::INT) ** 2 + (draw - (outcome = 2)::INT) ** 2 + (away_win - (outcome = 3)::INT) ** 2) / 3), 6) AS brier,
 count(market_hit) AS with_market, round(avg(market_hit::INT), 6) AS market_accuracy, round(avg((outcome = CASE WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END)::INT), 6) AS prior_accuracy,
 round(avg(-ln(CASE outcome WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END)), 6) AS prior_log_loss FROM k, z GROUP BY GROUPING SETS ((league), ())""")
def model_report(spark, d):
    return record.model_report(record.scored(D.matches(spark, d), D.predictions(spark, d)))


@query("SELECT date, season, league, home AS home_team, away AS away_team, home_score, away_score, outcome FROM m")
def ingest_files(spark, d):
    """Matches written as CSV files of the canonical layout and read back by the file source."""
    m = D.matches(spark, d)
    folder = scratch(spark, "csv")
    m.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "league", F.col("home").alias("home_team"), F.col("away").alias("away_team"), "home_score", "away_score").write.option("header", True).option("maxRecordsPerFile", 200_000).csv(folder)  # a file is one task's
    rows, _ = files.ingest(files.discover(spark, folder))
    return rows.select("date", "season", "league", "home_team", "away_team", "home_score", "away_score", "outcome")


@query(""", z AS (SELECT seq, date, status_group, CASE WHEN seq % 6 = 0 THEN TRUE WHEN seq % 6 = 1 THEN FALSE END AS manual, home_win AS h, draw AS d, away_win AS a, CASE WHEN home_win >= draw AND home_win >= away_win THEN 1 WHEN draw >= away_win THEN 2 ELSE 3 END AS pick FROM m JOIN p USING (seq)),
 y AS (SELECT *, coalesce(manual, d >= 0.3 OR greatest(h, d, a) < 0.4) AS perm, CASE WHEN pick = 2 THEN CASE WHEN h >= a THEN h ELSE a END ELSE d END AS other, CASE pick WHEN 1 THEN h WHEN 2 THEN d ELSE a END AS own FROM z WHERE status_group <> 'finished')
SELECT date, count(*) AS picks, count(*) FILTER (perm) AS permed, pow(2, count(*) FILTER (perm)) AS lines, round(exp(sum(ln(own + CASE WHEN perm THEN other ELSE 0 END))), 6) AS chance, pow(2, count(*) FILTER (perm)) AS cost FROM y GROUP BY date""")
def slip_plan(spark, d):
    """Slips with choices by hand, of which settled picks take no part."""
    seq = F.col("seq")
    manual = F.when(seq % 6 == 0, True).when(seq % 6 == 1, False)
    rows = D.matches(spark, d).join(D.predictions(spark, d), "seq").withColumn("_a", X.perm_advice(F.col("home_win"), F.col("draw"), F.col("away_win"), manual))
    return market.slip_maths(rows.select("date", "_a.perm", "_a.covered", F.when(F.col("status_group") == "finished", F.col("_a.pick") == F.col("outcome")).alias("hit")))
