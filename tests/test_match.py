"""Match operators against literals and plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import names as N
from touchline.functions import scalar as X
from touchline.operators import boosting, features, fixtures, model, ratings, state, store, windows
from touchline.sources import feeds, files, html
from touchline.streaming import micro

COLUMNS = "seq long, date date, season string, league string, home string, away string, home_score int, away_score int, home_shots int, away_shots int"


def _matches(spark, n=60, teams=("A", "B", "C", "D"), seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        h, a = rng.sample(teams, 2)
        rows.append((i, dt.date(2020, 7, 1) + dt.timedelta(days=i // 2), "2020/21", "L", h, a, rng.randrange(5), rng.randrange(5), rng.choice([None, 5, 9]), 3))
    return rows, spark.createDataFrame(rows, COLUMNS)


def test_ratings_equal_a_plain_fold(spark):
    rows, df = _matches(spark)
    elo, want = {}, {}
    for seq, _, _, _, h, a, x, y, _, _ in rows:
        eh, ea = elo.get(h, 1000.0), elo.get(a, 1000.0)
        want[seq] = (eh, ea)
        e = 1 / (1 + 10 ** ((ea - eh - 60) / 400))
        m = abs(x - y)
        step = 20 * (1 if m <= 1 else 1.5 if m == 2 else (11 + m) / 8) * ((x > y) + 0.5 * (x == y) - e)
        elo[h], elo[a] = eh + step, ea - step
    got = {r["seq"]: (r["home_elo"], r["away_elo"]) for r in ratings.ratings(df).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][i], want[k][i], abs_tol=1e-9) for k in want for i in (0, 1))


def test_ratings_of_components_are_independent(spark):
    one, a = _matches(spark, teams=("A", "B", "C"))
    two = [(r[0] + 1000, *r[1:4], r[4] + "x", r[5] + "x", *r[6:]) for r in one]
    both = ratings.ratings(a.unionByName(spark.createDataFrame(two, COLUMNS)))
    alone = {r["seq"]: r["home_elo"] for r in ratings.ratings(a).collect()}
    assert all(math.isclose(r["home_elo"], alone[r["seq"] % 1000]) for r in both.collect())


def test_no_feature_sees_the_future(spark):
    rows, df = _matches(spark)
    cut = 40
    short = df.where(f"seq < {cut}")
    for f in (windows.rolling_form, windows.head_to_head, windows.as_of_position, windows.season_standing):
        keys = [c for c in ("seq", "team", "is_home") if c in f(short).columns]
        whole = {tuple(r[k] for k in keys): r for r in f(df).where(f"seq < {cut}").collect()}
        assert {tuple(r[k] for k in keys): r for r in f(short).collect()} == whole


def test_position_counts_only_teams_that_played(spark):
    rows = [(0, dt.date(2020, 8, 1), "2020/21", "L", "A", "B", 0, 2, 1, 1), (1, dt.date(2020, 8, 2), "2020/21", "L", "C", "A", 1, 1, 1, 1), (2, dt.date(2020, 8, 3), "2020/21", "L", "D", "B", 1, 0, 1, 1)]
    got = {r["seq"]: (r["home_pos"], r["away_pos"]) for r in windows.as_of_position(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {0: (1, 1), 1: (2, 2), 2: (4, 1)}  # a newcomer counts as 0 points, and only teams that played are ahead


def test_upsert_never_moves_backward(spark):
    cols = "match_key string, progress int, home_score int, updated_at long"
    now = spark.createDataFrame([("a", 3, 1, 1), ("b", 0, None, 1), ("c", 2, 0, 1)], cols)
    new = spark.createDataFrame([("a", 2, 9, 2), ("b", 3, 2, 2), ("b", 2, 7, 3), ("c", 2, None, 2), ("d", 0, None, 2)], cols)
    got = {r["match_key"]: tuple(r)[1:] for r in state.upsert_fixtures(now, new).collect()}
    assert got == {"a": (3, 1, 1), "b": (3, 2, 2), "c": (2, 0, 2), "d": (0, None, 2)}
    once = state.upsert_fixtures(now, new)
    assert sorted(map(tuple, state.upsert_fixtures(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_diff_counts_missing_scores_as_conflicts(spark):
    cols = "match_key string, home_score int, away_score int"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", None, None)], cols)
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", None, None), ("d", 0, 0)], cols)
    assert tuple(state.diff_counts(state.diff(old, new)).first()) == (1, 1, 2)


def test_slip_keeps_its_order(spark):
    slip = spark.createDataFrame([("d", "a", 1), ("d", "b", 2), ("d", "c", 3)], "date string, match_key string, position int")
    up = {r["match_key"]: r["position"] for r in state.move_in_slip(slip, "d", "c", True).collect()}
    down = {r["match_key"]: r["position"] for r in state.move_in_slip(slip, "d", "c", False).collect()}
    assert up == {"a": 1, "c": 2, "b": 3} and down == {"a": 1, "b": 2, "c": 3}
    left = state.resequence(slip.where("match_key <> 'b'"))
    assert {r["match_key"]: r["position"] for r in left.collect()} == {"a": 1, "c": 2}


def test_reaper_touches_only_old_open_rows(spark):
    t = dt.datetime
    rows = spark.createDataFrame([("a", "NS", "scheduled", 0, t(2020, 1, 1)), ("b", "FT", "finished", 3, t(2020, 1, 1)), ("c", "NS", "scheduled", 0, t(2020, 1, 2, 11))], "match_key string, status string, status_group string, progress int, kickoff_utc timestamp")
    got = {r["match_key"]: r["status_group"] for r in state.reap(rows, F.lit("2020-01-02 12:00:00").cast("timestamp")).collect()}
    assert got == {"a": "off", "b": "finished", "c": "scheduled"}


CLUB_PAIRS = [
    ("Brest", "Stade Brestois 29", True), ("Real", "Real Madrid", False), ("Sparta Praha", "Sparta Praha II", False), ("Inter Milan", "Internazionale Milano", True),
    ("AZ", "AZ Alkmaar", True), ("Benfica", "Sport Lisboa e Benfica", True), ("Lyon", "Lens", False), ("Alfa Beta", "Alfa Alfax", False), ("Alfa Alfax", "Alfax Alfa Gamma", True), ("Alfa Alfab", "Alfab Alfac", True), ("Sporting Gijon", "Sporting Gijón FC", False),
]


def test_same_clubs(spark):
    names = spark.createDataFrame([(str(i), t) for i, (a, b, _) in enumerate(CLUB_PAIRS) for t in (a, b)], "league string, team string").withColumn("key", N.key(F.col("team")))
    got = {(r["league"], *sorted((r["a"], r["b"]))) for r in N.one_club(N.candidate_pairs(names)).collect()}
    assert got == {(str(i), *sorted((a, b))) for i, (a, b, same) in enumerate(CLUB_PAIRS) if same}


def test_keys(spark):
    cases = [("FC Köln", "koln"), ("ST Mirren", "saint mirren"), ("Bayer 04 Leverkusen", "bayer leverkusen"), ("  AFC  FC Bourne  ", "bourne"), ("FC", "fc"), (" ", " "), (None, None), ("Man. Utd.", "man united"), ("1899 Hoffenheim", "hoffenheim")]
    df = spark.createDataFrame([(a, b) for a, b in cases], "name string, want string")
    got = df.select("want", N.key(F.col("name")).alias("key"), N.stripped(F.col("name")).alias("shown")).collect()
    assert [r["key"] for r in got] == [r["want"] for r in got]
    assert [r["shown"] for r in got][3] == "Bourne"
    row = spark.range(1).select(N.market_key(F.lit("Wolves")).alias("w"), N.market_key(F.lit("1. FC Köln 1948")).alias("k"), N.market_same(F.lit("brighton"), F.lit("brighton and hove albion")).alias("s"), N.market_same(F.lit("united"), F.lit("leeds united")).alias("g"), N.serving_key(F.lit("St-Étienne")).alias("e")).first()
    assert tuple(row) == ("wolverhampton wanderers", "koln" if row["k"] == "koln" else row["k"], True, False, "saint etienne")


def test_names_resolve_and_merge(spark):
    rows = [("L", "Alpha", "Beta", "betexplorer")] * 3 + [("L", "Alpha Rovers", "Gamma", "other"), ("M", "Delta", "Alpha", "other")]
    m = spark.createDataFrame(rows, "league string, home_team string, away_team string, source string")
    none = spark.createDataFrame([], "name string")
    assert {(r["team"], r["name"]) for r in N.merge_split_clubs(m, none).collect()} == {("Alpha Rovers", "Alpha")}
    assert {(r["team"], r["name"]) for r in N.merge_split_clubs(m, spark.createDataFrame([("Alpha Rovers",)], "name string")).collect()} == {("Alpha", "Alpha Rovers")}
    found = N.suggested(N.suspects(m.unionByName(spark.createDataFrame([("L", "Al-pha", "Zeta", "other")], m.schema))), m).collect()
    assert [(r["a"], r["b"], r["ratio"], r["keep"]) for r in found] == [("Al-pha", "Alpha", 1.0, "Alpha")]


def test_spellings_collapse_and_clubs_merge(spark):
    rows = spark.createDataFrame([("Köln", 0)] * 3 + [("FC Koln", 0), ("Lens", 1)], "team string, priority int")
    got = {r["team"]: r["name"] for r in N.collapse_variants(rows).collect()}
    assert got == {"Köln": "Köln", "FC Koln": "Köln", "Lens": "Lens"}
    names = spark.createDataFrame([("L", "Brest", "brest"), ("L", "Stade Brestois", "stade brestois"), ("L", "Lyon", "lyon")], "league string, team string, key string")
    played = spark.createDataFrame([("Brest", "Lyon")], "home string, away string")
    assert [tuple(r) for r in N.split_clubs(played, names).collect()] == [("L", "Brest", "Stade Brestois")]
    against = spark.createDataFrame([("Stade Brestois", "Brest")], "home string, away string")
    assert N.split_clubs(against, names).isEmpty()
    fix = spark.createDataFrame([("L", "Stade Brestois 29"), ("L", "Nobody")], "league string, team string")
    assert {r["team"]: r["name"] for r in N.align(fix, names).collect()} == {"Stade Brestois 29": "Stade Brestois", "Nobody": "Nobody"}


def test_bulk_csv(spark, tmp_path):
    (tmp_path / "E0.csv").write_bytes("﻿Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,B365H,AvgH,B365D,AvgD,B365A,AvgA\nE0,12/08/2023,Arsenal,Chelsea,2,1,H,1.5,1.6,4,4,6,6\nE0,13/08/23,Leeds,Derby,0,0,,,2.5,3,3,3,3\nE0,bad,X,Y,1,1,D,1,1,1,1,1,1\nZZ,12/08/2023,A,B,1,0,H,1,1,1,1,1,1\nE0,14/08/2023,P,Q,1,2,A,1,1,1,1,1,1,9,9\n".encode())
    found = files.discover(spark, str(tmp_path))
    assert found.count() == 1 and files.changed(found, found).isEmpty()
    parsed, report = files.ingest(found)
    assert [r["layout"] for r in report.collect()] == ["bulk"]
    kept = files.recorded(files.load_table(spark, str(tmp_path / "none"), files.MANIFEST), found, parsed, F.lit("2024-01-01").cast("timestamp"))
    assert [(r["name"], r["rows"]) for r in kept.collect()] == [("E0.csv", 2)] and files.changed(found, kept).isEmpty()
    rows = parsed.orderBy("date").collect()
    assert [(r["home_team"], r["outcome"], r["odds_home"], r["season"], r["league"]) for r in rows] == [("Arsenal", 1, 1.5, "2023/24", "Premier League"), ("Leeds", 2, 2.5, "2023/24", "Premier League")]


def test_feeds(spark):
    api = '{"response":[{"fixture":{"id":7,"date":"2024-03-01T19:00:00+00:00","status":{"short":"FT","elapsed":90},"venue":{"name":"V"}},"league":{"id":39,"name":"Premier League","country":"England","season":2023},"teams":{"home":{"name":"A"},"away":{"name":"B"}},"goals":{"home":2,"away":0}}]}'
    fd = '{"matches":[{"id":1,"utcDate":"2024-03-01T19:00:00Z","status":"2024-03-01","competition":{"name":"L"},"area":{"name":"E"},"homeTeam":{"name":"A"},"awayTeam":{"name":"B"},"score":{"fullTime":{"home":1,"away":1}}}]}'
    ts = '{"events":[{"idEvent":"5","strTimestamp":"2024-03-01T19:00:00","strStatus":"","strProgress":"90+5","strHomeTeam":"A","strAwayTeam":"B","intHomeScore":null,"intAwayScore":null}]}'
    of = '{"rounds":[{"matches":[{"date":"2024-03-01","team1":"A","team2":{"name":"B"},"score":{"ft":[3,1]}},{"date":"2024-03-02","team1":"C","team2":"D","score1":0,"score2":0},{"date":"2024-03-03","team1":"E","team2":"F"}]}]}'
    p = lambda x: spark.createDataFrame([(x,)], "payload string")
    assert [(r["outcome"], r["home_team"]) for r in feeds.to_matches(feeds.api_football(p(api))).collect()] == [(1, "A")]
    assert feeds.football_data(p(fd)).first()["status"] == "FINISHED"
    r = feeds.sports_db(p(ts)).first()
    assert (r["status"], r["minute"]) == ("NS", 90)
    assert [(r["home_team"], r["away_team"], r["outcome"]) for r in feeds.openfootball(p(of), "L", "E").orderBy("date").collect()] == [("A", "B", 1), ("C", "D", 2)]


def test_odds_rows(spark):
    page = '<table><tr><td><a href="/x">Home FC - Away &amp; Co</a></td><td>2:1</td><td data-odd="1.50"></td><td data-odd="4.1"></td><td data-odd="6"></td><td>05.03.</td></tr><tr><td>none</td></tr></table>'
    r = html.odds_rows(spark.createDataFrame([(page,)], "html string"), "html", F.lit("2024-03-10").cast("timestamp")).collect()
    assert [(x["date"], x["home_team"], x["away_team"], x["home_score"], x["odds_away"]) for x in r] == [(dt.date(2024, 3, 5), "Home FC", "Away & Co", 2, 6.0)]


def test_scalar_rules(spark):
    row = spark.sql("select date'2020-06-30' a, date'2020-07-01' b, 0.2D h, 0.5D d, 0.3D w")
    got = row.select(X.season_label(F.col("a")), X.season_label(F.col("b")), X.perm_advice(F.col("h"), F.col("d"), F.col("w")).alias("p"), X.status_group(F.lit(" susp ")), X.status_group(F.lit("SUSPENDED")), X.status_group(F.lit("UNKNOWN"))).first()
    assert got[0] == "2019/20" and got[1] == "2020/21"
    assert (got["p"]["pick"], got["p"]["perm"], got["p"]["other"]) == (2, True, 3) and math.isclose(got["p"]["covered"], 0.8)
    assert tuple(got[3:]) == ("in_play", "off", "scheduled")


def test_stream_keeps_state(spark, tmp_path):
    cols = "match_key string, progress int, home_score int, updated_at long"
    for i, rows in enumerate(([("a", 0, None, 1)], [("a", 3, 2, 2), ("b", 0, None, 2)], [("a", 2, 1, 3)])):
        spark.createDataFrame(rows, cols).write.mode("append").parquet(str(tmp_path / "in"))
        q = micro.keep_fixtures(spark.readStream.schema(cols).parquet(str(tmp_path / "in")), store.Store(spark, str(tmp_path / "out")), str(tmp_path / "cp"))
        q.awaitTermination()
    got = {r["match_key"]: (r["progress"], r["home_score"]) for r in store.Store(spark, str(tmp_path / "out")).read("fixtures").collect()}
    assert got == {"a": (3, 2), "b": (0, None)}


def test_feature_matrix_and_serving(spark):
    rows, df = _matches(spark)
    df = df.withColumns({"outcome": X.outcome(F.col("home_score"), F.col("away_score")), "odds_home": F.lit(2.0), "odds_draw": F.lit(3.0), "odds_away": F.lit(4.0)})
    m = features.matrix(df)
    assert m.count() == len(rows)
    # serving: the stores without the last match give the features that training has of it
    last = rows[-1][0]
    served = features.serving_rows(df.where(f"seq = {last}"), df.where(f"seq < {last}")).first()
    trained = m.where(f"seq = {last}").first()
    for a, b in (("home_gf_5", "home_gf_5"), ("away_pts_10", "away_pts_10"), ("home_days_rest", "home_days_rest")):
        assert math.isclose(served[a], trained[b], abs_tol=1e-3)


def test_serving_equals_training(spark):
    rows, df = _matches(spark, seed=2)
    n = lambda k, m: F.when(F.col("seq") % 7 != 0, (F.col("seq") * k % m).cast("int"))
    df = df.withColumns({
        "outcome": X.outcome(F.col("home_score"), F.col("away_score")), "odds_home": F.lit(2.0), "odds_draw": F.lit(3.0), "odds_away": F.lit(4.0),
        "home_shots_on_target": n(3, 5), "away_shots_on_target": n(5, 6), "home_corners": n(7, 8), "away_corners": n(4, 9),
    })
    m = features.matrix(df)
    assert {f"{s}_{k}_{way}_{w}" for s in ("home", "away") for k in ("sot", "shots", "corners") for way in ("for", "against") for w in (5, 10)} | {"sot_diff_10"} <= set(m.columns)
    last = rows[-1][0]
    trained = m.where(f"seq = {last}").first().asDict()
    served = features.serving_rows(df.where(f"seq = {last}"), df.where(f"seq < {last}")).first().asDict()
    assert trained.keys() - served.keys() == {"outcome"} and trained["sot_diff_10"] is not None
    for c in trained.keys() - {"outcome"}:
        # ratings and means of stores are rounded
        assert math.isclose(served[c], trained[c], abs_tol=2e-2 if "elo" in c else 1e-3), c
    strip = [("W" if (r[6] > r[7]) == (r[4] == rows[-1][4]) else "L") if r[6] != r[7] else "D" for r in rows[:-1] if rows[-1][4] in r[4:6]][-5:]
    assert served["home_form_summary"] == strip and served["defaults_used"] == 0
    new = features.serving_rows(df.where(f"seq = {last}").withColumns({"home": F.lit("new"), "league": F.lit("M")}), df.where(f"seq < {last}")).first().asDict()
    assert (new["home_known"], new["away_known"], new["league_known"], new["home_elo"], new["h2h_home_winrate"], new["home_pos"]) == (False, True, False, 1000.0, 0.5, 1)
    assert new["home_gf_5"] is not None and new["home_sot_for_5"] is None and new["defaults_used"] > 12 and new["defaulted"].count(",") == 11


def test_latin_1_quotes_and_unknown_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nSP1,12/08/2023,M\xe1laga,\"Sevilla, B\",2,1\nSP1,13/08/2023,A,B,1,1,extra\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "england-premier-league-matches-2023.csv").write_text("date_GMT,status,home_team_name,away_team_name,home_team_goal_count,away_team_goal_count,odds_ft_home_team_win\nAug 12 2023 - 2:00pm,complete,Arsenal,Leeds,2,1,1.0\nAug 13 2023 - 2:00pm,suspended,Derby,Leeds,2,1,2.0\n")
    rows, report = files.ingest(files.discover(spark, str(tmp_path)), with_aggregates=True)
    assert {(r["name"], r["layout"]) for r in report.collect()} == {("a.csv", "bulk"), ("b.csv", None), ("england-premier-league-matches-2023.csv", "aggregate")}
    got = {(r["home_team"], r["away_team"], r["league"], r["odds_home"]) for r in rows.collect()}
    assert got == {("M\xe1laga", "Sevilla, B", "La Liga", None), ("Arsenal", "Leeds", "Premier League", None)}


def test_files_of_many_headers_are_one_plan(spark, tmp_path):
    """What orders say of matches, written as files of the bulk layout with headers and encodings of their own, comes back."""
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderkey % 20 = 0").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"), "o_totalprice").collect()
    want = set()
    for i in range(6):
        extra = [f"X{j}" for j in range(i)]
        lines = [",".join(["Div", "Date", "HomeTeam", "AwayTeam", *extra, "FTHG", "FTAG", " HS "])]
        for r in o[i::6]:
            h, a = int(r[2]) % 5, int(r[2] / 10) % 4
            home = f"Málaga {r[0]}" if i % 2 else f'"A, {r[0]}"'
            lines.append(",".join(["SP1", r[1], home, "B", *extra, str(h), str(a), str(i)]) + (",too,long" if r[0] % 100 == 0 else ""))
            if r[0] % 100:
                want.add((home.strip('"'), r[1], h, a, i))
        text = "\r\n".join([*lines, "", "SP1"])
        (tmp_path / f"f{i}.csv").write_bytes(text.encode("utf-8-sig" if i % 3 else "latin-1"))
    rows, report = files.ingest(files.discover(spark, str(tmp_path)))
    assert {r["layout"] for r in report.collect()} == {"bulk"} and report.count() == 6
    got = {(r["home_team"], r["date"].strftime("%d/%m/%Y"), r["home_score"], r["away_score"], r["home_shots"]) for r in rows.collect()}
    assert got == want and len(want) > 50
    assert rows._jdf.queryExecution().executedPlan().toString().count("Scan binaryFile") <= 3 * len(files.USED)


def test_archive_pages(spark):
    page = '<a href="https://globalsportsarchive.com/en/soccer/match/2024-05-01/a-vs-b/77"><div class="gsa-d-sm-md-none gsa-d-block"> Alpha &amp; Co </div><div class="gsa-d-sm-md-none gsa-d-block">Beta</div><i class="gsa-match-rounds-v2__match-score"><div class="gsa-text-yellow"> 2 </div><div class="gsa-text-grey">1</div></i></a><a href="https://globalsportsarchive.com/en/soccer/match/2024-06-01/a-vs-c/78"><div class="gsa-d-sm-md-none gsa-d-block">Alpha</div></a><a href="https://globalsportsarchive.com/en/soccer/team/alpha/5/">x</a>'
    df = spark.createDataFrame([(page,), (page,)], "html string")
    rows = html.archive_rows(df, "html").collect()
    assert [(r["match_id"], r["season"], r["home_team"], r["away_team"], r["home_score"], r["away_score"], r["outcome"]) for r in rows] == [("77", "2023/24", "Alpha & Co", "Beta", 2, 1, 1)]
    assert [r["url"] for r in html.archive_clubs(df, "html").collect()] == ["https://globalsportsarchive.com/en/soccer/team/alpha/5"]


def test_undated_rows_and_few_odds(spark):
    row = '<tr><td><a class="in-match">A - B</a></td><td>2:1</td><td data-odd="1.5"></td><td data-odd="4"></td></tr>'
    r = html.odds_rows(spark.createDataFrame([(row + row,)], "html string"), "html", F.lit("2024-03-10").cast("timestamp")).collect()
    assert [(str(x["date"]), x["home_team"], x["odds_home"]) for x in r] == [("2024-03-10", "A", None)]


def test_search_folds_accents_and_replies_parse(spark):
    row = spark.range(1).select(
        X.has_all_words(F.lit("Atlético Málaga"), F.lit("MALAGA atle")).alias("a"), X.has_all_words(F.lit("Malaga"), F.lit("málag")).alias("b"), X.has_all_words(F.lit("Malaga"), F.lit("sevilla")).alias("c"),
        X.stale_label(F.lit(0.5)).alias("d"), X.stale_label(F.lit(47.0)).alias("e"), X.stale_label(F.lit(49.0)).alias("f"),
        X.insight(F.lit('Sure! ```json\n{"summary": " s ", "key_factors": ["1","","2","3","4","5","6","7"], "tier_rationales": [{"tier":"LOW","rationale":"r"},{"tier":"odd","rationale":"x"}]}``` bye')).alias("i"), X.insight(F.lit("none")).alias("n"),
    ).first()
    assert tuple(row)[:6] == (True, True, False, "30m ago", "47h ago", "2d ago")
    i = row["i"]
    assert (i["summary"], i["key_factors"], i["low"], i["medium"], i["model_commentary"]) == ("s", ["1", "2", "3", "4", "5", "6"], "r", "", "") and row["n"] is None


def test_digest(spark):
    rows = spark.createDataFrame([("L & M", "A", "B", "2024-05-01 18:00:00", 0.6, 0.3, 0.1), ("L", "C", "D", "2024-05-01 12:00:00", 0.35, 0.25, 0.4), ("L", "E", "F", "2024-05-01 13:00:00", None, None, None)], "league string, home_team string, away_team string, kickoff_utc string, home_win double, draw double, away_win double").withColumn("kickoff_utc", F.col("kickoff_utc").cast("timestamp"))
    edge = spark.createDataFrame([("L", "ahead"), ("M", "level")], "league string, edge string")
    text = fixtures.digest(rows, edge, "2024-05-01").first()["text"]
    assert "3 matches, 2 with probabilities" in text and "• 20:00 L &amp; M · A v B — <b>1</b> A 60%" in text and "<b>1X</b> (draw 30%)" in text and "Better than the market: L" in text and "1 without probabilities" in text
    assert fixtures.digest(rows.limit(0), edge, "2024-05-01").first()["text"].endswith("No matches.")


def test_model_trains_predicts_and_gates(spark, tmp_path):
    rng, rows = random.Random(4), []
    for s in range(6):
        for i in range(60):
            h, a = rng.sample("ABCDEF", 2)
            x = 2 if h < a else 0
            rows.append((s * 60 + i, dt.date(2015 + s, 8, 1) + dt.timedelta(days=i), f"{2015 + s}/{16 + s}", "L", h, a, x + rng.randrange(2), 1, 5, 3))
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"outcome": X.outcome(F.col("home_score"), F.col("away_score")), "odds_home": F.lit(None).cast("double"), "odds_draw": F.lit(None).cast("double"), "odds_away": F.lit(None).cast("double")})
    fitted, held = model.train(df, settings=boosting.Settings(rate=0.3, depth=2, least=2.0, rounds=6, patience=2), seeds=2)
    assert len(fitted.boosted.rounds[0]) == 2 and len(fitted.columns) == 81 and held["n"] == 120 and held["accuracy"] > 0.5
    assert len(fitted.boosted.rounds) == int(held["rounds"] * 1.1) and held["log_loss"] < held["prior_log_loss"]
    fitted.save(spark, str(tmp_path / "model"))
    fitted = model.Ensemble.load(spark, str(tmp_path / "model"))
    assert model.accepted(held, None) and not model.accepted({"accuracy": 0.4}, {"accuracy": 0.5}) and model.accepted({"accuracy": 0.495}, {"accuracy": 0.5})
    ask = spark.createDataFrame([(1, dt.date(2022, 1, 1), "L", "fc a", "F"), (2, dt.date(2022, 1, 1), "L", "Nobody", "B")], "seq long, date date, league string, home string, away string")
    got = {r["seq"]: r for r in model.batch(fitted, ask, df, strict=True).collect()}
    assert got[2]["error"] == "unknown club(s): Nobody" and got[2]["home_win"] is None
    assert got[1]["error"] is None and got[1]["home"] == "A" and got[1]["home_name_exact"] is False and math.isclose(got[1]["home_win"] + got[1]["draw"] + got[1]["away_win"], 1.0)
