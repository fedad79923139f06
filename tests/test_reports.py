"""What reports on earlier rounds found."""

import random
import statistics
import tracemalloc
from datetime import date, timedelta

from pyspark.sql import functions as F

from touchline.operators import features, quality, windows
from touchline.plans import queries as P
from touchline.sources import files, html


def test_titles_decode_what_the_sql_decodes(spark, tmp_path):
    pages = [(1, "<title>A &amp;&amp; B&amp</title>"), (2, "<title> x\u00a0&eacute; &amp;lt; &copy\n y&lt;</title>"), (3, "<p>none</p>"), (4, None), (5, "<title> \n</title>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in P.page_titles(spark, str(tmp_path)).collect()}
    assert got == {1: "A && B&amp", 2: "x\u00a0&eacute; &lt; &copy y<", 3: None, 4: None, 5: None}
    whole = {r["page_id"]: r["title"] for r in html.titles(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").collect()}
    assert whole[1] == "A && B&" and whole[2] == "x \u00e9 &lt; \u00a9 y<"


def test_a_file_is_decoded_as_its_rows_are_taken():
    body = "".join(f"2020-01-{1 + i % 28:02d},Lïga,home {i},away,1,2\r\n" for i in range(200_000))
    for code, mark in (("utf-8", b"\xef\xbb\xbf"), ("utf-8", b""), ("latin-1", b""), ("latin-1", b"\xef\xbb\xbf")):
        content = mark + ("date,league,home_team,away_team,home_score,away_score\r\n" + body).encode(code)
        tracemalloc.start()
        header, rows = files.cells(content)
        n = sum(r[1] == "Lïga" for r in rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert header[0] == "date" and n == 200_000 and peak < len(content) / 2, (code, peak, len(content))
    assert [list(r) for r in files.cells(b'a,b\n"x\r\ny",1\n\n1,2,3\n4\n')[1]] == [["x\r\ny", "1"], ["4", ""]] and files.cells(b"")[0] == []


def _matches(spark, n: int, teams: int):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        league = rng.choice("LM")
        home, away = rng.sample([f"{league}{t}" for t in range(teams)], 2)
        goals = [rng.choice([0, 1, 2, 3, None]) for _ in range(2)]
        rows.append((i, date(2020, 1, 1) + timedelta(days=rng.randrange(900)), rng.choice(["a", "b"]), league, home, away, *goals, *(rng.choice([None, 1, 7]) for _ in range(6)), *(rng.choice([None, 1.5, 3.0]) for _ in range(3))))
    return rows, spark.createDataFrame(rows, "seq long, date date, season string, league string, home string, away string, home_score int, away_score int, home_shots int, away_shots int, home_shots_on_target int, away_shots_on_target int, home_corners int, away_corners int, odds_home double, odds_draw double, odds_away double").withColumn("outcome", F.lit(1))


def test_positions_equal_a_plain_fold(spark, monkeypatch):
    monkeypatch.setattr(windows, "CELLS", 20)
    rows, df = _matches(spark, 300, 6)
    table, want = {}, {}
    for seq, _, season, league, home, away, x, y, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        of = table.setdefault((season, league), {})
        want[seq] = tuple(1 + sum(v > of.get(t, (0, 0)) for v in of.values()) for t in (home, away))
        if x is not None and y is not None:
            for t, d in ((home, x - y), (away, y - x)):
                p, g = of.get(t, (0, 0))
                of[t] = (p + 3 * (d > 0) + (d == 0), g + d)
    assert {r["seq"]: (r["home_pos"], r["away_pos"]) for r in windows.as_of_position(df).collect()} == want


def test_features_read_their_matches_once_and_meet_by_few_joins(spark):
    rows, df = _matches(spark, 200, 5)
    m = features.matrix(df)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 6 and "collect_list" not in plan
    got = {r["seq"]: r for r in m.collect()}
    past: dict[str, list] = {}
    for seq, _, _, _, home, away, x, y, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        for n in (5, 10):
            known = [v for v in past.get(home, [])[-n:] if v is not None]
            assert got[seq][f"home_gf_{n}"] == (sum(known) / len(known) if known else None)
        past.setdefault(home, []).append(x)
        past.setdefault(away, []).append(y)


def test_medians_are_exact_when_sketches_see_few_values(spark, monkeypatch):
    monkeypatch.setattr(quality, "SKETCHED", 300)
    rng = random.Random(2)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), rng.expovariate(1) if i % 500 == 0 else None) for i in range(6000)]
    got = quality.medians(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], 20).first()
    for i, c in enumerate("abc"):
        assert abs(got[c] - statistics.median(r[i] for r in rows if r[i] is not None)) <= 1e-4
