import datetime as dt

from pyspark.sql import functions as F

from touchline.functions import scalar as X
from touchline.operators import badges, market, quality
from touchline.sources import feeds, html
from touchline.streaming import micro


def test_bookmakers_consensus(spark):
    book = lambda *p: {"key": "b", "markets": [{"key": "h2h", "outcomes": [{"name": n, "price": x} for n, x in zip(("A", "Draw", "B"), p) if x]}, {"key": "totals", "outcomes": []}]}
    kind = "home_team string, away_team string, commence_time string, bookmakers array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>"
    df = spark.createDataFrame([("A", "B", "t", [book(2.0, 4.0, 4.0), book(4.0, 4.0, 2.0), book(2.0, 4.0, None)])], kind)
    r = market.consensus(df).first().asDict(recursive=True)
    said = {k: v for k, v in r.items() if isinstance(v, (float, dict))}
    flat = [x for v in said.values() for x in (v.values() if isinstance(v, dict) else [v])]
    assert sorted(round(x, 6) for x in flat if isinstance(x, float)) == [0.25, 0.375, 0.375]


def test_files_of_one_season(spark):
    df = spark.createDataFrame([("b", "L", "1"), ("a", "L", "1"), ("a", "L", "2"), ("a", "L", "1")], "file string, league string, season string")
    assert [(r["season"], r["files"]) for r in quality.duplicate_season_files(df).collect()] == [("1", ["a", "b"])]


def test_windows_of_days(spark):
    row = spark.range(1).select(feeds.date_windows(F.lit("2024-01-01").cast("date"), F.lit("2024-01-25").cast("date")).alias("w")).first()["w"]
    day = lambda n: dt.date(2024, 1, n)
    assert [(w["first"], w["last"]) for w in row] == [(day(1), day(10)), (day(11), day(20)), (day(21), day(25))]


def test_badge_tally_and_labels(spark):
    r = badges.tally(spark.createDataFrame([("a", "u"), ("b", None)], "team string, badge_url string")).first()
    assert (r["total"], r["with_badge"]) == (2, 1)
    hue = 0
    for c in "Ajax":
        hue = (hue * 31 + ord(c)) & 0xFFFFFFFF
        hue -= (hue >> 31) << 32
    got = spark.range(1).select(X.hue(F.lit("Ajax")).alias("h"), X.season_dash(F.lit("2024/25")).alias("d")).first()
    assert got["h"] == abs(hue) % 360 and got["d"] in ("2024-2025", "2024-25")


def test_days_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 23, 59, 59), "a", 1.5), (dt.datetime(2024, 1, 2), "a", 2.0), (dt.datetime(2024, 1, 2, 12), "b", 0.25)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = micro.daily(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="1 day").writeStream.format("memory").queryName("days").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, micro.daily(df).collect()))


def test_element_trees(spark):
    page = '<p class="x y">a &#233;&amp;<b>b</b><p>c<br>d<ul><li>1<li>2</ul><script>if (a<b) "</p>"</script><a href="/q?x=1&amp;y=2" href="z"> l\xa0 <i>m</i></a></div>'
    nodes = html.parsed(page)
    tags = [(n[2], n[0], n[1]) for n in nodes if n[2] != "#text"]
    assert [t for t, _, _ in tags] == ["p", "b", "p", "br", "ul", "li", "li", "script", "a", "i"]
    assert next(n for n in nodes if n[2] == "p")[1] == 3 and all(a <= b < len(nodes) for _, a, b in tags)
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, page string")
    assert [tuple(r) for r in html.anchors(df, "id", "page").collect()] == [(1, "/q?x=1&y=2", "l m")]
    assert {r["id"]: r["title"] for r in html.titles(df, "id", "page").collect()} == {1: None, 2: None, 3: None}
    assert {(r["tag"], r["n"], r["words"]) for r in html.outline(df, "id", "page").where("tag in ('p', 'li')").collect()} == {("p", 2, 3), ("li", 2, 2)}
    row = spark.range(1).select(html.plain(F.lit("<b>a&#x26;&eacute;</b>&nbsp; b")).alias("p"), html.escaped(F.lit('a<b>&"')).alias("e")).first()
    assert (row["p"], row["e"]) == ("a&é b", "a&lt;b&gt;&amp;&quot;")
