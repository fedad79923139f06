"""Fixtures: rows for the store, renames, one row a match, liveness, the lists that are read from them, and the day's digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions import names as N
from touchline.functions import scalar as X

#: Hours for which a live row is believed without an update, and for which a feed counts as fresh.
LIVE_HOURS, FRESH_HOURS = 2, 12
PICKS = ("1", "X", "2")


def hours_since(written: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(written)) / 3.6e9


def liveness(fixtures: DataFrame, now: Column) -> DataFrame:
    """fixtures(status_group, updated_at) with live and stalled: in play, and written recently or not. A row that doesn't say when
    it was written is as old as can be."""
    recent = F.coalesce(hours_since(F.col("updated_at"), now) <= LIVE_HOURS, F.lit(False))
    playing = F.coalesce(F.col("status_group") == "in_play", F.lit(False))
    return fixtures.withColumns({"live": playing & recent, "stalled": playing & ~recent})


def staleness(fixtures: DataFrame, now: Column, *by: str) -> DataFrame:
    """A row, or one for each value of `by`: when anything was written last, and whether that is within the windows in which live
    states, and the feed as a whole, are trusted."""
    last = F.max("updated_at")
    age = hours_since(last, now)
    return fixtures.groupBy(*by).agg(last.alias("last_update"), F.coalesce(age <= LIVE_HOURS, F.lit(False)).alias("live_trusted"), F.coalesce(age <= FRESH_HOURS, F.lit(False)).alias("feed_trusted"))


def between(fixtures: DataFrame, start: Column, end: Column) -> DataFrame:
    """Kickoffs from start on, before end."""
    return fixtures.where((F.col("kickoff_utc") >= start) & (F.col("kickoff_utc") < end))


def history_page(finished: DataFrame, first: str | None, last: str | None, limit: int = 1000) -> DataFrame:
    """Of the newest finished matches, those whose UTC day is from first to last, both included."""
    page = finished.orderBy(F.col("kickoff_utc").desc(), F.col("match_key").desc()).limit(limit)
    day = F.date_format("kickoff_utc", "yyyy-MM-dd")
    return page.where(F.lit(True) & (day >= first if first else F.lit(True)) & (day <= last if last else F.lit(True)))


def dedupe(fixtures: DataFrame) -> DataFrame:
    """One row for each UTC day and pair of teams: of the most trusted source, the earliest kickoff."""
    whole = fixtures.dropna(subset=["kickoff_utc", "home_team", "away_team"])
    trust = X.trust(F.col("source"), S.FIXTURE_PRIORITY)
    order = Window.partitionBy(F.to_date("kickoff_utc"), "home_team", "away_team").orderBy(trust, "kickoff_utc", "source", *([c for c in ("source_match_id",) if c in fixtures.columns]))
    return whole.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def store_rows(fixtures: DataFrame, now: Column) -> DataFrame:
    """Fixtures as the store holds them: keyed by UTC day and teams, with the status's group and progress; an outcome and an end
    only once finished."""
    whole = fixtures.dropna(subset=["kickoff_utc", "home_team", "away_team"])
    group = X.status_group(F.col("status"))
    done = group == "finished"
    home, away = (F.col(c).try_cast("int") for c in ("home_score", "away_score"))
    have = lambda c, kind: F.col(c).cast(kind) if c in fixtures.columns else F.lit(None).cast(kind)
    return whole.select(
        X.match_key(F.to_date("kickoff_utc"), F.col("home_team"), F.col("away_team")).alias("match_key"), "kickoff_utc", "status", group.alias("status_group"), X.progress(group).alias("progress"),
        have("minute", "int").alias("minute"), "league", *(have(c, "string").alias(c) for c in ("country", "season")), "home_team", "away_team", home.alias("home_score"), away.alias("away_score"),
        F.when(done, X.outcome(home, away)).alias("outcome"), *(have(c, "string").alias(c) for c in ("venue", "source", "source_match_id")),
        now.alias("first_seen_at"), now.alias("updated_at"), F.when(done, now).alias("finished_at"),
    )


def unfinished(fixtures: DataFrame) -> DataFrame:
    """What is on: fixtures that haven't finished, by kickoff."""
    return fixtures.where(X.status_group(F.col("status")) != "finished").orderBy("kickoff_utc", "home_team")


def tallies(open_: DataFrame) -> DataFrame:
    """(league, n, live, last_kickoff) of unfinished fixtures."""
    live = F.count_if(X.status_group(F.col("status")) == "in_play")
    return open_.groupBy("league").agg(F.count("*").alias("n"), live.alias("live"), F.max("kickoff_utc").alias("last_kickoff"))


def rename(stored: DataFrame, mapping: DataFrame) -> DataFrame:
    """The store after its teams are renamed by mapping(team, name): keys are made again, and of rows that come to one key the
    most advanced stays; of equals the one that had the key before."""
    key = X.match_key(F.to_date("kickoff_utc"), F.col("home_team"), F.col("away_team"))
    changed = (F.col("home_team") != F.col("_home")) | (F.col("away_team") != F.col("_away"))
    old = stored.select("*", F.col("home_team").alias("_home"), F.col("away_team").alias("_away"))
    moved = N.renamed(old, mapping).withColumn("_key", F.when(changed, key).otherwise(F.col("match_key")))
    order = Window.partitionBy("_key").orderBy(F.col("progress").desc(), (F.col("match_key") != F.col("_key")), "match_key")
    best = moved.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select(*(F.col("_key").alias("match_key") if c == "match_key" else F.col(c) for c in stored.columns))


def next_upcoming(fixtures: DataFrame, now: Column, n: int = 5) -> DataFrame:
    return fixtures.where((F.col("status_group") == "scheduled") & (F.col("kickoff_utc") >= now)).orderBy("kickoff_utc", "match_key").limit(n)


def confident_list(rows: DataFrame, cap: int = 25) -> DataFrame:
    """rows(match_key, confidence) above the threshold, likeliest first, at most cap; each row also tells how many more there are."""
    sure = rows.where(F.col("confidence") > S.CONFIDENT)
    more = sure.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("more"))
    return sure.orderBy(F.col("confidence").desc(), "match_key").limit(cap).join(F.broadcast(more))  # one row


def slip_dates(slip: DataFrame, n: int = 30) -> DataFrame:
    return slip.select("date").distinct().orderBy(F.col("date").desc()).limit(n)


def next_day(fixtures: DataFrame, now: Column, zone: str = "Africa/Johannesburg") -> DataFrame:
    """The fixtures of the first local day after today on which one is scheduled."""
    day = X.local_day(F.col("kickoff_utc"), zone)
    later = fixtures.where((F.col("status_group") == "scheduled") & (day > X.local_day(now, zone)))
    first = later.agg(F.min(day).alias("_day"))
    return fixtures.withColumn("_d", day).join(F.broadcast(first), F.col("_d") == F.col("_day"), "left_semi").drop("_d")  # one row


def board(fixtures: DataFrame, now: Column, league: str | None = None, live: bool = False, confident: bool = False, slip: DataFrame | None = None, words: str = "") -> DataFrame:
    """The dashboard's list: all filters that are set hold. Words are looked for in teams, league and country."""
    rows = liveness(fixtures, now)
    if league:
        rows = rows.where(F.col("league") == league)
    if live:
        rows = rows.where("live")
    if confident:
        rows = rows.where(F.col("confidence") > S.CONFIDENT)
    if slip is not None:
        rows = rows.join(slip.select("match_key"), "match_key", "left_semi")
    if words.strip():
        text = F.concat_ws(" ", "home_team", "away_team", "league", *(["country"] if "country" in rows.columns else []))
        rows = rows.where(X.has_all_words(text, F.lit(words)))
    return rows


def groups(listed: DataFrame) -> DataFrame:
    """A board's headings: (heading, n), live matches first as one, the others by day."""
    heading = F.when(F.col("live"), "live").otherwise(F.date_format("kickoff_utc", "yyyy-MM-dd"))
    return listed.groupBy(heading.alias("heading")).agg(F.count("*").alias("n"))


def digest(rows: DataFrame, edge: DataFrame, day: str, cap: int = 25, zone: str = "Africa/Johannesburg") -> DataFrame:
    """One row, the day's text: counts, confident picks, matches to perm, leagues ahead of and behind the market. rows: the day's
    fixtures with home_win, draw, away_win; edge(league, edge)."""
    h, d, a = (F.col(c) for c in ("home_win", "draw", "away_win"))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    percent = lambda p: F.concat(F.bround(p * 100).cast("int").cast("string"), F.lit("%"))
    at = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("kickoff_utc")), "HH:mm")
    line = F.concat(at, F.lit(" "), esc(F.col("league")), F.lit(" · "), esc(F.col("home_team")), F.lit(" v "), esc(F.col("away_team")))
    pick, top = X.likeliest(h, d, a), F.greatest(h, d, a)
    code = F.element_at(F.array(*(F.lit(c) for c in PICKS)), pick)
    name = F.when(pick == 1, F.col("home_team")).when(pick == 2, "Draw").otherwise(F.col("away_team"))
    sure = F.concat(F.lit("• "), line, F.lit(" — <b>"), code, F.lit("</b> "), esc(name), F.lit(" "), percent(top))
    advice = X.perm_advice(h, d, a)
    both = F.when((pick == 1) | ((pick == 2) & (h >= a)), "1X").otherwise("X2")
    why = F.when(d >= S.PERM_DRAW, F.concat(F.lit("draw "), percent(d))).otherwise(F.concat(F.lit("open, best "), percent(top)))
    perm = F.concat(F.lit("• "), line, F.lit(" — <b>"), both, F.lit("</b> ("), why, F.lit(")"))
    # a day's fixtures are some hundreds at most
    listed = rows.agg(
        F.count("*").alias("n"), F.count(pick).alias("known"),
        F.array_sort(F.collect_list(F.when(top > S.CONFIDENT, F.struct((-top).alias("p"), F.col("kickoff_utc").alias("k"), sure.alias("t"))))).alias("sure"),
        F.array_sort(F.collect_list(F.when(advice["perm"], F.struct(F.col("kickoff_utc").alias("k"), perm.alias("t"))))).alias("perms"),
    )
    sides = edge.agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("edge") == e, F.col("league")))), ", ").alias(e) for e in ("ahead", "behind")))
    one = listed.join(F.broadcast(sides))  # one row each
    title = F.concat(F.lit("<b>"), F.date_format(F.lit(day).cast("date"), "EEE dd MMM"), F.lit("</b>"))
    lines = lambda c: F.transform(F.slice(c, 1, cap), lambda x: x["t"])
    some = lambda cond, *texts: F.when(cond, F.array(*texts)).otherwise(F.array().cast("array<string>"))
    text = F.concat(
        F.array(title, F.concat(F.col("n").cast("string"), F.lit(" matches, "), F.col("known").cast("string"), F.lit(" with probabilities"))),
        F.when(F.size("sure") > 0, F.concat(F.array(F.lit(""), F.lit(f"<b>Confident (&gt;{round(S.CONFIDENT * 100)}%)</b>")), lines("sure"), some(F.size("sure") > cap, F.concat(F.lit("and "), (F.size("sure") - cap).cast("string"), F.lit(" more")))))
        .otherwise(F.array(F.lit(""), F.when(F.col("known") > 0, "No confident pick.").otherwise("Nothing predicted so far."))),
        F.when(F.size("perms") > 0, F.concat(F.array(F.lit(""), F.lit("<b>Cover two outcomes</b>")), lines("perms"))).otherwise(F.array().cast("array<string>")),
        some((F.col("ahead") != "") | (F.col("behind") != ""), F.lit("")), some(F.col("ahead") != "", F.concat(F.lit("Better than the market: "), esc(F.col("ahead")))), some(F.col("behind") != "", F.concat(F.lit("Worse than the market: "), esc(F.col("behind")))),
        some(F.col("n") > F.col("known"), F.lit(""), F.concat(F.lit("<i>"), (F.col("n") - F.col("known")).cast("string"), F.lit(" without probabilities</i>"))),
    )
    return one.select(F.when(F.col("n") == 0, F.concat(title, F.lit("\nNo matches."))).otherwise(F.array_join(text, "\n")).alias("text"))


def once_a_day(wanted: DataFrame, sent: DataFrame) -> DataFrame:
    """wanted(day, ...) whose day sent(day) doesn't have yet."""
    return wanted.join(sent.select("day").distinct(), "day", "left_anti")
