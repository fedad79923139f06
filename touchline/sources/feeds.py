"""Provider payloads in nested JSON, as fixture rows. Payload columns are strings with one response each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions import scalar as X
from touchline.sources.files import conform

API_FOOTBALL = "response array<struct<fixture:struct<id:bigint,date:string,status:struct<short:string,elapsed:int>,venue:struct<name:string>>,league:struct<id:int,name:string,country:string,season:int>,teams:struct<home:struct<name:string>,away:struct<name:string>>,goals:struct<home:int,away:int>>>"
FOOTBALL_DATA = "matches array<struct<id:bigint,utcDate:string,status:string,minute:string,competition:struct<code:string,name:string>,area:struct<name:string>,homeTeam:struct<name:string>,awayTeam:struct<name:string>,score:struct<fullTime:struct<home:int,away:int>>>>"
SPORTS_DB = "events array<struct<idEvent:string,strTimestamp:string,strStatus:string,strProgress:string,strHomeTeam:string,strAwayTeam:string,intHomeScore:string,intAwayScore:string,strVenue:string,strLeague:string,strCountry:string>>"


def _instant(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def _fixtures(rows: DataFrame, source: str) -> DataFrame:
    full = rows.withColumns({"season": X.season_label(F.to_date("kickoff_utc")), "source": F.lit(source), "fetched_at": F.current_timestamp()})
    return conform(full.where("home_team is not null and away_team is not null"), S.FIXTURE)


def api_football(payloads: DataFrame, column: str = "payload") -> DataFrame:
    e = payloads.select(F.explode(F.from_json(column, API_FOOTBALL)["response"]).alias("e"))
    return _fixtures(e.select(_instant(F.col("e.fixture.date")).alias("kickoff_utc"), F.col("e.fixture.status.short").alias("status"), F.col("e.fixture.status.elapsed").alias("minute"), F.col("e.league.name").alias("league"), F.col("e.league.country").alias("country"), F.col("e.teams.home.name").alias("home_team"), F.col("e.teams.away.name").alias("away_team"), F.col("e.goals.home").alias("home_score"), F.col("e.goals.away").alias("away_score"), F.col("e.fixture.venue.name").alias("venue"), F.col("e.fixture.id").cast("string").alias("source_match_id")), "API-Football")


def repaired_status(status: Column, kickoff: Column, scored: Column, now: Column) -> Column:
    """A word that no vocabulary has: finished with a score, scheduled if it is to come, else unknown."""
    known = F.upper(F.trim(status)).isin(*S.FINISHED, *S.IN_PLAY, *S.OFF, "SCHEDULED", "TIMED", "NS")
    return F.when(known, F.upper(F.trim(status))).when(scored, "FINISHED").when(kickoff > now, "SCHEDULED").otherwise("UNKNOWN")


def football_data(payloads: DataFrame, column: str = "payload", now: Column | None = None) -> DataFrame:
    e = payloads.select(F.explode(F.from_json(column, FOOTBALL_DATA)["matches"]).alias("e")).withColumn("kickoff_utc", _instant(F.col("e.utcDate")))
    h, a = F.col("e.score.fullTime.home"), F.col("e.score.fullTime.away")
    status = repaired_status(F.col("e.status"), F.col("kickoff_utc"), h.isNotNull() & a.isNotNull(), now if now is not None else F.current_timestamp())
    return _fixtures(e.select("kickoff_utc", status.alias("status"), X.minute(F.col("e.minute")).alias("minute"), F.col("e.competition.name").alias("league"), F.col("e.area.name").alias("country"), F.col("e.homeTeam.name").alias("home_team"), F.col("e.awayTeam.name").alias("away_team"), h.alias("home_score"), a.alias("away_score"), F.col("e.id").cast("string").alias("source_match_id")), "football-data.org")


def sports_db(payloads: DataFrame, column: str = "payload") -> DataFrame:
    e = payloads.select(F.explode(F.from_json(column, SPORTS_DB)["events"]).alias("e"))
    h, a = F.col("e.intHomeScore").try_cast("int"), F.col("e.intAwayScore").try_cast("int")
    blank = F.coalesce(F.trim("e.strStatus"), F.lit("")) == ""
    status = F.when(~blank, F.col("e.strStatus")).when(h.isNotNull() & a.isNotNull(), "FT").otherwise("NS")
    return _fixtures(e.select(_instant(F.col("e.strTimestamp")).alias("kickoff_utc"), status.alias("status"), X.minute(F.col("e.strProgress")).alias("minute"), F.col("e.strLeague").alias("league"), F.col("e.strCountry").alias("country"), F.col("e.strHomeTeam").alias("home_team"), F.col("e.strAwayTeam").alias("away_team"), h.alias("home_score"), a.alias("away_score"), F.col("e.strVenue").alias("venue"), F.col("e.idEvent").alias("source_match_id")), "TheSportsDB")


def openfootball(payloads: DataFrame, league: str, country: str, column: str = "payload") -> DataFrame:
    """Matches at the top or in rounds; teams as names or objects; scores as pairs, objects or separate fields."""
    doc = payloads.select(F.try_parse_json(column).alias("v"))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    rounds = F.flatten(F.transform(get(F.col("v"), "$.rounds", "array<variant>"), lambda r: F.coalesce(get(r, "$.matches", "array<variant>"), F.array().cast("array<variant>"))))
    e = doc.select(F.explode(F.coalesce(get(F.col("v"), "$.matches", "array<variant>"), rounds)).alias("m"))
    team = lambda n: F.when(get(F.col("m"), f"$.{n}.name", "string").isNotNull(), get(F.col("m"), f"$.{n}.name", "string")).otherwise(get(F.col("m"), f"$.{n}", "string"))
    goals = lambda i: F.coalesce(get(F.col("m"), f"$.score.ft[{i}]", "int"), get(F.col("m"), f"$.score.ft['{i + 1}']", "int"), get(F.col("m"), f"$.score{i + 1}", "int"), get(F.col("m"), f"$.score[{i}]", "int"))
    day = F.to_date(F.try_to_timestamp(get(F.col("m"), "$.date", "string"), F.lit("yyyy-MM-dd")))
    rows = e.select(day.alias("date"), X.season_label(day).alias("season"), F.lit(league).alias("league"), F.lit(country).alias("country"), team("team1").alias("home_team"), team("team2").alias("away_team"), goals(0).alias("home_score"), goals(1).alias("away_score"), F.lit("openfootball").alias("source"))
    rows = rows.withColumn("outcome", X.outcome(F.col("home_score"), F.col("away_score")))
    return conform(rows.where("outcome is not null and date is not null"))


def to_matches(fixtures: DataFrame, since: str | None = None) -> DataFrame:
    """Finished fixtures as match rows; since: the first day of kickoffs, a filter that reaches the scan."""
    done = fixtures.where(X.status_group(F.col("status")) == "finished")
    if since is not None:
        done = done.where(F.col("kickoff_utc") >= F.lit(since).cast("timestamp"))
    rows = done.withColumns({"date": F.to_date("kickoff_utc"), "outcome": X.outcome(F.col("home_score"), F.col("away_score"))})
    return conform(rows.where("outcome is not null"))


def date_windows(start: Column, end: Column, days: int = 10) -> Column:
    """A range of days as windows of at most so many, to be exploded."""
    return F.transform(F.sequence(start, end, F.make_dt_interval(F.lit(days))), lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last")))
