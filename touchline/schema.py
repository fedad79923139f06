"""Canonical columns and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

STATS = [f"{side}_{s}" for s in ("shots", "shots_on_target", "corners", "fouls", "yellow", "red") for side in ("home", "away")]

MATCH = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in ("season", "league", "country", "home_team", "away_team")]
    + [T.StructField(c, T.IntegerType()) for c in ("home_score", "away_score", "outcome")]
    + [T.StructField(c, T.DoubleType()) for c in ("odds_home", "odds_draw", "odds_away")]
    + [T.StructField(c, T.IntegerType()) for c in [*STATS, "home_half_score", "away_half_score"]]
    + [T.StructField("source", T.StringType())]
)

FIXTURE = T.StructType(
    [T.StructField("kickoff_utc", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("minute", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("league", "country", "season", "home_team", "away_team")]
    + [T.StructField(c, T.IntegerType()) for c in ("home_score", "away_score")]
    + [T.StructField(c, T.StringType()) for c in ("venue", "source", "source_match_id")]
    + [T.StructField("fetched_at", T.TimestampType())]
)

# Status vocabularies and the order of their groups.
FINISHED = ("FT", "AET", "PEN", "FINISHED", "AWARDED", "MATCH FINISHED")
IN_PLAY = ("1H", "HT", "2H", "ET", "BT", "P", "SUSP", "INT", "LIVE", "IN_PLAY", "PAUSED")
OFF = ("PST", "POSTPONED", "CANC", "CANCELLED", "ABD", "SUSPENDED", "WO", "AWD")
PROGRESS = {"scheduled": 0, "off": 1, "in_play": 2, "finished": 3}

# Trust in sources, least first wins.
SOURCE_PRIORITY = {
    "football-data.co.uk": 0, "betexplorer": 1, "API-Football": 2, "football-data.org": 3, "openfootball": 4, "globalsportsarchive": 5, "TheSportsDB": 6, "FootyStats": 7,
}
FIXTURE_PRIORITY = {"API-Football": 0, "football-data.org": 1, "TheSportsDB": 2}
UNKNOWN_PRIORITY = 9

# Thresholds.
THIN_SEASON, COVERED, CONFIDENT, PERM_DRAW, PERM_TOP, EDGE_SAMPLE, STALE_HOURS = 100, 0.5, 0.5, 0.30, 0.40, 10, 6
BUCKETS = (0.0, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 1.01)
ELO = {"start": 1000.0, "k": 20.0, "home": 60.0, "scale": 400.0}
PI = {"rate": 0.035, "carry": 0.7, "c": 3.0}
