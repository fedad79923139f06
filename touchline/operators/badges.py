"""Club badges: candidates scored by name, league and country, the store, and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import names as N

#: Policy of the badge store: a badge is never lost to an empty answer.
POLICY = {"badge_url": "new_old", "matched_name": "overwrite", "confidence": "overwrite", "league": "overwrite"}
#: Policies of the insight store, whose rows count their refreshes, and of the market cache.
INSIGHT_POLICY = {"payload": "overwrite", "updated_at": "overwrite", "refresh_count": "increment", "created_at": "insert_only"}
MARKET_POLICY = {"payload": "overwrite", "fetched_at": "overwrite", "remaining": "overwrite"}
WEAK = 2.0


def best_badge(clubs: DataFrame, candidates: DataFrame) -> DataFrame:
    """clubs(team, league, country) and candidates(team, sport, name, its_league, its_country, badge_url) as (team, badge_url,
    matched_name, confidence): 3 for an equal key or 1.5 for one that holds the club's, 2 for the league, 1 for the country, 0.5
    for having a badge. Only football clubs count; of equal scores the least name; one without a badge has confidence 0."""
    own = clubs.select("team", N.key(F.col("team")).alias("_k"), N.key(F.col("league")).alias("_l"), N.key(F.col("country")).alias("_c"))
    met = candidates.where(F.lower("sport") == "soccer").join(own, "team")
    k = N.key(F.col("name"))
    has = F.coalesce(F.col("badge_url") != "", F.lit(False))
    close = F.when(k == F.col("_k"), 3.0).when((F.col("_k") != "") & F.contains(k, F.col("_k")), 1.5).otherwise(0.0)
    same = lambda c, own, points: F.when((F.trim(c) != "") & (N.key(F.col(c)) == F.col(own)), points).otherwise(0.0)
    scored = met.withColumn("_s", close + same("its_league", "_l", 2.0) + same("its_country", "_c", 1.0) + F.when(has, 0.5).otherwise(0.0))
    best = scored.groupBy("team").agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col("name").alias("n"), F.col("badge_url").alias("u"))).alias("_b"))
    found = F.coalesce(F.col("_b.u") != "", F.lit(False))
    return best.select("team", F.when(found, F.col("_b.u")).alias("badge_url"), F.col("_b.n").alias("matched_name"), F.when(found, F.round(-F.col("_b.s"), 2)).otherwise(0.0).alias("confidence"))


def without_badge(clubs: DataFrame, stored: DataFrame) -> DataFrame:
    return clubs.join(stored.where("badge_url is not null").select("team"), "team", "left_anti")


def weakest(stored: DataFrame, n: int = 20) -> DataFrame:
    """Matches worth a look: least confidence first."""
    return stored.where(F.coalesce("confidence", F.lit(0.0)) < WEAK).orderBy("confidence", "team").limit(n)


def tally(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count("*").alias("total"), F.count("badge_url").alias("with_badge"))


def crests(fixtures: DataFrame, stored: DataFrame) -> DataFrame:
    """fixtures with home_badge and away_badge; a row a club, so Spark picks the join by its size."""
    out = fixtures
    for side in ("home", "away"):
        out = out.join(stored.select(F.col("team").alias(f"{side}_team"), F.col("badge_url").alias(f"{side}_badge")), f"{side}_team", "left")
    return out
