"""Keyed state: merging snapshots, expiry, retention, and ordered slips. Parquet tables take no MERGE, so each operator makes
the next snapshot from the current one, to be written beside it and swapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions import scalar as X

#: What becomes of a column when a key is in both: overwrite, new_old (new unless null), old_new (old unless null), insert_only
#: (old), increment (old + 1).
FIXTURE_POLICY = {
    "status": "overwrite", "status_group": "overwrite", "progress": "overwrite", "minute": "overwrite", "kickoff_utc": "overwrite", "league": "overwrite", "source": "overwrite", "updated_at": "overwrite",
    "country": "new_old", "season": "new_old", "home_score": "new_old", "away_score": "new_old", "outcome": "new_old", "venue": "new_old", "source_match_id": "new_old",
    "home_team": "insert_only", "away_team": "insert_only", "first_seen_at": "insert_only", "finished_at": "old_new",
}


def merge(current: DataFrame, incoming: DataFrame, key: str, policy: dict[str, str], guard: Column | None = None) -> DataFrame:
    """Both sides have one row a key. guard, over new.* and old.*: whether an existing row is updated at all.

    One shuffle of each side by the key; snapshots bucketed by it need none.
    """
    both = current.alias("old").join(incoming.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    old, new = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    update = new & (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))

    def column(c: str) -> Column:
        o, n = F.col(f"old.{c}"), F.col(f"new.{c}")
        how = policy.get(c, "overwrite")
        joined = {"overwrite": n, "new_old": F.coalesce(n, o), "old_new": F.coalesce(o, n), "insert_only": o, "increment": o + 1}[how]
        return F.when(~old, n).when(update, joined).otherwise(o).alias(c)

    return both.select(F.coalesce(F.col(f"new.{key}"), F.col(f"old.{key}")).alias(key), *(column(c) for c in current.columns if c != key))


def upsert_fixtures(current: DataFrame, incoming: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """State never moves backward: a row is updated only if its progress doesn't fall. A batch that repeats a key is folded to
    its most advanced row, the latest of equals."""
    last = incoming.withColumn("_n", F.row_number().over(Window.partitionBy("match_key").orderBy(F.col("progress").desc(), F.col("updated_at").desc()))).where("_n = 1").drop("_n")
    return merge(current, last, "match_key", policy or FIXTURE_POLICY, F.col("new.progress") >= F.col("old.progress"))


def reap(fixtures: DataFrame, now: Column, hours: int = S.STALE_HOURS) -> DataFrame:
    """Fixtures that should long have ended and never did become unresolved."""
    stranded = F.col("status_group").isin("scheduled", "in_play") & (F.col("kickoff_utc") < now - F.expr(f"interval {hours} hours"))
    change = {"status": F.lit("UNRESOLVED"), "status_group": F.lit("off"), "progress": F.lit(S.PROGRESS["off"]), "minute": F.lit(None).cast("int")}
    return fixtures.withColumns({c: F.when(stranded, v).otherwise(F.col(c)) for c, v in change.items() if c in fixtures.columns})


def prunable(fixtures: DataFrame, training_keys: DataFrame, now: Column, days: int = 180, keep_country: str = "South Africa") -> DataFrame:
    """Keys that retention may delete: old, of another country, and unfinished or already in the training set."""
    if days < 30:
        raise ValueError("retention keeps at least 30 days")
    old = fixtures.where((F.col("kickoff_utc") < now - F.expr(f"interval {days} days")) & (F.coalesce("country", F.lit("")) != keep_country))
    known = training_keys.select("match_key").distinct().withColumn("_known", F.lit(True))
    return old.join(known, "match_key", "left").where((F.col("status_group") != "finished") | F.col("_known")).drop("_known")


def delete(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    return rows.join(doomed.select("match_key"), "match_key", "left_anti")


def diff(previous: DataFrame, incoming: DataFrame, key: str = "match_key", values: tuple[str, ...] = ("home_score", "away_score")) -> DataFrame:
    """incoming against previous: kind is added, unchanged or conflict. A missing value equals nothing, itself included."""
    old = previous.select(F.col(key).alias("_k"), *(F.col(v).alias(f"{v}_old") for v in values))
    both = incoming.join(old, F.col(key) == F.col("_k"), "left")
    same = F.lit(True)
    for v in values:
        same = same & F.coalesce(F.col(v) == F.col(f"{v}_old"), F.lit(False))
    return both.withColumn("kind", F.when(F.col("_k").isNull(), "added").when(same, "unchanged").otherwise("conflict")).drop("_k")


def diff_counts(diffed: DataFrame) -> DataFrame:
    return diffed.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "unchanged", "conflict")))


def add_to_slip(slip: DataFrame, picks: DataFrame) -> DataFrame:
    """Picks that a day's slip doesn't have yet go to its end, in the order of kickoff and key."""
    fresh = picks.join(slip, ["date", "match_key"], "left_anti")
    ends = slip.groupBy("date").agg(F.max("position").alias("_end"))
    order = F.row_number().over(Window.partitionBy("date").orderBy("kickoff_utc", "match_key"))
    placed = fresh.join(ends, "date", "left").withColumn("position", F.coalesce("_end", F.lit(0)) + order).drop("_end")
    return slip.unionByName(placed.select(slip.columns))


def resequence(slip: DataFrame) -> DataFrame:
    """Positions 1 to n of each day, in their order."""
    return slip.withColumn("position", F.row_number().over(Window.partitionBy("date").orderBy("position", "match_key")))


def move_in_slip(slip: DataFrame, date: str, match_key: str, up: bool) -> DataFrame:
    """Swaps a pick with its neighbour; nothing happens at the end of a slip."""
    order = Window.partitionBy("date").orderBy("position")
    target = (F.col("date") == F.lit(date).cast(slip.schema["date"].dataType)) & (F.col("match_key") == match_key)
    seen = slip.select("*", F.lag("match_key").over(order).alias("_before"), F.lead("match_key").over(order).alias("_after"), F.lag("position").over(order).alias("_pb"), F.lead("position").over(order).alias("_pa"))
    mine, neighbour = (F.col("_pb"), F.col("_after")) if up else (F.col("_pa"), F.col("_before"))
    other = F.col("_pa") if up else F.col("_pb")
    is_neighbour = (F.col("date") == F.lit(date).cast(slip.schema["date"].dataType)) & (neighbour == match_key)
    return seen.withColumn("position", F.when(target & mine.isNotNull(), mine).when(is_neighbour, other).otherwise(F.col("position"))).select(slip.columns)


def grade_slip(slip: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Each pick with its result; hit is null until the match is finished."""
    done = fixtures.where("status_group = 'finished'").select("match_key", "outcome")
    return slip.join(done, "match_key", "left").withColumn("hit", F.col("pick") == F.col("outcome"))


def slip_summary(graded: DataFrame) -> DataFrame:
    return graded.groupBy("date").agg(F.count("*").alias("picks"), F.count("hit").alias("settled"), F.count_if("hit").alias("correct"))


def freshness(fixtures: DataFrame, now: Column) -> DataFrame:
    """State at a glance: rows of each status group (zero where there are none), last update, next kickoff, stranded rows."""
    counts = [F.count_if(F.col("status_group") == g).alias(g) for g in S.PROGRESS]
    stranded = F.col("status_group").isin("scheduled", "in_play") & (F.col("kickoff_utc") < now - F.expr(f"interval {S.STALE_HOURS} hours"))
    upcoming = F.min(F.when((F.col("status_group") == "scheduled") & (F.col("kickoff_utc") >= now), F.col("kickoff_utc")))
    return fixtures.agg(*counts, F.count("*").alias("total"), F.max("updated_at").alias("last_update"), upcoming.alias("next_kickoff"), F.count_if(stranded).alias("stranded"), F.count_distinct("league").alias("leagues"))


def upcoming(fixtures: DataFrame, now: Column, limit: int = 300) -> DataFrame:
    """Live ones first, then by kickoff."""
    open_ = F.col("status_group").isin("scheduled", "in_play", "off") & (F.col("kickoff_utc") >= now - F.expr(f"interval {S.STALE_HOURS} hours"))
    return fixtures.where(open_).orderBy(F.when(F.col("status_group") == "in_play", 0).otherwise(1), "kickoff_utc", "match_key").limit(limit)


def most_confident(fixtures: DataFrame, predictions: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """Top calls of those to come; matches that lack a probability aren't ranked."""
    rows = fixtures.where((F.col("status_group") == "scheduled") & (F.col("kickoff_utc") >= now)).join(predictions, "seq")
    top = X.top_probability(F.col("home_win"), F.col("draw"), F.col("away_win"))
    return rows.withColumn("confidence", top).where("confidence is not null").orderBy(F.col("confidence").desc(), "kickoff_utc", "match_key").limit(n)
