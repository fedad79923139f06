"""Track record, calibration, market comparison and evaluation. Scored rows are matches with their predictions:
outcome, league, date, home_win, draw, away_win, market_home, market_draw, market_away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions import scalar as X

MODEL = ("home_win", "draw", "away_win")
MARKET = ("market_home", "market_draw", "market_away")


def scored(matches: DataFrame, predictions: DataFrame) -> DataFrame:
    """Finished matches with their calls; a match without a prediction stays, unscored."""
    rows = matches.where("status_group = 'finished'").join(predictions, "seq", "left")
    model, market = [F.col(c) for c in MODEL], [F.col(c) for c in MARKET]
    pick, favourite = X.likeliest(*model), X.likeliest(*market)
    return rows.select(
        "*", pick.alias("pick"), favourite.alias("favourite"), (pick == F.col("outcome")).alias("hit"), (favourite == F.col("outcome")).alias("market_hit"),
        X.of_outcome(F.col("outcome"), *model).alias("p_actual"), X.of_outcome(F.col("outcome"), *market).alias("q_actual"), X.top_probability(*model).alias("confidence"),
    )


def _summary() -> list[Column]:
    both = F.col("hit").isNotNull() & F.col("market_hit").isNotNull()
    return [
        F.count("hit").alias("evaluated"), F.count_if(F.col("hit").isNull()).alias("unscored"), F.count_if("hit").alias("correct"), F.round(F.try_divide(F.count_if("hit"), F.count("hit")), 6).alias("accuracy"),
        F.round(F.avg("p_actual"), 6).alias("mean_p_actual"), F.count_if(both).alias("with_market"), F.round(F.try_divide(F.count_if(both & F.col("hit")), F.count_if(both)), 6).alias("model_accuracy"),
        F.round(F.try_divide(F.count_if(both & F.col("market_hit")), F.count_if(both)), 6).alias("market_accuracy"),
        F.round(F.avg(F.when(both, X.log_loss(F.col("p_actual")))), 6).alias("model_log_loss"), F.round(F.avg(F.when(both, X.log_loss(F.col("q_actual")))), 6).alias("market_log_loss"),
    ]


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*_summary())


def by_league(rows: DataFrame) -> DataFrame:
    return rows.groupBy("league").agg(*_summary()).where("evaluated > 0").orderBy(F.col("evaluated").desc(), "league")


def calibration(rows: DataFrame) -> DataFrame:
    """Left-closed buckets of the pick's probability; empty ones don't appear."""
    p, low = F.col("confidence"), F.lit(None).cast("double")
    for edge, upper in zip(S.BUCKETS[:-1], S.BUCKETS[1:]):
        low = F.when((p >= edge) & (p < upper), F.lit(edge)).otherwise(low)
    return rows.where("hit is not null").groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def league_edge(rows: DataFrame, least: int = S.EDGE_SAMPLE) -> DataFrame:
    """Model against market favourite in each league with enough matches; a tie is neither ahead nor behind."""
    both = rows.where("hit is not null and market_hit is not null").groupBy("league").agg(F.count("*").alias("n"), F.count_if("hit").alias("model_hits"), F.count_if("market_hit").alias("market_hits"))
    edge = F.when(F.col("model_hits") > F.col("market_hits"), "ahead").when(F.col("model_hits") < F.col("market_hits"), "behind").otherwise("level")
    return both.where(F.col("n") >= least).withColumn("edge", edge)


def recent_record(rows: DataFrame, days: int = 7) -> DataFrame:
    """Hits of all calls, of confident ones and of the last days, and by four bands of confidence; rows named by group."""
    last = rows.agg(F.max("date").alias("_last"))
    call = rows.where("hit is not null").crossJoin(F.broadcast(last))  # one row
    p = F.col("confidence")
    band = F.when(p < 0.4, "below 40").when(p < 0.5, "40 to 50").when(p < 0.6, "50 to 60").otherwise("60 and more")
    groups = F.array(F.lit("all"), F.when(p > S.CONFIDENT, F.lit("confident")), F.when(F.col("date") > F.date_sub("_last", days), F.lit("recent")), band)
    return call.select(F.explode(groups).alias("group"), "hit").where("group is not null").groupBy("group").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


def evaluation(rows: DataFrame) -> DataFrame:
    """Accuracy, log-loss over three classes and mean one-against-rest Brier score."""
    share = [F.pow(F.col(c) - (F.col("outcome") == i).cast("int"), 2) for i, c in enumerate(MODEL, 1)]
    return rows.where("hit is not null").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("accuracy"),
        F.round(F.avg(-F.log(F.greatest("p_actual", F.lit(1e-15)))), 6).alias("log_loss"), F.round(F.avg((share[0] + share[1] + share[2]) / 3), 6).alias("brier"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Actual outcomes against calls."""
    cells = [F.count_if(F.col("pick") == k).alias(name) for k, name in ((1, "called_home"), (2, "called_draw"), (3, "called_away"))]
    return rows.where("hit is not null").groupBy("outcome").agg(*cells)


def confidence_bins(rows: DataFrame) -> DataFrame:
    """Right-closed bins of the top and of the draw probability, as training reports them."""

    def bins(value: str, edges: tuple[float, ...]) -> Column:
        out = F.lit(None).cast("double")
        for e in reversed(edges):
            out = F.when(F.col(value) <= e, F.lit(e)).otherwise(out)
        return out

    one = rows.where("hit is not null").groupBy(F.lit("top").alias("kind"), bins("confidence", (0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 1.0)).alias("upto")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))
    two = rows.where("hit is not null").groupBy(F.lit("draw").alias("kind"), bins("draw", (0.2, 0.25, 0.3, 0.35, 1.0)).alias("upto")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("outcome") == 2).cast("int")), 6).alias("rate"))
    return one.unionByName(two)


def model_report(rows: DataFrame) -> DataFrame:
    """scored() rows with a call, by league and, under a null league, all together, in one pass: accuracy, log-loss and mean Brier score of
    the model, accuracy of the bookmakers where they have a say, and of the two baselines: always the commonest outcome of all rows, and
    always its shares of outcomes. Of equally common outcomes the first counts."""
    known = rows.where("hit is not null")
    shares = known.agg(*(F.avg((F.col("outcome") == k).cast("int")).alias(f"_s{k}") for k in (1, 2, 3)))
    three = (("home_win", 1), ("draw", 2), ("away_win", 3))
    brier = sum(((F.col(c) - (F.col("outcome") == k).cast("int")) ** 2 for c, k in three), F.lit(0.0)) / 3
    prior = F.element_at(F.array("_s1", "_s2", "_s3"), F.col("outcome"))
    commonest = X.likeliest(F.col("_s1"), F.col("_s2"), F.col("_s3"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    both = known.join(F.broadcast(shares))  # one row
    return both.groupingSets([["league"], []], "league").agg(
        F.count("*").alias("n"), mean(F.col("hit").cast("int"), "accuracy"), mean(-F.log(F.greatest("p_actual", F.lit(1e-15))), "log_loss"), mean(brier, "brier"),
        F.count("market_hit").alias("with_market"), mean(F.col("market_hit").cast("int"), "market_accuracy"), mean((F.col("outcome") == commonest).cast("int"), "prior_accuracy"), mean(-F.log(prior), "prior_log_loss"),
    )
