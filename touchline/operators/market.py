"""Odds, stakes and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalar as X


def devig_blend(rows: DataFrame, weight: float = 0.45) -> DataFrame:
    """Market probabilities of the odds, and the model's mixed with them."""
    market = X.devig(F.col("odds_home"), F.col("odds_draw"), F.col("odds_away"))
    two = rows.select("*", market.alias("_m"))
    mixed = X.blend([F.col(c) for c in ("home_win", "draw", "away_win")], [F.col(f"_m.{c}") for c in ("home", "draw", "away")], weight)
    return two.select("seq", *(F.round(F.col(f"_m.{c}"), 6).alias(f"market_{c}") for c in ("home", "draw", "away")), *(F.round(x, 6).alias(f"blend_{c}") for x, c in zip(mixed, ("home", "draw", "away"))))


def perm_advice(predictions: DataFrame) -> DataFrame:
    two = predictions.select("seq", X.perm_advice(F.col("home_win"), F.col("draw"), F.col("away_win")).alias("_a"))
    return two.select("seq", "_a.pick", "_a.perm", "_a.other", F.round("_a.covered", 6).alias("covered"))


def bet_tiers(predictions: DataFrame) -> DataFrame:
    """Three tiers: the best double chance, the favourite, and the best value against the market, or else the second
    favourite. Of equals the first of home, draw, away (1X, 12, X2) wins."""
    h, d, a = F.col("home_win"), F.col("draw"), F.col("away_win")

    def best(options: list[tuple[str, object]]):
        """Largest, first on ties."""
        order = F.array(*(F.struct(p.alias("p"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, (code, p) in enumerate(options)))
        return F.array_max(F.filter(order, lambda x: x["p"].isNotNull()))

    double = best([("1X", h + d), ("12", h + a), ("X2", d + a)])
    single = [("1", h), ("X", d), ("2", a)]
    favourite = best(single)
    edges = [("1", h - F.col("market_home")), ("X", d - F.col("market_draw")), ("2", a - F.col("market_away"))]
    rows = predictions.where("home_win is not null and draw is not null and away_win is not null").select("seq", "home_win", "draw", "away_win", "market_home", "market_draw", "market_away", double.alias("_d"), favourite.alias("_f"))
    value = best([(c, F.when(F.col("_f.code") != c, e)) for c, e in edges])
    second = best([(c, F.when(F.col("_f.code") != c, p)) for c, p in single])
    rows = rows.select("*", value.alias("_v"), second.alias("_s"))
    third = F.when(F.col("_v.p") > 0, F.col("_v.code")).otherwise(F.col("_s.code"))
    p = F.col("_f.p")
    return rows.select("seq", F.col("_d.code").alias("safe"), F.round("_d.p", 6).alias("safe_p"), F.col("_f.code").alias("favourite"), F.round(1 / p, 6).alias("implied_odds"), third.alias("value"), F.round(F.when(F.col("_v.p") > 0, F.col("_v.p")), 6).alias("edge"))


def slip_maths(advised: DataFrame, unit: float = 1.0) -> DataFrame:
    """advised(date, perm, covered, and hit where it is known): lines are the product of selections, the chance that of the covered
    probabilities. A pick that is settled takes no part any more."""
    open_ = advised.where("hit is null") if "hit" in advised.columns else advised
    rows = open_.groupBy("date").agg(F.count("*").alias("picks"), F.count_if("perm").alias("permed"), F.sum(F.ln("covered")).alias("_log"))
    return rows.select("date", "picks", "permed", F.pow(F.lit(2.0), "permed").alias("lines"), F.round(F.exp("_log"), 6).alias("chance"), (F.pow(F.lit(2.0), "permed") * unit).alias("cost"))


def consensus(events: DataFrame) -> DataFrame:
    """events(home_team, away_team, commence_time, bookmakers): odds without the bookmaker's margin, averaged over those
    that price all three outcomes."""
    books = events.select("home_team", "away_team", "commence_time", F.explode("bookmakers").alias("_b"))
    h2h = books.select("home_team", "away_team", "commence_time", F.explode(F.filter("_b.markets", lambda m: m["key"] == "h2h")).alias("_m"))
    price = lambda name: F.get(F.filter("_m.outcomes", lambda o: o["name"] == name), F.lit(0))["price"]
    fair = h2h.select("home_team", "away_team", "commence_time", X.devig(price(F.col("home_team")), price(F.lit("Draw")), price(F.col("away_team"))).alias("_p"))
    good = fair.where("_p is not null and _p.home > 0 and _p.draw > 0 and _p.away > 0")
    return good.groupBy("home_team", "away_team", "commence_time").agg(*(F.avg(f"_p.{c}").alias(c) for c in ("home", "draw", "away")), F.count("*").alias("books"))
