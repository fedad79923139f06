"""Features as of each match, by windows. Frames end one row before the match, so nothing leaks from its own result.

Matches come as (seq, date, season, league, home, away, home_score, away_score, ...); seq settles the order within a day.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline.functions import scalar as X

MEASURES = ("win", "draw", "gf", "ga", "pts", "shots_for", "shots_against")
#: With shots on target and corners, which are null where matches don't carry them.
ALL_MEASURES = (*MEASURES, "sot_for", "sot_against", "corners_for", "corners_against")
VENUE_MEASURES = ("pts", "gf", "ga")


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows a match, one for each side."""
    stat = lambda c: F.col(c) if c in matches.columns else F.lit(None).cast("int")

    def side(us: str, them: str) -> Column:
        return F.struct(
            F.lit(us == "home").alias("is_home"), F.col(us).alias("team"), F.col(them).alias("opponent"), F.col(f"{us}_score").alias("gf"), F.col(f"{them}_score").alias("ga"),
            F.col(f"{us}_shots").alias("shots_for"), F.col(f"{them}_shots").alias("shots_against"),
            stat(f"{us}_shots_on_target").alias("sot_for"), stat(f"{them}_shots_on_target").alias("sot_against"), stat(f"{us}_corners").alias("corners_for"), stat(f"{them}_corners").alias("corners_against"),
        )

    both = matches.select("seq", "date", "season", "league", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("_s")).select("seq", "date", "season", "league", "_s.*")
    win, draw = (F.col("gf") > F.col("ga")).cast("int"), (F.col("gf") == F.col("ga")).cast("int")
    return both.select("*", win.alias("win"), draw.alias("draw"), (3 * win + draw).alias("pts"))


WHOLE = ("tinyint", "smallint", "int", "bigint")


def _with_means(rows: DataFrame, order: WindowSpec, sizes: tuple[int, ...], measures: tuple[str, ...], name: str) -> DataFrame:
    """rows and the means of the rows before each one, named by measure and size. Means of whole numbers are differences of running sums
    over running counts: equal to those over a frame, but a row costs the same whatever the size."""
    whole = [m for m in measures if dict(rows.dtypes)[m] in WHOLE]
    frame = lambda k: order.rowsBetween(Window.unboundedPreceding, -k)
    running = {f"_{f.__name__}_{m}_{k}": f(m).over(frame(k)) for k in (1, *(n + 1 for n in sizes)) for m in whole for f in (F.sum, F.count)}
    since = lambda f, m, n: F.coalesce(f"_{f}_{m}_1", F.lit(0)) - F.coalesce(f"_{f}_{m}_{n + 1}", F.lit(0))
    mean = lambda m, n: F.try_divide(since("sum", m, n), since("count", m, n)) if m in whole else F.avg(m).over(order.rowsBetween(-n, -1))
    return rows.withColumns(running).select(*rows.columns, *(mean(m, n).alias(name.format(m=m, n=n)) for n in sizes for m in measures))


def _with_form(rows: DataFrame, sizes: tuple[int, ...], measures: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy("team").orderBy("date", "seq")
    return _with_means(rows, order, sizes, measures, "{m}_{n}").withColumn("played", F.row_number().over(order) - 1)


def _with_venue(rows: DataFrame, size: int) -> DataFrame:
    return _with_means(rows, Window.partitionBy("team", "is_home").orderBy("date", "seq"), (size,), VENUE_MEASURES, "venue_{m}")


def _with_rest(rows: DataFrame, cap: int) -> DataFrame:
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("team").orderBy("date", "seq")))
    return rows.withColumn("days_rest", F.least(F.coalesce(gap, F.lit(cap)), F.lit(cap)))


def _with_standing(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("league", "season", "team").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    now = {"season_pts": zero(F.sum("pts").over(before)), "gd": zero(F.sum(F.col("gf") - F.col("ga")).over(before)), "season_played": F.count("seq").over(before)}
    return rows.withColumns(now).withColumn("ppg", F.try_divide("season_pts", "season_played"))


def rolling_form(matches: DataFrame, sizes: tuple[int, ...] = (5, 10), measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Means of each team's last matches, and how many it has played."""
    return _with_form(team_rows(matches), sizes, measures).select("seq", "team", "is_home", *(f"{m}_{n}" for n in sizes for m in measures), "played")


def venue_form(matches: DataFrame, size: int = 10) -> DataFrame:
    """Means of each team's last matches at the same kind of venue."""
    return _with_venue(team_rows(matches), size).select("seq", "team", "is_home", *(f"venue_{m}" for m in VENUE_MEASURES))


#: What `own_past` says of a side before a match.
OWN = [*(f"{m}_{n}" for n in (5, 10) for m in ALL_MEASURES), *(f"venue_{m}" for m in VENUE_MEASURES), "played", "gd", "season_played", "ppg", "days_rest"]


def own_past(matches: DataFrame, cap: int = 30) -> DataFrame:
    """Two rows a match, (seq, is_home, OWN...): a side's form, form by venue, rest and standing in its season before it, as the windows
    above give them. A window holds all rows of its group at a time, and one above another can't make it spill; so a team's rows are
    streamed in order instead, through one task that keeps its last 10 rows and a sum for each season of a league."""
    rows = team_rows(matches).withColumns({"_day": F.unix_date(F.col("date").cast("date")), "_gd": F.col("gf") - F.col("ga")})
    kinds = dict(rows.dtypes)
    number = lambda c: F.col(c).cast("bigint" if kinds[c] in WHOLE else "double")
    rows = rows.repartition("team").sortWithinPartitions("team", "date", "seq", "is_home")
    double = [c for c in OWN if c not in ("played", "gd", "season_played", "days_rest")]
    types = dict.fromkeys(double, "double") | {"played": "int", "gd": "bigint" if kinds["_gd"] in WHOLE else "double", "season_played": "bigint", "days_rest": "int"}
    taken = rows.select("seq", "is_home", "team", "league", "season", "_day", number("_gd"), *(number(m) for m in ALL_MEASURES))
    return taken.mapInArrow(lambda it: _past(it, cap), f"seq {kinds['seq']}, is_home boolean, {', '.join(f'{c} {types[c]}' for c in OWN)}")


class _Means:
    """Means of the rows before each one of its key. A key's rows come one after the other; the last ones of the last key are kept."""

    def __init__(self, sizes: tuple[int, ...]) -> None:
        self.sizes, self.key, self.kept = sizes, -1, {}

    def add(self, keys: np.ndarray, columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        """columns: values, 0 where they aren't known, and whether they are. Gives sums and numbers by column and size."""
        out: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        if not len(keys):
            return {(c, n): (v, k.astype(np.int64)) for c, (v, k) in columns.items() for n in self.sizes}
        new = keys != np.concatenate([[self.key], keys[:-1]])
        for c, (value, known) in columns.items():
            if c in self.kept:
                value, known = np.concatenate([self.kept[c][0], value]), np.concatenate([self.kept[c][1], known])
            before = len(value) - len(keys)
            at = np.arange(before, len(value))
            start = np.maximum.accumulate(np.where(new, at, 0))
            count = np.concatenate([[0], np.cumsum(known)])
            if value.dtype == np.int64:
                running = np.concatenate([[0], np.cumsum(value)])
            for n in self.sizes:
                low = np.maximum(start, at - n)
                if value.dtype == np.int64:
                    total = running[at] - running[low]
                else:  # in the order of the rows, as a window adds them
                    total = np.zeros(len(keys))
                    for k in range(n, 0, -1):
                        total += np.where(at - k >= start, value[np.maximum(at - k, 0)], 0.0)
                out[c, n] = total, count[at] - count[low]
            last = max(int(start[-1]), len(value) - max(self.sizes))
            self.kept[c] = value[last:], known[last:]
        self.key = int(keys[-1])
        return out


class _Standing:
    """Sums of points, of differences of goals and of matches before each row of a team in a season of a league."""

    def __init__(self) -> None:
        self.sums: dict[tuple, list] = {}

    def add(self, team: np.ndarray, league: pa.Array, season: pa.Array, columns: list[np.ndarray]) -> list[np.ndarray]:
        coded = [c.dictionary_encode(null_encoding="encode") for c in (league, season)]
        (x, of_x), (y, of_y) = ((c.indices.to_numpy(zero_copy_only=False).astype(np.int64), c.dictionary.to_pylist()) for c in coded)
        group = ((team - team[0]) * len(of_x) + x) * len(of_y) + y
        order = np.argsort(group, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(group[order])) + 1).tolist(), len(group)]
        out = [np.empty_like(c) for c in columns]
        for a, b in zip(edges, edges[1:]):
            at = order[a:b]
            sums = self.sums.setdefault((int(team[at[0]]), of_x[x[at[0]]], of_y[y[at[0]]]), [0] * len(columns))
            for i, c in enumerate(columns):
                running = np.cumsum(np.concatenate([np.array([sums[i]], c.dtype), c[at]]))
                out[i][at], sums[i] = running[:-1], running[-1]
        self.sums = {k: v for k, v in self.sums.items() if k[0] == team[-1]}
        return out


def _past(batches: Iterable[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (seq, is_home, team, league, season, day, gd, ALL_MEASURES...) sorted by team, date and seq as (seq, is_home, OWN...)."""
    form, venues, standing = _Means((5, 10)), {True: _Means((10,)), False: _Means((10,))}, _Standing()
    name, teams, played, day, day_known = None, 0, 0, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        seq, home, size = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.num_rows
        coded = b.column(2).dictionary_encode(null_encoding="encode")
        code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        new = np.concatenate([[teams == 0 or names[code[0]] != name], code[1:] != code[:-1]])
        team = teams + np.cumsum(new)
        name, teams = names[code[-1]], int(team[-1])
        numbers = {c: (b.column(j).fill_null(0).to_numpy(zero_copy_only=False), b.column(j).is_valid().to_numpy(zero_copy_only=False)) for j, c in enumerate(("day", "gd", *ALL_MEASURES), 5)}
        out: dict[str, pa.Array] = {}

        def mean(total: np.ndarray, count: np.ndarray) -> pa.Array:
            return pa.array(total / np.maximum(count, 1), pa.float64(), mask=count == 0)

        for (c, n), found in form.add(team, {m: numbers[m] for m in ALL_MEASURES}).items():
            out[f"{c}_{n}"] = mean(*found)
        sums = {m: (np.zeros(size), np.zeros(size, np.int64)) for m in VENUE_MEASURES}
        for side, means in venues.items():
            at = np.flatnonzero(home == side)
            for (c, _), found in means.add(team[at], {m: tuple(v[at] for v in numbers[m]) for m in VENUE_MEASURES}).items():
                for kept, v in zip(sums[c], found):
                    kept[at] = v
        out |= {f"venue_{m}": mean(*v) for m, v in sums.items()}
        at = np.arange(size)
        start = np.maximum.accumulate(np.where(new, at, -played))
        out["played"] = pa.array(at - start, pa.int32())
        played = int(size - start[-1])
        points, gd, games = standing.add(team, b.column(3), b.column(4), [numbers["pts"][0], numbers["gd"][0], seq.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)])
        out |= {"gd": pa.array(gd), "season_played": pa.array(games), "ppg": mean(points, games)}
        days, known = numbers["day"]
        days, known = (np.concatenate([[x], v]) for x, v in ((day, days), (day_known, known)))
        gap = np.where(known[1:] & known[:-1] & ~new, np.diff(days.astype(np.int64)), cap)
        out["days_rest"] = pa.array(np.minimum(gap, cap), pa.int32())
        day, day_known = int(days[-1]), bool(known[-1])
        yield pa.RecordBatch.from_arrays([seq, b.column(1), *(out[c] for c in OWN)], names=["seq", "is_home", *OWN])


def head_to_head(matches: DataFrame, *keep: str) -> DataFrame:
    """What two teams' earlier matches say: the home side's win rate, the draw rate, and their number; with columns of the match."""
    before = Window.partitionBy("_x", "_y").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, -1)
    winner = F.when(F.col("home_score") > F.col("away_score"), F.col("home")).when(F.col("away_score") > F.col("home_score"), F.col("away"))
    pair = matches.select("seq", "date", "home", *keep, F.least("home", "away").alias("_x"), F.greatest("home", "away").alias("_y"), winner.alias("_w"))
    n = F.count("seq").over(before)
    first = F.coalesce(F.sum((F.col("_w").eqNullSafe(F.col("_x"))).cast("int")).over(before), F.lit(0))
    second = F.coalesce(F.sum((F.col("_w").eqNullSafe(F.col("_y"))).cast("int")).over(before), F.lit(0))
    seen = pair.select("seq", "home", "_x", *keep, n.alias("h2h_matches"), first.alias("_first"), second.alias("_second"))
    wins = F.when(F.col("home") == F.col("_x"), F.col("_first")).otherwise(F.col("_second"))
    draws = F.col("h2h_matches") - F.col("_first") - F.col("_second")
    return seen.select("seq", *keep, "h2h_matches", F.coalesce(F.try_divide(wins, "h2h_matches"), F.lit(0.5)).alias("h2h_home_winrate"), F.coalesce(F.try_divide(draws, "h2h_matches"), F.lit(0.25)).alias("h2h_draw_rate"))


def days_rest(matches: DataFrame, cap: int = 30) -> DataFrame:
    return _with_rest(team_rows(matches), cap).select("seq", "team", "days_rest")


def season_standing(matches: DataFrame) -> DataFrame:
    """Points, goal difference and games of each team in its season before each match; points a game is null at first."""
    rows = _with_standing(team_rows(matches))
    return rows.select("seq", "league", "season", "team", "is_home", F.col("season_pts").alias("pts"), "gd", F.col("season_played").alias("played"), "ppg")


def as_of_position(matches: DataFrame) -> DataFrame:
    """League position of both sides before each match: one more than the teams ahead on points and goal difference, of
    those that have a result.

    A season of a league is streamed in order through one task, which holds a number a team and sets a bounded number of matches
    beside all teams at a time.
    """
    season = F.when(F.col("league").isNotNull() & F.col("season").isNotNull(), F.concat("league", F.lit("\x00"), "season"))
    rows = matches.select(season.alias("_season"), "date", "seq", "home", "away", "home_score", "away_score").repartition("_season").sortWithinPartitions("_season", "date", "seq")
    return rows.select("_season", F.col("seq").cast("long"), "home", "away", F.col("home_score").cast("long"), F.col("away_score").cast("long")).mapInArrow(_positions, "seq long, home_pos int, away_pos int")


#: Cells, matches by teams, that are looked at together; what a point is worth in goals of difference.
CELLS, POINT = 400_000, 1 << 32


class _Season:
    """Each team's points and goal difference as one number, and its results, up to a match."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.standing, self.results = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def place(self, teams: pa.Array) -> np.ndarray:
        coded = teams.dictionary_encode()
        at = np.array([self.places.setdefault(t, len(self.places)) for t in coded.dictionary.to_pylist()], np.int64)
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def play(self, home: pa.Array, away: pa.Array, goals: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
        sides = [self.place(home), self.place(away)]
        more = len(self.places) - len(self.standing)
        self.standing, self.results = (np.concatenate([v, np.zeros(more, np.int64)]) for v in (self.standing, self.results))
        out: list[list[np.ndarray]] = [[], []]
        step = max(1, CELLS // len(self.standing))
        for i in range(0, len(goals), step):
            part, g, k = slice(i, i + step), goals[i : i + step], known[i : i + step]
            row = np.arange(len(g))
            gain, done = (np.zeros((len(g), len(self.standing)), np.int64) for _ in range(2))
            for at, difference in zip(sides, (g, -g)):
                gain[row, at[part]] += np.where(k, (3 * (difference > 0) + (difference == 0)) * POINT + difference, 0)
                done[row, at[part]] += k
            standing, results = self.standing + np.cumsum(gain, axis=0), self.results + np.cumsum(done, axis=0)
            before = standing - gain
            ranked = np.where(results > done, before, np.iinfo(np.int64).min)
            for found, at in zip(out, sides):
                found.append((ranked > before[row, at[part]][:, None]).sum(axis=1) + 1)
            self.standing, self.results = standing[-1], results[-1]
        return [np.concatenate(v) for v in out]


def _positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by season, date and seq as the places of both sides; a match of no season has none before it."""
    last, season = None, _Season()
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.column(0).dictionary_encode(null_encoding="encode")
        codes = kind.indices.to_numpy(zero_copy_only=False)
        x, y = b.column(4), b.column(5)
        known = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
        goals = np.where(known, x.fill_null(0).to_numpy() - y.fill_null(0).to_numpy(), 0)
        places = [np.ones(b.num_rows, np.int32) for _ in range(2)]
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
        for start, end in zip(edges, edges[1:]):
            name = kind.dictionary[int(codes[start])].as_py()
            if name is None:
                continue
            if name != last:
                last, season = name, _Season()
            part = slice(start, end)
            for place, found in zip(places, season.play(b.column(2)[part], b.column(3)[part], goals[part], known[part])):
                place[part] = found
        yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(p) for p in places)], names=["seq", "home_pos", "away_pos"])


def form_strip(matches: DataFrame, size: int = 5) -> DataFrame:
    """Each team's last results, newest first."""
    order = Window.partitionBy("team").orderBy(F.col("date").desc(), F.col("seq").desc())
    last = team_rows(matches).select("team", "gf", "ga", F.row_number().over(order).alias("_n")).where(F.col("_n") <= size)
    letters = F.array_sort(F.collect_list(F.struct("_n", X.result_letter(F.col("gf"), F.col("ga")).alias("r"))))
    return last.groupBy("team").agg(F.array_join(F.transform(letters, lambda x: x["r"]), "").alias("strip"))


def form_store(matches: DataFrame) -> DataFrame:
    """Means of each team's last 5 and 10 matches and of its last 10 at home and away, its last 5 results (oldest first),
    matches played and the last day, for serving."""
    newest = [F.col("date").desc(), F.col("seq").desc()]
    rows = team_rows(matches).withColumns({"_n": F.row_number().over(Window.partitionBy("team").orderBy(*newest)), "_v": F.row_number().over(Window.partitionBy("team", "is_home").orderBy(*newest))})
    means = [F.bround(F.avg(F.when(F.col("_n") <= n, F.col(m))), 4).alias(f"{m}_{n}") for n in (5, 10) for m in ALL_MEASURES]
    means += [F.bround(F.avg(F.when((F.col("_v") <= 10) & (F.col("is_home") == home), F.col(m))), 4).alias(f"venue_{side}_{m}") for side, home in (("home", True), ("away", False)) for m in VENUE_MEASURES]
    letters = F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.struct((-F.col("_n")).alias("_n"), X.result_letter(F.col("gf"), F.col("ga")).alias("r")))))
    return rows.groupBy("team").agg(*means, F.transform(letters, lambda x: x["r"]).alias("form_summary"), F.count("*").alias("matches_played"), F.max("date").alias("last_match_date"))


def head_to_head_store(matches: DataFrame) -> DataFrame:
    """For each pair of teams, t1 before t2 by name: the share of wins of both and of draws, and their number, for serving."""
    rows = matches.select(F.least("home", "away").alias("t1"), F.greatest("home", "away").alias("t2"), F.when(F.col("home_score") > F.col("away_score"), F.col("home")).when(F.col("away_score") > F.col("home_score"), F.col("away")).alias("_w"))
    share = lambda c: F.bround(F.count_if(c) / F.count("*"), 4)
    first, second = F.col("_w").eqNullSafe(F.col("t1")), F.col("_w").eqNullSafe(F.col("t2"))
    return rows.groupBy("t1", "t2").agg(share(first).alias("t1_winrate"), share(second).alias("t2_winrate"), share(~first & ~second).alias("draw_rate"), F.count("*").alias("matches"))


def standings_store(matches: DataFrame) -> DataFrame:
    """The table of each league's latest season, a row for each league, for serving: one entry for each team that played."""
    rows = team_rows(matches)
    latest = rows.groupBy("league").agg(F.max_by("season", F.struct("date", "seq")).alias("season"))
    at = F.struct(F.sum("pts").alias("pts"), F.sum(F.col("gf") - F.col("ga")).alias("gd")).alias("at")
    teams = rows.join(latest, ["league", "season"]).groupBy("league", "season", "team").agg(at, F.count("*").alias("played"))
    return teams.groupBy("league", "season").agg(F.collect_list(F.struct("team", "at", "played")).alias("teams"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that leaves no ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_by_trust(matches: DataFrame) -> DataFrame:
    """One row for each day and pair of teams: the most trusted source, then the fullest row, then the earliest."""
    full = F.col("home_shots").isNotNull().cast("int") + F.col("odds_home").isNotNull().cast("int")
    return first_of(matches.withColumn("_full", full), ["date", "home", "away"], [F.col("trust"), F.col("_full").desc(), F.col("seq")]).drop("_full")


def latest_per_team(matches: DataFrame) -> DataFrame:
    """Each team's league as of its last match."""
    return first_of(team_rows(matches), ["team"], [F.col("date").desc(), F.col("seq").desc()]).select("team", "league", "date", "seq")


def league_openers(matches: DataFrame) -> DataFrame:
    """First match of each league and season, and whether either side appears only once in it."""
    rows = team_rows(matches).withColumn("_times", F.count("*").over(Window.partitionBy("league", "season", "team")))
    opener = first_of(matches.select("seq", "date", "league", "season"), ["league", "season"], [F.col("date"), F.col("seq")])
    singles = rows.groupBy("league", "season").agg(F.count_if(F.col("_times") == 1).alias("singletons"))
    return opener.join(singles, ["league", "season"]).select("league", "season", "seq", "singletons")
