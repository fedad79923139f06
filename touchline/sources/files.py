"""Match files: discovery, what is new, format by header, and the three CSV layouts. Cells are read as text and tried, so a
bad cell costs a value, not a row."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import schema as S
from touchline.functions import scalar as X

# Headers that tell a layout, the columns of the bulk odds layout, and its divisions.
BULK = {"Div", "Date", "HomeTeam", "AwayTeam"}
CANONICAL = {"date", "league", "home_team", "away_team", "home_score", "away_score"}
AGGREGATE = {"date_GMT", "home_team_name", "away_team_name", "home_team_goal_count", "away_team_goal_count"}
BULK_STATS = {"HS": "home_shots", "AS": "away_shots", "HST": "home_shots_on_target", "AST": "away_shots_on_target", "HC": "home_corners", "AC": "away_corners", "HF": "home_fouls", "AF": "away_fouls", "HY": "home_yellow", "AY": "away_yellow", "HR": "home_red", "AR": "away_red", "HTHG": "home_half_score", "HTAG": "away_half_score"}
DIVISIONS = {
    "E0": ("Premier League", "England"), "E1": ("Championship", "England"), "E2": ("League One", "England"), "D1": ("Bundesliga", "Germany"), "I1": ("Serie A", "Italy"), "SP1": ("La Liga", "Spain"),
    "F1": ("Ligue 1", "France"), "N1": ("Eredivisie", "Netherlands"), "P1": ("Liga Portugal", "Portugal"), "SC0": ("Scottish Premiership", "Scotland"),
}

# How an aggregator's file names begin, and the countries of leagues.
SLUGS = {
    "england-premier-league": "Premier League", "england-championship": "Championship", "england-league-one": "League One", "germany-bundesliga": "Bundesliga", "italy-serie-a": "Serie A", "spain-la-liga": "La Liga",
    "france-ligue-1": "Ligue 1", "netherlands-eredivisie": "Eredivisie", "portugal-liga-nos": "Liga Portugal", "portugal-primeira-liga": "Liga Portugal", "scotland-premiership": "Scottish Premiership",
    "south-africa-premier-soccer-league": "Betway Premiership",
}
COUNTRIES = dict(DIVISIONS.values()) | {"Betway Premiership": "South Africa"}


def discover(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, name, sha1, size, content) of files; contents are digested and parsed where they are read, and only read if they are
    asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha1("content").alias("sha1"), F.col("length").alias("size"), "content")


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest(name, sha1) doesn't know as they are."""
    return files.join(manifest, ["name", "sha1"], "left_anti")


MANIFEST = "name string, sha1 string, size long, rows long, ingested_at timestamp"


def load_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table written before, or an empty one of that schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def recorded(manifest: DataFrame, parsed: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The manifest after parsed(path, name, sha1, size) gave rows(_file, ...). A file that wasn't recognised isn't in parsed, so it
    is looked at again next time."""
    n = rows.groupBy(F.element_at(F.split("_file", "/"), -1).alias("_name")).agg(F.count("*").alias("rows"))
    new = parsed.join(n, F.url_decode("name") == F.url_decode("_name"), "left").select("name", "sha1", "size", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), now.alias("ingested_at"))
    return manifest.join(new.select("name"), "name", "left_anti").unionByName(new)


def layout(columns: list[str]) -> str | None:
    have = set(columns)
    return next((n for n, need in (("bulk", BULK), ("canonical", CANONICAL), ("aggregate", AGGREGATE)) if need <= have), None)


def cells(content: bytes | pa.Buffer) -> tuple[list[str], Iterator[list[str]]]:
    """A CSV file's header and rows, all cells as text: UTF-8, with or without a mark, or Latin-1 where the bytes aren't. Rows with more
    cells than the header are dropped, shorter ones are padded, blank ones are no rows. The content is decoded as rows are taken."""
    source, decoder, code = pa.BufferReader(content), codecs.getincrementaldecoder("utf-8")(), "utf-8"
    try:
        while part := source.read(1 << 16):
            decoder.decode(part)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        code = "latin-1"
    source.seek(0)
    source.seek(3 if source.read(3) == codecs.BOM_UTF8 else 0)
    rows = csv.reader(io.TextIOWrapper(source, code, newline=""))
    header = [c.strip() for c in next(rows, [])]
    return header, ([c.strip() for c in r] + [""] * (len(header) - len(r)) for r in rows if len(r) <= len(header) and any(r))


def parsed(files: DataFrame, with_aggregates: bool = False) -> DataFrame:
    """files(path, name, content) as path, name, layout and cells (a map from column to text): first a row without cells for each
    file, then its rows if it is of a known layout. Files are decoded and told apart in the tasks, and all of them by one plan; an
    aggregator's exports are known by their names, too, and only if they are asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, content in zip(*(c for c in b.columns)):
                path, name = path.as_py(), name.as_py()
                header, rows = cells(content.as_buffer())
                kind = layout(header)
                if kind == "aggregate" and not (with_aggregates and "-matches-" in name.lower()):
                    kind = None
                out: list[list[tuple[str, str]] | None] = [None]
                for r in rows if kind else ():
                    out.append([(c, v) for c, v in dict(zip(header, r)).items() if v])
                    if len(out) >= 10_000:
                        yield batch(path, name, kind, out)
                        out = []
                yield batch(path, name, kind, out)

    def batch(path: str, name: str, kind: str | None, out: list) -> pa.RecordBatch:
        n = len(out)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(out, pa.map_(pa.string(), pa.string()))], names=["path", "name", "layout", "cells"])

    return files.select("path", "name", "content").mapInArrow(run, "path string, name string, layout string, cells map<string,string>")


def conform(df: DataFrame, schema=S.MATCH) -> DataFrame:
    """The schema's columns, in its order; missing ones are null, cells that don't fit become null."""
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def _filed(df: DataFrame) -> DataFrame:
    return conform(df, T.StructType([*S.MATCH.fields, T.StructField("_file", T.StringType())]))


def _usable(df: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")).isin("", "nan", "NaN")
    return df.where(F.col("date").isNotNull() & F.col("outcome").isNotNull() & ~blank(F.col("home_team")) & ~blank(F.col("away_team")) & (F.col("home_team") != F.col("away_team")))


def any_day(text: Column) -> Column:
    """Day first, with two or four digits of the year, or ISO."""
    return F.to_date(F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ("d/M/yyyy", "d/M/yy", "yyyy-MM-dd"))))


def bulk(raw: DataFrame, source: str = "football-data.co.uk") -> DataFrame:
    """The bulk results and odds layout. A file's season is that of most of its matches."""
    have = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    hs, as_ = have("FTHG").try_cast("int"), have("FTAG").try_cast("int")
    odds = {o: F.coalesce(*(have(f"{b}{k}").try_cast("double") for b in ("B365", "Avg"))).alias(o) for o, k in (("odds_home", "H"), ("odds_draw", "D"), ("odds_away", "A"))}
    place = F.create_map(*(F.lit(x) for d, (league, country) in DIVISIONS.items() for x in (d, f"{league}|{country}")))
    rows = raw.select(
        "_file", any_day(have("Date")).alias("date"), F.element_at(place, have("Div")).alias("_place"), have("HomeTeam").alias("home_team"), have("AwayTeam").alias("away_team"),
        hs.alias("home_score"), as_.alias("away_score"), X.outcome_from_letter(have("FTR"), hs, as_).alias("outcome"), *odds.values(), *(have(c).try_cast("int").alias(n) for c, n in BULK_STATS.items()), F.lit(source).alias("source"),
    )
    rows = rows.withColumns({"league": F.split("_place", r"\|")[0], "country": F.get(F.split("_place", r"\|"), F.lit(1))}).where("league is not null")
    seasons = rows.where("date is not null").groupBy("_file", X.season_label(F.col("date")).alias("season")).count()
    modal = seasons.groupBy("_file").agg(F.max_by("season", F.struct("count", -F.substring("season", 1, 4).cast("int"))).alias("season"))
    return _filed(_usable(rows.join(modal, "_file")))


def canonical(raw: DataFrame, source: str = "canonical") -> DataFrame:
    """The canonical layout: outcomes are computed again, seasons and sources only filled in."""
    rows = _filed(raw)
    rows = rows.withColumn("outcome", X.outcome(F.col("home_score"), F.col("away_score")))
    return _usable(rows.withColumns({"season": F.coalesce("season", X.season_label(F.col("date"))), "source": F.coalesce("source", F.lit(source))}))


def aggregate(raw: DataFrame, league: Column, country: Column, source: str = "FootyStats") -> DataFrame:
    """The match export of an aggregator: finished matches only; odds of 1 or less mean none."""
    day = F.to_date(F.try_to_timestamp(F.trim(F.split("date_GMT", " - ")[0]), F.lit("MMM d yyyy")))
    hs, as_ = F.col("home_team_goal_count").try_cast("int"), F.col("away_team_goal_count").try_cast("int")
    price = lambda c: (F.when(F.col(c).try_cast("double") > 1.0, F.col(c).try_cast("double")) if c in raw.columns else F.lit(None).cast("double"))
    done = raw.where(F.lower(F.trim("status")) == "complete") if "status" in raw.columns else raw
    rows = done.select("_file", day.alias("date"), X.season_label(day).alias("season"), league.alias("league"), country.alias("country"), F.col("home_team_name").alias("home_team"), F.col("away_team_name").alias("away_team"), hs.alias("home_score"), as_.alias("away_score"), X.outcome(hs, as_).alias("outcome"), price("odds_ft_home_team_win").alias("odds_home"), price("odds_ft_draw").alias("odds_draw"), price("odds_ft_away_team_win").alias("odds_away"), F.lit(source).alias("source"))
    return _filed(_usable(rows))


def aggregate_files(raw: DataFrame) -> DataFrame:
    """The aggregator's exports, whose league is told by the file's name; a file of no known league gives no rows."""
    name = F.lower(F.element_at(F.split("_file", "/"), -1))
    league = F.coalesce(*(F.when(F.startswith(name, F.lit(slug)), F.lit(place)) for slug, place in SLUGS.items()))
    country = F.try_element_at(F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv)), F.col("league"))
    rows = raw.withColumn("league", league).where("league is not null").withColumn("country", country)
    return aggregate(rows, F.col("league"), F.col("country"))


#: Columns of each layout that are read.
USED = {
    "bulk": [*sorted(BULK), "FTHG", "FTAG", "FTR", *(f"{b}{k}" for b in ("B365", "Avg") for k in "HDA"), *BULK_STATS],
    "canonical": [f.name for f in S.MATCH.fields],
    "aggregate": [*sorted(AGGREGATE), "status", "odds_ft_home_team_win", "odds_ft_draw", "odds_ft_away_team_win"],
}


def ingest(files: DataFrame, with_aggregates: bool = False) -> tuple[DataFrame, DataFrame]:
    """The files of discover() as one canonical frame with _file, and a report (path, name, layout), layout null where a file isn't
    recognised. There are as many parts as layouts, however many files or headers there are."""
    rows = parsed(files, with_aggregates)
    make = {"bulk": bulk, "canonical": canonical, "aggregate": aggregate_files}
    parts = []
    for kind, work in make.items():
        own = rows.where((F.col("layout") == kind) & F.col("cells").isNotNull())
        raw = own.select(*(F.col("cells")[c].alias(c) for c in USED[kind]), F.col("path").alias("_file"))
        if kind == "aggregate":  # a file without a column of states holds finished matches only
            raw = raw.withColumn("status", F.coalesce("status", F.lit("complete")))
        parts.append(work(raw))
    return reduce(DataFrame.unionByName, parts), rows.where("cells is null").select("path", "name", "layout")
