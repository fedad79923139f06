"""Keyed tables in buckets, copied on write, that change together.

A table's rows are dealt to buckets by a hash of their key. A change writes new files for the buckets that it touches and then a
manifest: a numbered file that says, for every table, in which folders its buckets are. Renaming the manifest into place is the
commit, so a reader sees all of a change or nothing of it, in one table or in several, and what a change writes grows with the
buckets that it touches and not with the tables. A change may have a tag, which the manifest keeps: a change whose tag is known has
been made and isn't made again, so a batch that is repeated after a crash does no harm. Folders that no manifest names are left from
changes that failed, and `sweep` drops them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.operators import badges, state


@dataclass(frozen=True)
class Table:
    """What is known of a table: its key, what becomes of its columns when a key is in the store already (`state.merge`), a
    condition over new and old rows for that, the order in which the last of a batch's rows of a key counts, and its buckets."""

    key: str
    policy: dict[str, str]
    guard: str | None = None
    last: tuple[str, ...] = ("updated_at",)
    buckets: int = 64


#: The policies of predictions: probabilities are replaced, what a market or a comment said is never lost to a null.
PREDICTION_POLICY = {
    "home_win": "overwrite", "draw": "overwrite", "away_win": "overwrite", "predicted_outcome": "overwrite", "market_home": "new_old", "market_draw": "new_old", "market_away": "new_old",
    "ai_summary": "new_old", "payload_json": "new_old", "created_at": "insert_only", "updated_at": "overwrite",
}
TABLES = {
    "fixtures": Table("match_key", state.FIXTURE_POLICY, "new.progress >= old.progress", ("progress", "updated_at")),
    "predictions": Table("match_key", PREDICTION_POLICY),
    "ai_insights": Table("match_key", badges.INSIGHT_POLICY),
    "betslip": Table("match_key", {}),
    "team_assets": Table("team", badges.POLICY),
    "market_odds": Table("league", badges.MARKET_POLICY, last=("fetched_at",), buckets=8),
    "digests": Table("day", {"text": "insert_only", "sent_at": "insert_only"}, last=("sent_at",), buckets=4),
}


class Conflict(RuntimeError):
    """Another change was committed first."""


@dataclass
class Manifest:
    version: int = 0
    #: By table: the columns, and the folder of each bucket that has rows.
    columns: dict[str, str] = field(default_factory=dict)
    folders: dict[str, dict[int, str]] = field(default_factory=dict)
    tags: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table] | None = None) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables or TABLES

    # the file system

    def _at(self, path: str):  # noqa: ANN202
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):  # noqa: ANN202
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs = self._files()
        return [f.getPath().getName() for f in fs.listStatus(self._at(folder))] if fs.exists(self._at(folder)) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version."""
        found = [int(n[:-5]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json") and n[:-5].isdigit()]
        found = [v for v in found if version is None or v == version]
        if not found:
            return Manifest()
        stream = self._files().open(self._at(f"{self.path}/manifest/{max(found):020d}.json"))
        try:
            said = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(max(found), said["columns"], {t: {int(b): f for b, f in x.items()} for t, x in said["folders"].items()}, said["tags"])

    def _commit(self, was: Manifest, columns: dict[str, str], folders: dict[str, dict[int, str]], tag: str | None) -> int:
        version = was.version + 1
        said = {"columns": columns, "folders": folders, "tags": was.tags | ({tag: version} if tag else {})}
        fs, draft, final = self._files(), self._at(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifest/{version:020d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} was committed by another change")
        return version

    # reading

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as it is or was, or some of its buckets; None if it has never had rows."""
        return self._read(self.manifest(version), name, buckets)

    def _read(self, m: Manifest, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        if name not in m.columns:
            return None
        paths = [f for b, f in sorted(m.folders.get(name, {}).items()) if buckets is None or b in buckets]
        return self.spark.read.schema(m.columns[name]).parquet(*paths) if paths else self.spark.createDataFrame([], m.columns[name])

    def _bucket(self, name: str) -> Column:
        t = self.tables[name]
        return F.pmod(F.xxhash64(F.col(t.key).cast("string")), F.lit(t.buckets)).cast("int")

    # changes

    def _write(self, name: str, rows: DataFrame, touched: list[int]) -> dict[int, str | None]:
        """New folders for buckets; None for one that has no row any more."""
        folder = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(name)).repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(folder)
        there = {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}
        return {b: there.get(b) for b in touched}

    def _changed(self, tag: str | None, changes: Callable[[Manifest], dict[str, tuple[DataFrame, list[int]]]]) -> bool:
        """Commits what changes(manifest) gives for tables: their new rows of some buckets, and those buckets."""
        m = self.manifest()
        if tag is not None and tag in m.tags:
            return False
        columns, folders = dict(m.columns), {t: dict(x) for t, x in m.folders.items()}
        for name, (rows, touched) in changes(m).items():
            columns.setdefault(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
            own = folders.setdefault(name, {})
            for b, f in self._write(name, rows, touched).items():
                if f is None:
                    own.pop(b, None)
                else:
                    own[b] = f
        self._commit(m, columns, folders, tag)
        return True

    def upsert(self, name: str, batch: DataFrame, tag: str | None = None) -> bool:
        """Merges a batch by the table's policy; whether it was new. Of rows of a batch that repeat a key the last one counts."""
        t = self.tables[name]
        order = [F.col(c).desc_nulls_last() for c in t.last if c in batch.columns]
        rest = [F.xxhash64(*(F.col(f"`{c}`") for c in batch.columns))]
        one = batch.where(F.col(t.key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(t.key).orderBy(*order, *rest))).where("_n = 1").drop("_n")

        def changes(m: Manifest) -> dict[str, tuple[DataFrame, list[int]]]:
            touched = sorted(r[0] for r in one.select(self._bucket(name)).distinct().collect())  # as many as buckets, at most
            old = self._read(m, name, touched)
            rows = one if old is None else state.merge(old, one.select(*old.columns), t.key, t.policy, F.expr(t.guard) if t.guard else None).select(*old.columns)
            return {name: (rows, touched)}

        return self._changed(tag, changes)

    def doomed(self, keys: DataFrame, names: list[str], m: Manifest | None = None) -> dict[str, DataFrame]:
        """Of each table, the rows of keys(key of the first table)."""
        m = m or self.manifest()
        key = self.tables[names[0]].key
        every = keys.select(F.col(key).alias("_gone")).distinct()
        found = {n: self._read(m, n) for n in names}
        return {n: d.join(every, F.col(self.tables[n].key) == F.col("_gone"), "left_semi") for n, d in found.items() if d is not None}

    def would_go(self, keys: DataFrame, names: list[str]) -> DataFrame:
        """(table, n): how many rows of each table the keys would take; nothing changes."""
        out = None
        for n, rows in self.doomed(keys, names).items():
            one = rows.agg(F.lit(n).alias("table"), F.count("*").alias("n"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "`table` string, n long")

    def delete(self, keys: DataFrame, names: list[str], tag: str | None = None) -> bool:
        """Deletes keys from a table and from those that depend on it, all at once or not at all."""

        def changes(m: Manifest) -> dict[str, tuple[DataFrame, list[int]]]:
            key, out = self.tables[names[0]].key, {}
            every = keys.select(F.col(key).alias("_gone")).distinct()
            for name, rows in self.doomed(keys, names, m).items():
                touched = sorted(r[0] for r in rows.select(self._bucket(name)).distinct().collect())
                if touched:
                    old = self._read(m, name, touched)
                    out[name] = (old.join(every, F.col(self.tables[name].key) == F.col("_gone"), "left_anti"), touched)
            return out

        return self._changed(tag, changes)

    def sweep(self, keep: int = 1) -> int:
        """Drops manifests but the newest, and the folders that those left don't name; how many folders went. Not beside a change."""
        fs = self._files()
        found = sorted(int(n[:-5]) for n in self._names(f"{self.path}/manifest") if n.endswith(".json"))
        named = {f.rsplit("/", 1)[0] for v in found[-keep:] for x in self.manifest(v).folders.values() for f in x.values()}
        for v in found[:-keep]:
            fs.delete(self._at(f"{self.path}/manifest/{v:020d}.json"), False)
        gone = [f"{self.path}/data/{t}/{n}" for t in self._names(f"{self.path}/data") for n in self._names(f"{self.path}/data/{t}")]
        gone = [f for f in gone if f not in named]
        for f in gone:
            fs.delete(self._at(f), True)
        return len(gone)


def once_a_day(store: Store, digest: DataFrame, day: str, now: Column) -> bool:
    """Keeps digest(text) as the one of a day, whose tag is the day itself; whether it was the first. What is sent is what the store
    then holds of the day, so a run that is repeated, or that crashed between the commit and the sending, sends the same text."""
    return store.upsert("digests", digest.select(F.lit(day).alias("day"), "text", now.alias("sent_at")), tag=f"digest-{day}")


def retention(store: Store, training_keys: DataFrame, now: Column, days: int = 180, dry: bool = True) -> DataFrame:
    """(table, n) of what retention takes from fixtures and, with them, from what depends on them; unless dry, it goes."""
    rows = store.read("fixtures")
    names = ["fixtures", "predictions", "ai_insights", "betslip"]
    if rows is None:
        return store.would_go(training_keys, names)
    keys = state.prunable(rows, training_keys, now, days).select("match_key")
    told = store.would_go(keys, names)
    if not dry:
        told = store.spark.createDataFrame(told.collect(), told.schema)  # a row a table, counted before they change
        store.delete(keys, names)
    return told
