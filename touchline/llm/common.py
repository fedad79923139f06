"""What the training-data operators share: table reading, shared scratch tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset in a local
    session (tests). A cluster must name it: executors could not read each other's files in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='touchline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Scratch tables that exist, oldest first, and the tables that frames read.
_made: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/touchline/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def finished(*tables: DataFrame) -> None:
    """Drops tables made by `written` when all that is read from them has been written itself."""
    for t in tables:
        _forget({_paths.pop(t)})


def scratch_made() -> set[str]:
    """Paths of the scratch tables that exist."""
    return {path for _, path in _made}


def release(paths: set[str] | None = None, reading: DataFrame | None = None) -> None:
    """Drops scratch tables, all or those of paths, but none that `reading` reads: for the end of a piece of work whose result has
    been written."""
    files = reading.inputFiles() if reading is not None else []
    gone = scratch_made() if paths is None else paths
    _forget({path for path in gone if not any(path.rsplit("/", 1)[1] in f for f in files)})


def _forget(paths: set[str]) -> None:
    for spark, path in [m for m in _made if m[1] in paths]:
        drop(spark, path)
        _made.remove((spark, path))


atexit.register(release)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table; nothing happens once the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def _stars(edges: DataFrame) -> bool:
    """Whether no node of edges(a, b), from larger to smaller ones, has two smaller neighbours, or smaller and larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("_e")).select("_e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("_k"), F.min("up").alias("_least"))
    return nodes.where("_k > 1 or _k = 1 and _least = 0").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): a row (node, component) for each node, component the smallest node reachable.

    Distributed union-find by alternating large-star and small-star steps, in which every node learns only of smaller
    neighbours. A hub's rows are never gathered: the steps use the minimum of a group, which Spark pre-aggregates, and a
    join. Rounds needed grow with the logarithm of the longest path; none follows one that has left stars only. A round's plan
    reads the edges four times: the driver keeps plans and tasks of past rounds for a while.
    """
    pair = lambda d: d.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    two = lambda d, x, y: d.select(F.explode(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(e, "ab"))) for e in (x, y)))).alias("_e")).select("_e.*")
    now = written(pair(edges.select("a", "b")), f"{tag}-edges")
    for _ in range(max_rounds):
        if _stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        # large star: each node's larger neighbours are tied to the least of its neighbourhood
        least = two(now, "ab", "ba").groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pair(now.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: each node and its smaller neighbours are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = pair(two(large.join(low, "a"), "bm", "am"))
        before, now = now, written(small, f"{tag}-edges")
        finished(before)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Buckets of a filter by id: a broadcast of at most so many numbers, however many ids there are.
BUCKETS = 1 << 20


def _bucketed(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    bucket = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(BUCKETS)).cast("int")
    held = ids.select(bucket(F.col("id")).alias("_bucket")).distinct()
    return rows.join(F.broadcast(held), bucket(F.col(column)) == F.col("_bucket"), how)


def likely(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose id may be among ids(id): a bounded filter, made before a join, that lets all that match pass."""
    return _bucketed(rows, ids, column, "left_semi")


def unlikely(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The other rows; none of them is among ids."""
    return _bucketed(rows, ids, column, "left_anti")


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose id isn't among ids(id), a null one included. Rows that the bounded filter clears aren't moved."""
    some = likely(rows, ids, column).join(ids.select(F.col("id").cast("long").alias("_gone")), F.col(column).cast("long") == F.col("_gone"), "left_anti")
    return some.unionByName(unlikely(rows, ids, column))
