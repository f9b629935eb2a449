"""Shared intermediate tables, skew-safe lookups and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds more than 1/HEAVY of the rows, so there are fewer than HEAVY of them.
HEAVY = 1000
#: Rows of a written table that may be broadcast: about 16 MB of ids. Beyond that both sides are shuffled.
SMALL = 1 << 18
#: Bytes of one Arrow batch to or from Python while a table is written.
BATCH = 8 << 20
#: The share of the driver's heap from which on its garbage is collected after a table is written.
FULL = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="checkpoint-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``df``, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Bounds the bytes of Arrow batches in plans made meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bound_batches(spark: SparkSession, size: int = BATCH) -> None:
    """Bounds the bytes of Arrow batches in all later plans of the session, unless it has a lower bound already: for a table that the caller writes, which is planned only then."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark, spark.conf.get(key)) <= size:
        spark.conf.set(key, size)


def _bytes(spark: SparkSession, text: str) -> int:
    """A size as Spark writes it."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def tidy(spark: SparkSession) -> bool:
    """Collects the driver's garbage if its heap has grown beyond FULL of what it may take.

    Plans, statistics, shuffles and broadcasts of jobs that are over stay until
    then, and by itself the heap grows to its bound before they go. A cluster's
    driver holds little else; a local one also runs the tasks.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= FULL * runtime.maxMemory():
        return False
    spark._jvm.java.lang.System.gc()
    return True


class Scratch:
    """Writes intermediate results as Parquet in the shared folder and reads them back.

    A written table cuts the lineage: losing an executor costs the running
    tasks, never what was finished. ``drop`` removes a table as soon as nothing
    reads it any more; tables that a returned DataFrame still reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"
        with batches_of(self.spark, BATCH):
            df.write.parquet(path)
        tidy(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            found = self.paths.pop(id(t), None)
            if found:
                p = jvm.org.apache.hadoop.fs.Path(found[1])
                p.getFileSystem(conf).delete(p, True)


def lookup(big: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """big JOIN few USING (key), for a written table ``few`` of numbers; it is broadcast if it has at most SMALL rows."""
    return big.join(F.broadcast(few) if few.count() <= SMALL else few, key)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """big JOIN small USING (keys), where one key of ``big`` may hold a large part of its rows.

    ``small`` has one row a key, whose column ``size`` is the key's number of
    rows in ``big``; ``total`` is at least the sum of those. Keys above
    total/HEAVY (so fewer than HEAVY keys: that is the bound of the only
    broadcast) are dealt over as many salts as keep each part under
    total/HEAVY rows; all others are joined by the key alone.
    """
    limit = max(total // HEAVY, 1)
    parts = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    heavy = small.where(F.col(size) > limit).select(*keys, parts.alias("__parts"))
    left = big.join(F.broadcast(heavy), keys, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = small.withColumn("__salt", F.explode(F.when(F.col(size) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def salts(total: int, rest: str | None = None) -> Column:
    """The number of salts of a key in ``salted_pairs``."""
    limit = F.lit(max(total // HEAVY, 1))
    return F.ceil(F.col("len") / (F.greatest(limit, F.ceil(F.col(rest) / 4)) if rest else limit)).cast("int")


def salted_pairs(few: DataFrame, many: DataFrame, key: str, spread: str, columns: tuple[str, ...], total: int, rest: str | None = None) -> DataFrame:
    """few JOIN many USING (key); ``columns`` of ``few`` get a 2 at the end. Both have ``len``, the key's number of rows in ``many``, and ``total`` is at least the sum of those: keys above total/HEAVY are dealt over salts, and the rows of ``few`` go to each.

    ``rest`` names a column with the key's number of rows in ``few``: a salt then
    takes a quarter as many rows of ``many`` at least, so that no more than
    4 * len + rest rows of ``few`` go out for a key.
    """
    parts = salts(total, rest)
    left = few.select(key, *(F.col(c).alias(f"{c}2") for c in columns), F.explode(F.sequence(F.lit(0), parts - 1)).alias("__salt"))
    right = many.withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("len")
    return left.join(right, [key, "__salt"]).drop("__salt")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): (id, component) for every id of an edge, component its smallest reachable id.

    Alternating large-star and small-star steps until every id has one edge, to
    an id without one; edges that are such stars already need no round. Each
    round is one written table, and hub ids with very many edges are salted.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))

    def state(df: DataFrame) -> tuple:
        """The number of edges, and of ids that keep them from being stars around their smallest ids."""
        ends = df.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(df.select("v", F.lit(0), F.lit(1)))
        ids = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return tuple(ids.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first())

    # u > v throughout
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    total, tangled = state(now)
    while tangled:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = scratch.put(lowest(both), "mins")
        large = salted_join(both.where("v > u"), mins, ["u"], "v", "deg", 2 * total).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.put(large, "large")
        mins2 = scratch.put(lowest(large), "mins2")
        small = salted_join(large, mins2, ["u"], "v", "deg", 2 * total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.put(small, "edges")
        scratch.drop(now, mins, large, mins2)
        now = after
        total, tangled = state(now)
    labels = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return labels.unionAll(labels.select("component").distinct().select(F.col("component").alias("id"), "component"))
