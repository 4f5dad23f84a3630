"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A temporary one is
    set only where that is unset and Spark runs in one local process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    It cuts the lineage so that a lost executor costs one stage at most, computes
    once what several branches need, and gives the planner the true size, so that
    a join broadcasts this side only below ``autoBroadcastJoinThreshold`` and
    shuffles otherwise. The files go at ``release``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/umbra-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._umbra_path = path
    _made.append(table)
    return table


_made: list[DataFrame] = []


def made(mark: int | None = None):
    """The number of tables made so far, or those made since that mark."""
    return len(_made) if mark is None else _made[mark:]


def _place(spark, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def delete_on_exit(spark, path: str) -> None:
    fs, hadoop = _place(spark, path)
    fs.deleteOnExit(hadoop)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        if table is not None and getattr(table, "_umbra_path", None):
            fs, hadoop = _place(table.sparkSession, table._umbra_path)
            fs.delete(hadoop, True)
            table._umbra_path = None
            _made[:] = [x for x in _made if x is not table]


HEAVY = 1024


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined to ``facts``, one row per key with the number of rows that
    have it in the column ``size``.

    Keys with a 1024th of all counted rows or more, 1024 at most, are broadcast. If the
    others are too many for that and their join shuffles, it deals the rows of the first
    evenly, so no task gets the rows of a large key.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    if not total:
        return rows.join(facts, key, "left")
    heavy = facts.where(F.col(size) * HEAVY >= total)
    light = facts.where(F.col(size) * HEAVY < total)
    names = [c for c in facts.columns if c != key]
    first = rows.join(F.broadcast(heavy), key, "left").withColumnsRenamed({c: f"{c}__heavy" for c in names})
    own, nil, same = free(rows, "own", "nil", "same")
    salt = F.when(F.col(f"{size}__heavy").isNotNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1_000_003))).otherwise(0)
    light = light.withColumnsRenamed({key: same}).withColumn(nil, F.lit(0).cast("long"))
    both = first.withColumn(own, salt.cast("long")).join(light, (F.col(own) == F.col(nil)) & (F.col(key) == F.col(same)), "left")
    return both.select(*rows.columns, *[F.coalesce(f"{c}__heavy", c).alias(c) for c in names])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches, rows: int = 512):
    """Arrow batches in slices, so that few texts are Python objects at a time."""
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on
    between tasks, and what they hold on to is an executor's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def ascii_lower(column):
    """Lower-case A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, UPPER.lower())


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to be added to rows of somebody else, whatever theirs are."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + x for x in names]


def drop_rows(docs: DataFrame, keys: DataFrame, th: Column, merge: bool = False) -> DataFrame:
    """Remove rows of ``docs`` by ``keys(id, th, kept)``, one row per row of docs.

    A row is named by its doc_id and ``th``, a hash of its text. Rows of one name are
    repeats of each other; of those one stays if any of them stays. ``merge`` plans a
    merge join at every size, for names to drop that are a fixed share of all rows and
    outgrow any broadcast; else the planner goes by their size.
    """
    i, t, li, lt, n = free(docs, "id", "th", "lost_id", "lost_th", "n")
    per = keys.groupBy("id", "th").agg(F.sum(F.col("kept").cast("int")).alias(n), F.count("*").alias("of"))
    lost = materialize(per.where(F.col(n) < F.col("of")).select(F.col("id").alias(li), F.col("th").alias(lt), n), "lost")
    lost = lost.hint("merge") if merge else lost
    named = docs.withColumns({i: F.col("doc_id").cast("long"), t: th})
    same = F.col(i).eqNullSafe(F.col(li)) & (F.col(t) == F.col(lt))
    rest = named.join(lost, same, "left_anti").drop(i, t)
    again = lost.where(F.col(n) > 0)
    if again.isEmpty():
        return rest
    return rest.unionByName(named.join(again, same, "left_semi").dropDuplicates([i, t]).drop(i, t))
