"""Shared plumbing of the training-data operators: scratch tables, global order, skew-proof lookups."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Logical buckets over which rows of one hot key are spread before a lookup.
SPREAD = 64
#: Rows and bytes of one Arrow batch: keeps a Python worker's memory flat for long texts.
ARROW_ROWS, ARROW_BYTES = 4000, 6 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive (long texts would make 10,000 rows too many)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/loomwork-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a worker finds a path of the shared folder."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def give_back() -> None:
    """Return this process's freed memory to the system: Arrow's pool and, under glibc, the heap, which else stays as large as it ever was."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def lean(run):
    """``run`` for mapInArrow, with freed memory given back when a task ends: its worker stays, idle, beside the executor's later tasks."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return trimmed


def batches_of(df: DataFrame, run) -> DataFrame:
    """mapInArrow over whole rows with the schema as it is; by place, as names may hold dots."""
    own = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return own.mapInArrow(lean(run), own.schema).toDF(*df.columns)


def row_keys(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a whole row: rows that differ in any column differ in them, but for one chance in 2**128."""
    own = []
    for c, field in zip(named(df), df.schema.fields):
        plain = F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString() else c
        own += [c.isNull(), plain]  # the hash passes over nulls
    return F.xxhash64(*own), F.xxhash64(F.lit("second"), *own)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_order(df: DataFrame, order: Sequence[str], size: str | None = None) -> DataFrame:
    """Add ``_rank`` (0-based position in the global order) and, with ``size``, ``_before`` (sum of sizes before the row).

    A range partitioning, one table of per-partition totals (as many rows as partitions, so its broadcast is
    bounded) and a window inside each range. Ties, also whole repeated rows, are cut by the row's place in the
    input, so one hot value can't pile up in a range. The ranges are written once, so all passes see the same ones.
    """
    spark = df.sparkSession
    n = partitions(spark)
    amount = F.coalesce(F.col(size), F.lit(0)).cast("long") if size else F.lit(0).cast("long")
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
        .drop("_tie")
    )
    ranged = materialise(ranged, "ranged")
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("_part").orderBy("_seq")
    out = ranged.join(F.broadcast(offsets), "_part").withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_n0"))
    if size:
        out = out.withColumn("_before", F.sum(amount).over(inside) - amount + F.col("_s0"))
    return out.drop("_part", "_seq", "_n0", "_s0")


def spread_of(*columns: Column) -> Column:
    """A row's logical bucket, a function of the row alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(SPREAD)).cast("int")


def lookup(rows: DataFrame, keys: Sequence[str], table: DataFrame, spread: str) -> DataFrame:
    """Left join of ``rows`` to a table that is unique on ``keys`` (no nulls among them), safe for hot keys.

    First the distinct (bucket, key) pairs meet the table, so that a key held by a third of all rows counts
    ``SPREAD`` times at most; then rows meet those pairs on bucket and key, which spreads the hot key.
    """
    keys = list(keys)
    pairs = rows.select(spread, *keys).distinct().join(table, keys, "left")
    return rows.join(pairs, [spread, *keys], "left")
