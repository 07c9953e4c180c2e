"""Shared helpers: the shared folder, staged tables, prefix sums and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIEVE = 1 << 20
BATCH_BYTES = 8 << 20

_PACKAGE = Path(__file__).resolve().parents[1]
_own_dir: str | None = None
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they start.

    Workers that inherit a PYTHONPATH with the repository need nothing; for
    others a zip of the package goes out through Spark's file server, once per
    application. Batches for Python are held to BATCH_BYTES, unless the
    session has a limit of its own, so that the memory of a task does not
    depend on how long its texts are.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":  # as Spark sets it
        spark.conf.set(limit, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped or str(_PACKAGE.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp(prefix="ship")  # read by the driver's own file server only
    target = f"{folder}/{_PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def trim_heaps(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage and give free heap back to the system, which they do not do by themselves while tasks run.

    One small task for each executor; which of them it reaches is up to the
    scheduler, and no result depends on it.
    """
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # without the driver
    spark.range(0, executors, 1, executors).select(F.expr("reflect('java.lang.System', 'gc')")).collect()  # a row for each


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local session, whose
    executors are this process; other sessions are refused, because their
    executors would not see it.
    """
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="shared")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only, and
    rows that came from a partition-dependent pass never change afterwards.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def sieve(ids: DataFrame) -> DataFrame:
    """(word, mask): a bitmap of 64 * SIEVE bits with that of every id set; never more than SIEVE rows, whatever the number of ids."""
    bit = ids.select(F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(64 * SIEVE)).alias("bit"))
    return bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))


def sifted(df: DataFrame, column: str, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` split in rows that may be, and rows that cannot be among the sieve's ids, without a shuffle."""
    word, mask = ("_".join([x, *df.columns]) for x in ("word", "mask"))  # no column of the input has these names
    bit = F.pmod(F.xxhash64(F.col(f"`{column}`").cast("long")), F.lit(64 * SIEVE))
    both = df.withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(words.toDF(word, mask)), word, "left")  # at most SIEVE rows of 16 bytes
    set_ = F.coalesce(F.getbit(F.col(f"`{mask}`"), (bit % 64).cast("int")) == 1, F.lit(False))
    own = [F.col(f"`{c}`") for c in df.columns]
    return both.where(set_).select(*own), both.where(~set_).select(*own)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_total(df: DataFrame, order: list[str], weight: str, out: str, name: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows that come before in ``order``.

    A distributed exclusive prefix sum. Rows are range-partitioned and sorted
    on the full order (which must tell all rows apart that matter), each range
    adds up on its own while it is staged, and one total per range, never more
    than the number of shuffle partitions, is added up on the driver and
    broadcast back. No range needs another range's rows.
    """
    spark = df.sparkSession
    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_part", T.LongType())])

    def add(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        me, done = TaskContext.get().partitionId(), 0
        for b in batches:
            w = np.asarray(b.column(b.schema.get_field_index(weight)), dtype=np.int64)
            upto = np.cumsum(w)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(w), me, np.int32)), pa.array(done + upto - w)], names=[*b.schema.names, "_range", "_part"])
            done += int(upto[-1]) if len(w) else 0

    ranged = staged(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(add, schema), name)
    totals = ranged.groupBy("_range").agg(F.sum(weight).alias("total")).orderBy("_range").collect()  # a row per range
    rows, base = [], 0
    for r in totals:
        rows.append((r["_range"], base))
        base += r["total"]
    kind = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_base", T.LongType())])
    bases = F.broadcast(spark.createDataFrame(rows, kind))  # as many rows as ranges
    return ranged.join(bases, "_range").withColumn(out, F.col("_base") + F.col("_part")).drop("_range", "_part", "_base")
