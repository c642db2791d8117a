"""Helpers shared by the corpus operators.

Intermediate tables are Parquet folders below ``spark.checkpoint.dir`` (the
folder that driver and executors share), so a lost executor costs a re-read.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.session import ensure_checkpoint_dir

# Fixed by the contracts: Java regular expressions of their words.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
FILE_ROWS = 10_000  # of a small table's file
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of Spark 4.1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Each query run here gives its shuffle files back when it ends.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def save(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back.

    ``rows``, about how many there are, keeps a small table from being a file
    for each shuffle partition: every file costs the executor child processes,
    as Hadoop sets a local file's permissions by a command.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = work_path(spark, name)
    with freed_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``save`` wrote and nothing reads again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def few(table: DataFrame, most: int) -> DataFrame:
    """``table``, broadcast if it has ``most`` rows at most."""
    return F.broadcast(table) if table.count() <= most else table


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """``df`` with a gapless 0-based ``rank`` by ``order`` over all its rows.

    Range partitions are sorted and numbered apart and the result is stored
    once (a range partitioning need not come out the same twice); each
    partition's offset is the sum of the row counts before it.
    """
    part, at = unused(df.withColumn(rank, F.lit(0)), "part", "at")
    parts = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn(at, F.monotonically_increasing_id()))
    kept = save(parts.withColumn(part, F.shiftright(at, 33).cast("int"))
                .withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), name)
    return offset(kept, part, F.count(F.lit(1)), rank, F.col(at)).drop(part, at)


def offset(df: DataFrame, part: str, total: Column, out: str, within: Column,
           source: DataFrame | None = None) -> DataFrame:
    """``out`` = ``within`` plus the sum of ``total`` over all smaller ``part``.

    The totals are taken from ``source``, a cheaper table with the same parts.

    There is one total per stored partition: the global running sum orders, and
    the broadcast holds, that many rows and no more.
    """
    t, before = unused(df.withColumn(out, F.lit(0)), "total", "before")
    totals = (df if source is None else source).groupBy(part).agg(total.alias(t))
    before_part = F.coalesce(F.sum(t).over(_all_before(part)), F.lit(0)).cast("long")
    offsets = totals.select(part, before_part.alias(before))
    return df.join(F.broadcast(offsets), part).withColumn(out, (F.col(before) + within).cast("long")).drop(before)


def _all_before(part: str):
    from pyspark.sql import Window
    return Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)


def with_fields(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    """The schema of ``df`` with more fields at its end."""
    return T.StructType(list(df.schema.fields) + [T.StructField(n, k) for n, k in kinds.items()])


def pieces(batch, column: str, units: int, size=len):
    """Cut an Arrow record batch into runs of rows of about ``units`` in all.

    A row is never cut, so a very long text makes a piece of its own.
    """
    at = total = 0
    for i, v in enumerate(batch.column(column)):
        total += size(v.as_py()) if v.is_valid else 0
        if total >= units:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a reused worker otherwise keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)
