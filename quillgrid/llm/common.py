"""What several of the operators share: the shared folder, tables written there, and range buckets."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Paths made within temporary(), innermost last.
_made: list[list[str]] = []


#: Bytes of rows in a batch that goes to Python, where the session has Spark's own default (64 MB).
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Long texts make large batches, held by the executor and its Python worker at once: fewer bytes each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if everything
    runs on this machine, as in tests; else an error, as executors' own disks aren't shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else writes to."""
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/quillgrid/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and lost executors cost no more than their running tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Deletes paths through Spark's own file systems."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes on leaving whatever paths were made within, but for those taken off the list."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        deleted(spark, _made.pop())


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns as a written table; the other tables that make() wrote are deleted."""
    with temporary(spark) as made:
        out = written(make(), name)
        path = made.pop()
    if _made:
        _made[-1].append(path)
    return out


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes; a worker that waits for its next task holds no memory that
    its last one has let go of."""
    bounded_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, so that their heaps shrink to what is in use: a heap that large sorts have grown
    stays as large, and the Python workers of what follows come on top. One small task for each executor; where the
    session forbids the call, nothing changes."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    with suppress(PySparkException):
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and no other letter."""
    return F.translate(text, UPPER, UPPER.lower())


class RangeBuckets:
    """Cuts a table into value ranges of about equal row counts.

    Starts are values that occur, the least one among them; they are literals of the plan, so every use, retry and
    rerun cuts alike. No more than `most` of them are ever held, whatever the table's size. Rows with a null key
    belong to the last bucket.
    """

    def __init__(self, df: DataFrame, key: str, rows_each: int, most: int = 1 << 16):
        n, least = df.agg(F.count(key), F.min(key)).first()
        self.starts: list[int] = []
        if n:
            want = min(most, max(1, -(-n // rows_each)))
            cuts = df.select(F.percentile_approx(key, [i / want for i in range(1, want)], 8 * want)).first()[0] if want > 1 else []
            self.starts = sorted({least, *cuts})

    def _constant(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.starts))), ",").cast("array<bigint>")

    def is_start(self, key: Column, bucket: Column) -> Column:
        """Whether key, which lies in bucket, is the bucket's least."""
        return F.coalesce(F.get(self._constant(), bucket) == key, F.lit(False)) if self.starts else F.lit(False)

    def bucket(self, key: Column) -> Column:
        """The index, from 0, of the range that holds key, by binary search in one constant array."""
        n = len(self.starts)
        if n < 2:
            return F.lit(0)
        starts = self._constant()

        def halve(span: Column, _: Column) -> Column:
            low, high = span["low"], span["high"]
            mid = F.shiftright(low + high, 1)
            return F.when(F.get(starts, mid) <= key, F.struct(mid.alias("low"), high.alias("high"))).otherwise(F.struct(low.alias("low"), mid.alias("high")))

        whole = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
        steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
        return F.when(key.isNull(), F.lit(n - 1)).otherwise(F.aggregate(steps, whole, halve, lambda span: span["low"]))
