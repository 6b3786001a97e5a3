"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word separators of every text contract here.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: A key that holds more than one row in HOT_PARTS is hot, so fewer than HOT_PARTS keys can be.
HOT_PARTS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="waybill-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; what is left there goes when the driver ends."""
    path = f"{shared_dir(spark)}/waybill-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_clear, spark)
    _FOLDERS.add(path)
    return f"{path}/{name}"


_FOLDERS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _FOLDERS.discard(path)


def _clear(spark: SparkSession) -> None:
    """Delete all folders of this driver, if its session still runs."""
    if spark.sparkContext._jsc is not None:
        for path in list(_FOLDERS):
            _delete(spark, path)


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage with files that outlive any executor.
    """
    path = shared_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in frames:
        _delete(df.sparkSession, df._staged.rsplit("/", 1)[0])


def distilled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, staged; all that it staged on the way is deleted."""
    before = set(_FOLDERS)
    out = stage(make(), name)
    for path in _FOLDERS - before - {out._staged.rsplit("/", 1)[0]}:
        _delete(spark, path)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a file of a table may have when its rows are numbered by their places.
_FILE_ROWS_BITS = 26


def _place(docs: DataFrame) -> Column | None:
    """Each row's place in the Parquet files that ``docs`` is a plain scan of; None if it is something else.

    The place is the row's index in its file, with a hash of the file's path in
    the upper bits.  It doesn't depend on how a reading is cut into tasks, nor on
    the columns read.  Hashes are drawn anew until all files differ.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        if not plan.deterministic():
            return None
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or plan.relation().toString() != "parquet" or "_metadata" in docs.columns:
        return None
    files = docs.inputFiles()
    index, path = (F.col(f"_metadata.{x}") for x in ("row_index", "file_path"))
    if len(files) == 1:
        return index
    # As _metadata writes them.
    named = docs.sparkSession.createDataFrame([(f.replace("file:///", "file:/", 1),) for f in files], "path string")
    for seed in range(16):
        base = lambda c: F.shiftleft(F.shiftright(F.xxhash64(F.lit(seed), c), _FILE_ROWS_BITS), _FILE_ROWS_BITS)  # noqa: E731, B023
        if named.select(base(F.col("path"))).distinct().count() == len(files):
            return F.when(index < 1 << _FILE_ROWS_BITS, base(path).bitwiseOR(index)).otherwise(F.raise_error(F.lit("a file has too many rows to be numbered; give a key")))
    return None


def numbered(docs: DataFrame, *columns: Column | str, key: str | None = None) -> DataFrame:
    """``columns`` of ``docs`` with ``row``: a long of its own for each row, the same at every reading.

    Operators read their input more than once.  ``row`` is the caller's ``key``
    where one is named, or the row's place where ``docs`` is a plain scan of
    Parquet files.  Anything else might deal its rows anew at each reading, so it
    is written once and read from there.
    """
    if key is not None:
        return docs.select(F.col(key).cast("long").alias("row"), *columns)
    place = _place(docs)
    if place is not None:
        return docs.select(place.alias("row"), *columns)
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")


def lean(function):
    """A function over Arrow batches that gives freed memory back to the system when its task ends.

    Spark keeps Python workers, and the allocator keeps what they have freed.
    """

    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def key_of(name: str) -> Column:
    """A key that is never null and keeps null apart from every string."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(name).cast("string")))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column) -> DataFrame:
    """Left-join ``groups`` (one row a key, ``size`` rows each) to ``rows`` whatever the skew.

    Keys with more than 1/HOT_PARTS of all rows number fewer than HOT_PARTS, so
    their groups are broadcast.  Rows that found theirs then go to salted dummy
    keys of the second, shuffled join, in which no key holds more than that
    share.  ``spread`` deals them out.  ``key`` must not be null in ``rows``.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > F.lit(max(total / HOT_PARTS, 8.0)))
    values = [c for c in groups.columns if c != key]
    kind = "binary" if groups.schema[key].dataType == T.BinaryType() else "string"
    hot = F.broadcast(hot.select(F.col(key), F.struct(*values).alias("_hot")))
    found = rows.join(hot, key, "left")
    dummy = F.concat(F.lit("~"), F.pmod(F.hash(spread), F.lit(1 << 20)).cast("string")).cast(kind)
    found = found.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key).cast(kind)).otherwise(dummy))
    rest = groups.select(F.col(key).cast(kind).alias("_key"), F.struct(*values).alias("_cold"))
    found = found.join(rest, "_key", "left").withColumn("_group", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, *[F.col("_group")[v].alias(v) for v in values])
