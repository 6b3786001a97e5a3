"""The sharded at-least-once event log: JSON lines, a folder a shard."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.functions.keys import partition_key, shard_id
from waybill.schemas import ENVELOPE


def envelope(payloads: DataFrame, shards: int, first_sequence: int = 0) -> DataFrame:
    """Envelopes for ``payloads`` (raw_payload, arrival_ts, seq)."""
    get = lambda f: F.get_json_object("raw_payload", f"$.{f}")
    key = partition_key(get("vehicle_id"), get("hub_code"), get("shipment_id"))
    return payloads.select(
        shard_id(F.coalesce(key, F.lit("")), shards).alias("shard_id"),
        (F.col("seq") + first_sequence).cast("long").alias("sequenceNumber"),
        key.alias("partitionKey"),
        F.date_format("arrival_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("approximateArrivalTimestamp"),
        F.col("raw_payload").alias("data"),
    )


def append_log(payloads: DataFrame, path: str, shards: int, first_sequence: int = 0) -> None:
    """Write records as JSON lines under ``shard_id=…`` folders."""
    rows = envelope(payloads, shards, first_sequence)
    rows.select("shard_id", F.to_json(F.struct("sequenceNumber", "partitionKey", "approximateArrivalTimestamp", "data")).alias("value")).write.partitionBy("shard_id").mode("append").text(path)


def _records(lines: DataFrame) -> DataFrame:
    return lines.select("shard_id", F.from_json("value", ENVELOPE).alias("e")).select("shard_id", F.col("e.sequenceNumber").alias("kinesis_seq"), F.col("e.partitionKey").alias("partition_key"), F.to_timestamp("e.approximateArrivalTimestamp").alias("arrival_ts"), F.col("e.data").alias("raw_payload"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records, once, in order of their sequence numbers within each shard's files."""
    return _records(spark.read.schema("value string, shard_id string").text(path)).repartition("shard_id").sortWithinPartitions("shard_id", "kinesis_seq")


def within_capacity(payloads: DataFrame, capacity: int) -> DataFrame:
    """``payloads`` with ``admitted``: whether a record is among the first ``capacity`` of its second of arrival.

    The window is the stream's, not a shard's.  Seconds are numbered by themselves,
    each of which holds as many records as arrive in it.
    """
    second = Window.partitionBy(F.date_trunc("second", "arrival_ts")).orderBy("arrival_ts", "seq")
    return payloads.withColumn("admitted", F.row_number().over(second) <= capacity)


@dataclass
class PutResult:
    """What became of the records of a put."""

    admitted: int
    throttled: int
    capacity_used_pct: float


def put_records(payloads: DataFrame, path: str, shards: int, per_shard: int, first_sequence: int = 0) -> PutResult:
    """Write the records that the log's capacity admits, and count the others, which the caller must send again."""
    capacity = shards * per_shard
    judged = within_capacity(payloads, capacity).persist()
    try:
        busy = judged.groupBy(F.date_trunc("second", "arrival_ts").alias("second")).agg(F.count_if("admitted").alias("n"), F.count_if(~F.col("admitted")).alias("refused"))
        told = busy.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        if told.n:
            append_log(judged.where("admitted").drop("admitted"), path, shards, first_sequence)
        return PutResult(told.n, told.refused, 100.0 * told.most / capacity)
    finally:
        judged.unpersist()


class Consumer:
    """A consumer group's place in the log: how many records of each shard it has committed.

    A shard's records are numbered by sequence number, so the place means the
    same at every reading as long as producers append rising numbers.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._file, self._io = jvm.org.apache.hadoop.fs.Path(checkpoint), jvm.org.apache.commons.io.IOUtils
        self._fs = self._file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.offsets: dict[str, int] = {}
        if self._fs.exists(self._file):
            stream = self._fs.open(self._file)
            self.offsets = json.loads(self._io.toString(stream, "UTF-8"))
            stream.close()

    def _save(self) -> None:
        out = self._fs.create(self._file, True)
        out.write(json.dumps(self.offsets).encode())
        out.close()

    def _waiting(self) -> DataFrame:
        """Uncommitted records with their number in their shard."""
        records = _records(self.spark.read.schema("value string, shard_id string").text(self.path))
        records = records.withColumn("_number", F.row_number().over(Window.partitionBy("shard_id").orderBy("kinesis_seq", "raw_payload")))
        done = self.spark.createDataFrame([(s, n) for s, n in self.offsets.items()], "shard_id string, _done long")
        return records.join(F.broadcast(done), "shard_id", "left").where(F.col("_number") > F.coalesce("_done", F.lit(0))).drop("_done")

    def read(self, max_records: int = 5000) -> DataFrame:
        """The first uncommitted records of every shard, ``max_records`` in all at most; moves nothing."""
        # Taken by their numbers, every shard's come without a gap.
        return self._waiting().orderBy("_number", "shard_id").limit(max_records).orderBy("kinesis_seq").drop("_number")

    def commit(self, records: DataFrame) -> None:
        """Move past ``records``, which ``read`` gave."""
        for r in records.groupBy("shard_id").count().collect():  # one row a shard
            self.offsets[r.shard_id] = self.offsets.get(r.shard_id, 0) + r["count"]
        self._save()

    def rewind(self, records: int = 500) -> None:
        """Go back by ``records`` in all, an equal part in each shard: they are delivered again."""
        each = max(1, records // max(1, len(self.offsets)))
        self.offsets = {shard: max(0, n - each) for shard, n in self.offsets.items()}
        self._save()

    def lag(self) -> int:
        """Records written and not committed."""
        return self._waiting().count()


def stream_log(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """The log as a stream; the checkpoint keeps the consumer group's offsets."""
    return _records(spark.readStream.schema("value string, shard_id string").option("maxFilesPerTrigger", max_files).text(path))


def throughput(records: DataFrame, at: str, shards: int, per_shard: int) -> DataFrame:
    """Records a second against the log's capacity, and how many a throttle would refuse."""
    capacity = shards * per_shard
    out = records.groupBy(F.date_trunc("second", F.col(at)).cast("timestamp_ntz").alias("second")).agg(F.count(F.lit(1)).alias("records"))
    return out.select("second", "records", F.lit(capacity).cast("long").alias("capacity"), F.greatest(F.col("records") - capacity, F.lit(0)).cast("long").alias("throttled"))


def lag(progress: dict | str) -> int:
    """Files that a streaming query over the log has listed and not yet read, from its last progress."""
    progress = json.loads(progress) if isinstance(progress, str) else progress
    return sum(int((s.get("metrics") or {}).get("numFilesOutstanding") or 0) for s in progress.get("sources", []))


__all__ = ["Consumer", "PutResult", "append_log", "envelope", "lag", "put_records", "read_log", "stream_log", "throughput", "within_capacity"]
