"""Versioned tables of Parquet folders behind one manifest.

Every write goes to fresh folders.  A commit publishes all of a batch's tables
at once by creating the next manifest file with an exclusive rename, so readers
see a whole batch or nothing, and a failed batch leaves no trace.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.operators import audit, marts
from waybill.schemas import TABLES, empty

#: Tables whose sizes ``counts`` reports.
COUNTED = ("fact_shipment_events", "fact_shipment_status_current", "hub_shipment", "hub_vehicle", "hub_facility", "sat_shipment_status", "sat_vehicle_telemetry", "late_arrivals", "fact_daily_shipment_recon")


class Store:
    """Tables under ``root`` on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io, self._options = jvm.org.apache.commons.io.IOUtils, jvm
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/_manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest manifest: table to partition value to folder, and the state."""
        found = self.versions()
        if not found:
            return {"version": 0, "tables": {}, "state": {"active": ["v1"], "batches": [], "blocked": [], "quarantine": []}}
        return self._load(found[-1])

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/_manifest/{version}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> dict:
        """Publish ``manifest`` as the next version; fails if another writer was first."""
        version = manifest["version"] + 1
        temp, final = (self._path(f"{self.root}/_manifest/{x}") for x in (f".{uuid.uuid4().hex}", f"{version}.json"))
        out = self._fs.create(temp, True)
        out.write(json.dumps(manifest | {"version": version}).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            raise RuntimeError(f"version {version} of {self.root} was committed by another writer")
        return self.manifest()

    def write(self, table: str, rows: DataFrame) -> dict[str, str]:
        """Write rows to a fresh folder; the folder of each partition value ('' without partitions)."""
        part, path = TABLES[table][2], f"{self.root}/{table}/{uuid.uuid4().hex}"
        columns = rows.select(*[f.name for f in empty(self.spark, table).schema])
        if part is None:
            columns.write.parquet(path)
            return {"": path}
        # Rebalancing deals a day's rows over as many tasks as their size asks for.
        columns.hint("rebalance", part).sortWithinPartitions(part, *TABLES[table][1]).write.partitionBy(part).parquet(path)
        found = self._fs.listStatus(self._path(path))
        return {s.getPath().getName().split("=", 1)[1]: s.getPath().toString() for s in found if s.isDirectory()}

    def read(self, table: str, manifest: dict | None = None, values: list[str] | None = None) -> DataFrame:
        """The table's live rows; with ``values`` only those partitions' files are opened."""
        live = (manifest or self.manifest())["tables"].get(table, {})
        part = TABLES[table][2]
        paths = [p for value, ps in live.items() if values is None or value in values for p in ps]
        nothing = empty(self.spark, table)
        if not paths:
            return nothing
        if part is None:
            return self.spark.read.schema(nothing.schema).parquet(*paths)
        out = None
        for base in sorted({p.rsplit("/", 1)[0] for p in paths}):
            own = [p for p in paths if p.rsplit("/", 1)[0] == base]
            rows = self.spark.read.schema(nothing.schema).option("basePath", base).parquet(*own)
            out = rows if out is None else out.unionByName(rows)
        return out

    @staticmethod
    def replace(manifest: dict, table: str, folders: dict[str, str]) -> None:
        """These partitions now live in these folders alone."""
        manifest["tables"].setdefault(table, {}).update({value: [path] for value, path in folders.items()})

    @staticmethod
    def append(manifest: dict, table: str, folders: dict[str, str]) -> None:
        live = manifest["tables"].setdefault(table, {})
        for value, path in folders.items():
            live[value] = [*live.get(value, []), path]

    def compact(self, manifest: dict, table: str, most: int = 64) -> None:
        """Write a table, or a partition of it, that lies in more than ``most`` folders to one."""
        live = manifest["tables"].get(table, {})
        scattered = [value for value, paths in live.items() if len(paths) > most]
        if scattered:
            folders = self.write(table, self.read(table, manifest, scattered))
            for value in scattered:
                live[value] = [folders[value]]

    def expire(self, manifest: dict, table: str, before: str) -> list[str]:
        """Take partitions older than the day ``before`` out of a table; the values that went."""
        live = manifest["tables"].get(table, {})
        gone = sorted(value for value in live if value < before)
        for value in gone:
            del live[value]
        return gone

    def vacuum(self, keep: int = 10) -> int:
        """Delete manifests but the last ``keep``, and the table folders that none of those names; how many went."""
        versions = self.versions()
        used = set()
        for v in versions[-keep:]:
            for parts in self._load(v)["tables"].values():
                used |= {p.split("/")[-1] if "=" not in p.split("/")[-1] else p.split("/")[-2] for ps in parts.values() for p in ps}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_manifest/{v}.json"), False)
        gone = 0
        for table in TABLES:
            path = self._path(f"{self.root}/{table}")
            for folder in self._fs.listStatus(path) if self._fs.exists(path) else []:
                if folder.getPath().getName() not in used:
                    gone += bool(self._fs.delete(folder.getPath(), True))
        return gone

    # --- questions to the stored tables

    def views(self) -> list[str]:
        """Every table as a temporary view for SQL, and two that are read off others."""
        manifest = self.manifest()
        for table in TABLES:
            self.read(table, manifest).createOrReplaceTempView(table)
        marts.vehicle_assignments(self.read("fact_shipment_events", manifest)).createOrReplaceTempView("fact_vehicle_assignment")
        shipments = self.read("fact_shipment_status_current", manifest)
        shipments.select("shipment_key", "shipment_id", F.col("first_event_ts").alias("first_seen"), F.col("last_event_ts").alias("last_seen")).createOrReplaceTempView("dim_shipment")
        return [*TABLES, "fact_vehicle_assignment", "dim_shipment"]

    def sql(self, statement: str) -> DataFrame:
        self.views()
        return self.spark.sql(statement)

    def counts(self) -> dict[str, int]:
        manifest = self.manifest()
        return {table: self.read(table, manifest).count() for table in COUNTED}

    def null_rate(self, column: str = "delivery_window_start", as_of=None, seconds: int = 60) -> float:
        """The percentage of nulls among events ingested in the last ``seconds``; 0 without events."""
        return float(audit.recent_null_pct(self.read("fact_shipment_events"), column, as_of, seconds).first().null_pct or 0.0)

    def duplicate_check(self) -> int:
        """Event ids that the fact holds more than once: none, always."""
        return audit.duplicates(self.read("fact_shipment_events"), "event_id").count()
