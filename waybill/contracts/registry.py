"""The contract registry: versions, activation, compatibility, validation columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.contracts.compiler import canonical_path, collected, facts_of, leftover, loosened, once, violations, with_facts
from waybill.contracts.versions import CONTRACTS, MAPPINGS

REASON_ERRORS, KEPT_ERRORS = 3, 5


@dataclass
class Registry:
    """Known contracts and the active ones, oldest activation first."""

    contracts: dict[str, dict] = field(default_factory=lambda: dict(CONTRACTS))
    mapping_of: dict[str, dict[str, str]] = field(default_factory=lambda: dict(MAPPINGS))
    active: list[str] = field(default_factory=lambda: ["v1"])
    changes: list[dict] = field(default_factory=list)

    def load(self, version: str) -> dict:
        if version not in self.contracts:
            raise KeyError(f"no contract {version}")
        return self.contracts[version]

    def activate(self, version: str, actor: str = "operator", note: str = "", at=None) -> None:
        """Add a version; a second activation changes nothing."""
        self.load(version)
        if version not in self.active:
            self.active.append(version)
            self.changes.append({"changed_at": at, "schema_version": version, "action": "ACTIVATE", "actor": actor, "note": note})

    def mappings(self, version: str) -> dict[str, str]:
        return self.mapping_of.get(version, {})

    def check_compatibility(self, old: str, new: str) -> tuple[bool, list[str]]:
        """Whether readers of ``old`` can read all that ``new`` lets pass, and each path that breaks this.

        A path must stay, stay required if it was, and take no other types, values
        or wider bounds.  A new optional path is fine; a rename is a loss.
        """
        was, now = facts_of(self.load(old)), facts_of(self.load(new))
        lost = {path for path in was if path not in now}
        # A lost container says it for all that it held.
        problems = [f"{path}: gone" for path in lost if path.rpartition(".")[0] not in lost]
        for path in was.keys() & now.keys():
            problems += [f"{path}: {what}" for what in loosened(was[path], now[path])]
        return not problems, sorted(problems)

    def verdicts(self, records: DataFrame, raw: str = "raw_payload") -> DataFrame:
        """``records`` with fields, ok, schema_version, errors, reason and observed_fields.

        Versions are tried newest first and the first match wins.  A match whose
        mapped form breaks v1 doesn't count.  The errors are the newest
        version's, or the last such break.
        """
        newest_first = self.active[::-1]
        facts = with_facts(records, raw, [self.load(v) for v in self.active])
        none = F.array().cast("array<string>")
        observed = F.array_join(F.array_sort(F.coalesce(F.col("_f_root"), F.json_object_keys(raw), none)), ",")
        # Versions agree on most paths; what they agree on is found once.
        rules = {v: violations(self.load(v)) for v in newest_first}
        shared = [r for r in rules[newest_first[0]] if all(r in own for own in rules.values())]
        facts = facts.withColumn("_shared", once(collected(shared)))
        errors_of = {v: collected([r for r in own if r not in shared], "_shared") for v, own in rules.items()}
        out = facts.select(*records.columns, "fields", observed.alias("observed_fields"), *[once(e).alias(f"_errors_{v}") for v, e in errors_of.items()], *[leftover(self.mappings(v)).alias(f"_left_{v}") for v in newest_first])
        ok, broke = {}, {}
        for v in newest_first:
            clean = F.size(f"_errors_{v}") == 0
            broke[v] = F.when(clean, F.col(f"_left_{v}"))
            ok[v] = clean & broke[v].isNull()
        version = F.coalesce(*[F.when(ok[v], F.lit(v)) for v in newest_first])
        break_ = F.coalesce(*[broke[v] for v in self.active])
        errors = F.when(break_.isNotNull(), F.array(break_)).otherwise(F.slice(F.col(f"_errors_{newest_first[0]}"), 1, KEPT_ERRORS))
        out = out.select(*records.columns, "fields", "observed_fields", once(version).alias("_version"), errors.alias("_found"))
        known = F.col("_version").isNotNull()
        out = out.select(*records.columns, "fields", known.alias("ok"), F.coalesce("_version", F.lit("unknown")).alias("schema_version"), F.when(known, none).otherwise(F.col("_found")).alias("errors"), "observed_fields")
        return out.withColumn("reason", F.array_join(F.slice("errors", 1, REASON_ERRORS), "; "))

    def canonical(self, verdicts: DataFrame) -> DataFrame:
        """Accepted rows with the v1 fields as columns, from where each row's version keeps them."""
        fields = F.col("fields")
        known = {name for v in self.active for name in self.load(v)["properties"]}

        def value(path: str, kind: str):
            name, _, rest = path.partition(".")
            return F.try_variant_get(fields[name], f"$.{rest}" if rest else "$", kind) if name in known else F.lit(None).cast(kind)

        def get(target: str, kind: str):
            paths = {version: canonical_path(target, self.mappings(version)) for version in self.active}
            column = value(target, kind)
            for version, path in paths.items():
                if path != target:
                    column = F.when(F.col("schema_version") == version, value(path, kind)).otherwise(column)
            return column

        texts = ["event_id", "event_type", "shipment_id", "vehicle_id", "hub_code", "source", "status"]
        metadata = F.to_json(fields["metadata"])
        return verdicts.where("ok").select(
            *[c for c in verdicts.columns if c not in ("fields", "ok", "errors", "reason", "observed_fields")],
            *[get(x, "string").alias(x) for x in texts],
            once(get("event_ts", "string")).alias("event_ts_text"),
            get("geo.lat", "double").alias("geo_lat"),
            get("geo.lon", "double").alias("geo_lon"),
            get("temperature_c", "double").alias("temperature_c"),
            get("delivery_window.start", "string").alias("window_start_text"),
            get("delivery_window.end", "string").alias("window_end_text"),
            F.when(~metadata.isin("{}", "null"), metadata).alias("metadata_json"),
        )
