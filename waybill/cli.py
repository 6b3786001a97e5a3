"""Command line: run a simulated feed, print the cost model, run the consumer queries."""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from waybill.config import Config
from waybill.costs import CostModel
from waybill.plans import consumer
from waybill.session import session
from waybill.sources.generator import generate, plan_incidents
from waybill.streaming.pipeline import Pipeline
from waybill.streaming.replay import remediate, replay


def cmd_run(args) -> None:
    """A feed in batches of ten seconds, with two drifts that are remedied and replayed."""
    spark = session()
    config = Config.from_env()
    config = replace(config, **{name: value for name, value in (("seed", args.seed), ("events_per_second", args.eps), ("duration_seconds", args.duration), ("data_dir", args.data_dir)) if value is not None})
    if args.fresh:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(config.data_dir)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    pipeline = Pipeline(spark, config.data_dir, config)
    plan = plan_incidents(config.seed, config.duration_seconds, args.drift_at)
    second_at = args.second_drift_at if args.second_drift_at is not None else plan["first_at"] + 20 + plan["second_after"]
    start, drift, seen = datetime.now(timezone.utc) - timedelta(seconds=config.duration_seconds), {}, 0
    pipeline.bootstrap(start, (f"{start:%Y}-01-01", f"{start:%Y}-12-31"))
    pending = [(plan["first_at"], "v2", plan["sources"][0], "window_rename"), (second_at, "v3", plan["sources"][1], "geo_move")]
    for second in range(0, config.duration_seconds, 10):
        for at, _, source, kind in pending:
            if second >= at:
                drift[source] = sorted({*drift.get(source, []), kind})
        at = start + timedelta(seconds=second + 10)
        records = generate(spark, 10 * config.events_per_second, start + timedelta(seconds=second), config, drift, seen)
        seen += 10 * config.events_per_second
        print(pipeline.process(records.withColumnRenamed("seq", "kinesis_seq"), f"run-{start:%Y%m%d%H%M%S}-{second}", at))
        for began, version, _, _ in pending:
            if second >= began + 10 and version not in pipeline.registry.active:
                remediate(pipeline, version, at)
                print(replay(pipeline, f"replay-{start:%Y%m%d%H%M%S}-{version}", at))
    for alert in pipeline.monitors.recent(6):
        print(alert.severity, alert.monitor, alert.message)
    print(pipeline.store.counts(), "duplicates:", pipeline.store.duplicate_check())


def cmd_costs(args) -> None:
    for name, now, proposed in CostModel(args.reprocess_ratio).render_rows():
        print(f"{name:32} {now:>10} {proposed:>10}")


def cmd_query(args) -> None:
    store = Pipeline(session(), args.data_dir).store
    if args.sql:
        store.sql(args.sql).show(100, truncate=False)
        return
    snapshot, facts = store.read("fact_shipment_status_current"), store.read("fact_shipment_events")
    consumer.ops_status(snapshot).show()
    consumer.ops_freshness(snapshot, datetime.now(timezone.utc).replace(tzinfo=None)).show()
    consumer.fin_top_hubs(store.read("fact_daily_shipment_recon")).show()
    consumer.rel_versions(facts).show()
    consumer.rel_alerts(store.read("alerts")).show()
    consumer.ds_cold_chain(store.read("sat_vehicle_telemetry")).show()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="waybill")
    commands = parser.add_subparsers(required=True)
    run = commands.add_parser("run")
    # What isn't given comes from WAYBILL_* variables, else from the defaults.
    run.add_argument("--duration", type=int)
    run.add_argument("--eps", type=int)
    run.add_argument("--data-dir")
    run.add_argument("--seed", type=int)
    run.add_argument("--drift-at", type=float, help="second of the first drift")
    run.add_argument("--second-drift-at", type=float, help="second of the second drift")
    run.add_argument("--fresh", action="store_true", help="delete the data folder first")
    run.set_defaults(go=cmd_run)
    costs = commands.add_parser("costs")
    costs.add_argument("--reprocess-ratio", type=float, default=30.0)
    costs.set_defaults(go=cmd_costs)
    query = commands.add_parser("query")
    query.add_argument("--data-dir", default="data")
    query.add_argument("--sql", help="a statement over the stored tables, in place of the reports")
    query.set_defaults(go=cmd_query)
    args = parser.parse_args(argv)
    args.go(args)


if __name__ == "__main__":
    main()
