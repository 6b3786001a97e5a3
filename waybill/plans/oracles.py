"""SQL for DuckDB with the queries' results, written independently of the operators."""

from __future__ import annotations

from waybill.plans.queries import LATEST_INGEST, SPLIT
from waybill.sources.adaptor import SHIPMENT_EVENTS, V2_FROM, V3_FROM

SE = SHIPMENT_EVENTS.format(events="events")
_DEDUP = "row_number() OVER (PARTITION BY event_id ORDER BY ingest_ts DESC, payload_hash, kinesis_seq) = 1"

#: se: all deliveries; ev: one a event; stg: one a event within 24 hours; sh: payload shape; vd: verdicts under all contracts.
BASE = f"""
WITH se AS ({SE}),
ev AS (SELECT * FROM se QUALIFY {_DEDUP}),
stg AS (SELECT * FROM se WHERE event_ts >= ingest_ts - INTERVAL '24' HOUR QUALIFY {_DEDUP}),
sh AS (
  SELECT *, kinesis_seq % 500 = 3 AS stray, geo_lat IS NOT NULL AS has_geo, delivery_window_start IS NOT NULL AS has_window,
         source = 'partner_courier_api' AND event_date >= DATE '{V2_FROM}' AS is2,
         source = 'driver_mobile_app' AND event_date >= DATE '{V3_FROM}' AS is3
  FROM ev
), vd AS (
  SELECT *, CASE WHEN stray THEN 'unknown'
                 WHEN (is3 OR NOT has_geo) AND (NOT is2 OR NOT has_window) THEN 'v3'
                 WHEN (NOT is3 OR NOT has_geo) AND (is2 OR NOT has_window) THEN 'v2'
                 ELSE 'v1' END AS ver
  FROM sh
), v1 AS (
  SELECT *, concat_ws('', CASE WHEN is2 AND has_window THEN 'd' END, CASE WHEN is3 AND has_geo THEN 'p' END, CASE WHEN stray THEN 's' END) AS extra FROM sh
)
"""

_DELTA = """
SELECT md5(shipment_id) AS shipment_key, shipment_id, max(event_ts) AS last_event_ts,
       min(CASE WHEN status = 'pickup' THEN event_ts END) AS pickup_ts,
       min(CASE WHEN status = 'in_transit' THEN event_ts END) AS in_transit_ts,
       min(CASE WHEN status = 'exception' THEN event_ts END) AS exception_ts,
       min(CASE WHEN status = 'delivered' THEN event_ts END) AS delivered_ts,
       arg_max(status, (event_ts, event_id)) FILTER (WHERE status IS NOT NULL) AS current_status,
       arg_max(vehicle_id, (event_ts, event_id)) FILTER (WHERE vehicle_id IS NOT NULL) AS last_vehicle_id,
       arg_max(hub_code, (event_ts, event_id)) FILTER (WHERE hub_code IS NOT NULL) AS last_hub_code,
       arg_max(geo_lat, (event_ts, event_id)) FILTER (WHERE geo_lat IS NOT NULL) AS last_geo_lat,
       arg_max(geo_lon, (event_ts, event_id)) FILTER (WHERE geo_lon IS NOT NULL) AS last_geo_lon,
       arg_max(delivery_window_start, (event_ts, event_id)) FILTER (WHERE delivery_window_start IS NOT NULL) AS delivery_window_start,
       arg_max(delivery_window_end, (event_ts, event_id)) FILTER (WHERE delivery_window_end IS NOT NULL) AS delivery_window_end,
       count(*) AS event_count
FROM stg GROUP BY shipment_id
"""
_SNAP = f"snap AS (SELECT *, coalesce(delivered_ts > delivery_window_end, false) AS is_window_breached FROM ({_DELTA}))"


def _recon(where: str = "true") -> str:
    """Daily figures over the staged rows that satisfy ``where``, by their own snapshot."""
    return f"""
SELECT event_date AS recon_date, coalesce(hub, 'UNASSIGNED') AS hub_code, count(*) AS shipments, CAST(sum(n) AS BIGINT) AS events,
       count(*) FILTER (WHERE dl) AS delivered, count(*) FILTER (WHERE ex) AS exceptions, count(*) FILTER (WHERE br) AS window_breaches
FROM (
  SELECT event_date, shipment_id, count(*) AS n, coalesce(bool_or(status = 'delivered'), false) AS dl, coalesce(bool_or(status = 'exception'), false) AS ex,
         min(hub) AS hub, bool_or(br) AS br
  FROM (SELECT * FROM stg WHERE {where})
  JOIN (
    SELECT shipment_id, arg_max(hub_code, (event_ts, event_id)) AS hub,
           coalesce(min(CASE WHEN status = 'delivered' THEN event_ts END) > arg_max(delivery_window_end, (event_ts, event_id)) FILTER (WHERE delivery_window_end IS NOT NULL), false) AS br
    FROM stg WHERE {where} GROUP BY shipment_id
  ) USING (shipment_id)
  GROUP BY event_date, shipment_id
) GROUP BY 1, 2
"""


_BATCH = f"CASE WHEN event_date < DATE '{SPLIT}' THEN 1 ELSE 2 END"


def _hub(column: str, key: str, extra: str = "") -> str:
    return f"""{BASE}
SELECT md5({column}) AS {key}, {column}, {extra} min(source) AS rec_src
FROM (SELECT *, {_BATCH} AS batch, min({_BATCH}) OVER (PARTITION BY {column}) AS first_batch FROM stg WHERE {column} IS NOT NULL)
WHERE batch = first_batch GROUP BY {column}"""


def _fixed(column: str) -> str:
    return f"coalesce(CAST(CAST({column} AS DECIMAL(10,5)) AS VARCHAR), '')"


#: told: what the first contract says of payloads that are soiled in one of seven ways.
_ERRORS = """, told AS (
  SELECT *, kinesis_seq % 8 AS kind,
         CASE kinesis_seq % 8 WHEN 1 THEN '$.event_type: not an accepted value: lost' WHEN 2 THEN '$.event_id: shorter than 8' WHEN 3 THEN '$: missing field ' || chr(39) || 'shipment_id' || chr(39)
              WHEN 4 THEN '$: expected object, found no JSON' WHEN 5 THEN '$.source: expected string, found number'
              WHEN 6 THEN '$.event_id: shorter than 8; $.event_type: not an accepted value: lost' ELSE '' END AS reason,
         CASE kinesis_seq % 8 WHEN 6 THEN 2 WHEN 7 THEN 0 WHEN 0 THEN 0 ELSE 1 END AS n_errors
  FROM ev WHERE source IN ('telematics_gateway', 'hub_scanner_net') AND kinesis_seq % 500 <> 3
)
"""



def oracle_sql() -> dict[str, str]:
    sql = {
        "scan_bronze": "SELECT * EXCLUDE (metadata_json) FROM se",
        "bronze_rows": "SELECT event_id, event_type, event_ts, ingest_ts, event_date, shipment_id, vehicle_id, hub_code, source, status, geo_lat, geo_lon, delivery_window_start, delivery_window_end, ver AS schema_version, kinesis_seq FROM vd WHERE ver <> 'unknown'",
        "bronze_layout": "SELECT strftime(ingest_ts, '%Y-%m-%d') AS dt, strftime(ingest_ts, '%H') AS hr, count(*) AS n, min(event_id) AS first_event FROM vd WHERE ver <> 'unknown' GROUP BY 1, 2",
        "bronze_row_count": "SELECT count(*) AS n FROM se",
        "stage_bounded": "SELECT event_id, event_ts, ingest_ts, payload_hash FROM se WHERE ingest_ts > TIMESTAMP '2024-01-10 00:00:00' AND event_ts >= ingest_ts - INTERVAL '24' HOUR",
        "stage_dedup": "SELECT * FROM stg",
        "late_arrivals": "SELECT event_id, shipment_id, event_ts, ingest_ts, date_diff('minute', event_ts, ingest_ts) / 60.0 AS age_hours, 'beyond 24h watermark - requires partition restatement' AS reason FROM se WHERE event_ts < ingest_ts - INTERVAL '24' HOUR",
        "late_within_window": "SELECT event_id, event_ts, ingest_ts FROM stg WHERE event_ts < ingest_ts - INTERVAL '5' MINUTE",
        "batch_stats": """SELECT r AS records_in, s AS staged, b AS beyond_watermark, l AS late_arrivals, greatest(r - s - b, 0) AS duplicates_suppressed
FROM (SELECT count(*) AS r, count(*) FILTER (WHERE event_ts < ingest_ts - INTERVAL '24' HOUR) AS b FROM se), (SELECT count(*) AS s, count(*) FILTER (WHERE event_ts < ingest_ts - INTERVAL '5' MINUTE) AS l FROM stg)""",
        "surrogate_keys": "SELECT event_id, md5(shipment_id) AS shipment_key, md5(vehicle_id) AS vehicle_key, md5(hub_code) AS facility_key, sha1(upper(trim(shipment_id)) || '||' || upper(trim(hub_code))) AS trimmed_key FROM stg",
        "partition_key": "SELECT event_id, coalesce(nullif(vehicle_id, ''), nullif(hub_code, ''), shipment_id) AS partition_key FROM se",
        "shard_distribution_md5": "SELECT substr(md5(coalesce(nullif(vehicle_id, ''), nullif(hub_code, ''), shipment_id)), 1, 1) AS shard, count(*) AS n FROM se GROUP BY 1",
        "throughput_windows": "SELECT date_trunc('second', ingest_ts) AS second, count(*) AS records, CAST(1 AS BIGINT) AS capacity, greatest(count(*) - 1, 0) AS throttled FROM se GROUP BY 1",
        "contract_verdicts": "SELECT event_id, ver <> 'unknown' AS ok, ver AS schema_version, CASE WHEN ver <> 'unknown' THEN '' ELSE '$: unexpected field ''' || concat_ws(''', ''', CASE WHEN is2 AND has_window THEN 'delivery' END, CASE WHEN NOT is3 AND has_geo THEN 'geo' END, 'surprise_column') || '''' END AS reason FROM vd",
        "canonical_events": "SELECT event_id, ver AS schema_version, geo_lat, geo_lon, delivery_window_start, delivery_window_end, replace(metadata_json, ' ', '') AS metadata_json FROM vd WHERE ver <> 'unknown'",
        "quarantine_rows": "SELECT event_id, source, ingest_ts, '$: unexpected field ''' || concat_ws(''', ''', CASE WHEN is2 AND has_window THEN 'delivery' END, CASE WHEN NOT is3 AND has_geo THEN 'geo' END, 'surprise_column') || '''' AS rejection_reason, 'v1,v2,v3' AS expected_schema_version, CASE WHEN vehicle_id IS NOT NULL THEN 'vehicle_id' WHEN temperature_c IS NOT NULL THEN 'temperature_c' ELSE 'surprise_column' END AS last_field FROM vd WHERE ver = 'unknown'",
        "accepted_vs_rejected": "SELECT ver <> 'unknown' AS ok, ver AS schema_version, count(*) AS n FROM vd GROUP BY ALL",
        "violations_by_field": "SELECT '$' AS field, count(*) AS n FROM v1 WHERE extra <> '' HAVING count(*) > 0",
        "null_counts": "SELECT count(*) AS accepted, count(*) FILTER (WHERE delivery_window_start IS NULL) AS null_delivery_window_start, count(*) FILTER (WHERE delivery_window_end IS NULL) AS null_delivery_window_end, count(*) FILTER (WHERE shipment_id IS NULL) AS null_shipment_id FROM vd WHERE ver <> 'unknown'",
        "replay_candidates": "SELECT event_id, ver <> 'unknown' AS recovered, ver AS schema_version FROM vd WHERE stray OR (is2 AND has_window) OR (is3 AND has_geo)",
        "audit_checks": """, one AS (
  SELECT kinesis_seq, CASE WHEN kinesis_seq % 401 <> 0 THEN event_id END AS event_id, CASE WHEN kinesis_seq % 211 <> 3 THEN shipment_id END AS shipment_id,
         CASE WHEN kinesis_seq % 173 = 5 THEN 'lost' ELSE status END AS status,
         CASE WHEN kinesis_seq % 307 = 9 THEN 90.5 ELSE geo_lat END AS geo_lat, CASE WHEN kinesis_seq % 283 = 4 THEN -180.5 ELSE geo_lon END AS geo_lon FROM stg
), soiled AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE kinesis_seq % 503 = 11)
SELECT 'event_id not null' AS check_name, count(*) FILTER (WHERE event_id IS NULL) AS n FROM soiled
UNION ALL SELECT 'shipment_id not null', count(*) FILTER (WHERE shipment_id IS NULL) FROM soiled
UNION ALL SELECT 'event_id unique', count(*) FROM (SELECT event_id FROM soiled WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) > 1)
UNION ALL SELECT 'status in accepted set', count(*) FILTER (WHERE status NOT IN ('pickup', 'in_transit', 'exception', 'delivered')) FROM soiled
UNION ALL SELECT 'geo within bounds', count(*) FILTER (WHERE geo_lat NOT BETWEEN -90 AND 90 OR geo_lon NOT BETWEEN -180 AND 180) FROM soiled""",
        "audit_null_rate": "SELECT count(*) AS rows, count(*) FILTER (WHERE delivery_window_start IS NULL) AS null_windows, round(CAST(100.0 * count(*) FILTER (WHERE delivery_window_start IS NULL) / count(*) AS DOUBLE), 6) AS null_pct FROM stg",
        "duplicate_check": "SELECT event_id, count(*) AS n FROM se GROUP BY 1 HAVING count(*) > 1",
        "table_counts": f"""SELECT 'fact_shipment_events' AS table_name, count(*) AS n FROM stg
UNION ALL SELECT 'fact_shipment_status_current', count(DISTINCT shipment_id) FROM stg
UNION ALL SELECT 'hub_shipment', count(DISTINCT shipment_id) FROM stg
UNION ALL SELECT 'hub_vehicle', count(DISTINCT vehicle_id) FROM stg
UNION ALL SELECT 'hub_facility', count(DISTINCT hub_code) FROM stg
UNION ALL SELECT 'sat_shipment_status', count(*) FROM (SELECT DISTINCT shipment_id, event_ts, status, {_fixed('geo_lat')}, {_fixed('geo_lon')}, delivery_window_start FROM stg WHERE event_type IN ('status', 'hub_scan'))
UNION ALL SELECT 'late_arrivals', count(*) FROM se WHERE event_ts < ingest_ts - INTERVAL '24' HOUR""",
        "merge_events": f"""SELECT event_id, event_date, event_ts, ingest_ts, md5(shipment_id) AS shipment_key, md5(vehicle_id) AS vehicle_key, md5(hub_code) AS facility_key, event_type,
CASE WHEN fix THEN 'delivered' ELSE status END AS status, geo_lat, geo_lon, temperature_c, delivery_window_start, delivery_window_end, source, 'v1' AS schema_version,
CASE WHEN fix THEN md5(payload_hash || 'c') ELSE payload_hash END AS payload_hash,
CASE WHEN event_date >= DATE '{SPLIT}' THEN 'insert' WHEN fix THEN 'update' ELSE 'keep' END AS merge_action
FROM (SELECT *, event_date < DATE '{SPLIT}' AND kinesis_seq % 333 = 5 AS fix FROM stg)""",
        "vault_link": f"""SELECT md5(shipment_id || '||' || coalesce(vehicle_id, '') || '||' || coalesce(hub_code, '')) AS link_hk, md5(shipment_id) AS shipment_hk, md5(vehicle_id) AS vehicle_hk, md5(hub_code) AS facility_hk, min(source) AS rec_src
FROM (SELECT *, {_BATCH} AS batch, min({_BATCH}) OVER (PARTITION BY shipment_id, vehicle_id, hub_code) AS first_batch FROM stg) WHERE batch = first_batch GROUP BY shipment_id, vehicle_id, hub_code""",
        "vault_sat_status": f"""SELECT md5(shipment_id) AS shipment_hk, event_ts, hash_diff, status, geo_lat, geo_lon, delivery_window_start, delivery_window_end, 'v1' AS schema_version, source AS rec_src
FROM (SELECT *, md5(coalesce(status, '') || '||' || {_fixed('geo_lat')} || '||' || {_fixed('geo_lon')} || '||' || coalesce(CAST(delivery_window_start AS VARCHAR), '')) AS hash_diff FROM stg WHERE event_type IN ('status', 'hub_scan'))
QUALIFY row_number() OVER (PARTITION BY shipment_id, event_ts, hash_diff ORDER BY event_id) = 1""",
        "vault_sat_telemetry": f"""SELECT md5(vehicle_id) AS vehicle_hk, event_ts, hash_diff, temperature_c, geo_lat, geo_lon, source AS rec_src
FROM (SELECT *, md5({_fixed('temperature_c')} || '||' || {_fixed('geo_lat')} || '||' || {_fixed('geo_lon')}) AS hash_diff FROM stg WHERE vehicle_id IS NOT NULL AND event_type IN ('gps_ping', 'temperature'))
QUALIFY row_number() OVER (PARTITION BY vehicle_id, event_ts, hash_diff ORDER BY event_id) = 1""",
        "vault_sat_metadata": "SELECT event_id, metadata_json AS payload, source AS rec_src FROM stg WHERE metadata_json IS NOT NULL",
        "ops_delta_status": _DELTA,
        "ops_status_current": f"SELECT *, coalesce(delivered_ts > delivery_window_end, false) AS is_window_breached FROM ({_DELTA})",
        "recon_daily": _recon(),
        "recon_restatement": f"""SELECT n.*, CASE WHEN o.events <> n.events THEN TIMESTAMP '2024-02-01 00:00:00' END AS restated_at, CASE WHEN o.events <> n.events THEN 'late arrivals or replay applied' END AS restatement_note
FROM ({_recon()}) n LEFT JOIN ({_recon('kinesis_seq % 10 <> 0')}) o USING (recon_date, hub_code)""",
        "dim_date": "SELECT CAST(d AS DATE) AS date_key, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend FROM range(TIMESTAMP '2026-01-01', TIMESTAMP '2027-01-01', INTERVAL 1 DAY) t(d)",
        "vehicle_assignments": """SELECT md5(vehicle_id) AS vehicle_key, md5(shipment_id) AS shipment_key, md5(hub_code) AS facility_key, event_ts AS valid_from, lead(event_ts) OVER w AS valid_to, lead(event_ts) OVER w IS NULL AS is_current
FROM (SELECT *, lag(shipment_id) OVER (PARTITION BY vehicle_id ORDER BY event_ts, event_id) AS was FROM stg WHERE vehicle_id IS NOT NULL) WHERE was IS NULL OR was <> shipment_id WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_ts, event_id)""",
        "monitor_canary": """SELECT *, coalesce(points >= 5 AND (baseline - share) / CASE WHEN sigma = 0 THEN 1e-6 ELSE sigma END > 3, false) AS fired FROM (
SELECT hour, share, count(share) OVER w AS points, round(avg(share) OVER w, 6) AS baseline, round(stddev_pop(share) OVER w, 6) AS sigma
FROM (SELECT date_trunc('hour', ingest_ts) AS hour, round(CAST(count(delivery_window_start) * 100.0 / count(*) AS DOUBLE), 6) AS share FROM stg GROUP BY 1)
WINDOW w AS (ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))""",
        "monitor_violation": """SELECT *, CASE WHEN violation_pct > 5 THEN 'CRITICAL' WHEN violation_pct > 0.5 THEN 'WARNING' END AS severity FROM (
SELECT CAST(ingest_ts AS DATE) AS day, source, count(*) AS total, count(*) FILTER (WHERE extra <> '') AS quarantined, round(CAST(count(*) FILTER (WHERE extra <> '') * 100.0 / count(*) AS DOUBLE), 6) AS violation_pct FROM v1 GROUP BY 1, 2)""",
        "null_rate_recent": f"SELECT count(*) AS n, round(CAST(count(*) FILTER (WHERE delivery_window_start IS NULL) * 100.0 / nullif(count(*), 0) AS DOUBLE), 6) AS null_pct FROM stg WHERE ingest_ts > TIMESTAMP '{LATEST_INGEST}' - INTERVAL '60' MINUTE AND ingest_ts <= TIMESTAMP '{LATEST_INGEST}'",
        "recon_incremental": _recon(f"(kinesis_seq % 7 <> 0 OR event_date >= DATE '{SPLIT}')"),
        "dim_vehicle": "SELECT md5(vehicle_id) AS vehicle_key, vehicle_id, min(event_ts) AS first_seen, max(event_ts) AS last_seen, min(source) AS source FROM stg WHERE vehicle_id IS NOT NULL GROUP BY vehicle_id",
        "dim_facility": "SELECT md5(hub_code) AS facility_key, hub_code, split_part(hub_code, '-', 2) AS country, min(event_ts) AS first_seen, max(event_ts) AS last_seen FROM stg GROUP BY hub_code",
        "monitor_null_rate": """, h AS (SELECT date_trunc('hour', ingest_ts) AS hour, count(*) AS n, count(*) FILTER (WHERE delivery_window_start IS NULL) AS a, count(*) FILTER (WHERE delivery_window_end IS NULL) AS b, count(*) FILTER (WHERE shipment_id IS NULL) AS c FROM stg GROUP BY 1),
l AS (SELECT hour, n, 'delivery_window_start' AS column_name, a AS nulls FROM h UNION ALL SELECT hour, n, 'delivery_window_end', b FROM h UNION ALL SELECT hour, n, 'shipment_id', c FROM h)
SELECT hour, column_name, round(CAST(nulls * 100.0 / n AS DOUBLE), 6) AS null_pct, nulls * 100 > 15 * n AS alerts FROM l""",
        "monitor_freshness": """, w AS (SELECT ingest_ts, date_diff('microsecond', lag(ingest_ts) OVER (PARTITION BY CAST(ingest_ts AS DATE) ORDER BY ingest_ts), ingest_ts) AS waited_micros FROM (SELECT DISTINCT ingest_ts FROM stg))
SELECT ingest_ts, waited_micros FROM w WHERE waited_micros > 120000000""",
        "monitor_cooldown": """, f AS (SELECT DISTINCT source AS key, ingest_ts AS t FROM stg WHERE status = 'exception'),
k AS (
  SELECT key, min(t) AS t FROM f GROUP BY key
  UNION ALL
  SELECT key, nxt FROM (SELECT k.key, (SELECT min(f.t) FROM f WHERE f.key = k.key AND f.t >= k.t + INTERVAL '1' HOUR) AS nxt FROM k) WHERE nxt IS NOT NULL
)
SELECT key, t AS alerted_at FROM k""",
        "load_watermark": "SELECT batch, max(newest) OVER (ORDER BY batch) AS watermark_ts FROM (SELECT kinesis_seq // 100 AS batch, max(ingest_ts) AS newest FROM stg GROUP BY 1)",
        "throttled_records": """SELECT ingest_ts AS arrival_ts, seq FROM (
SELECT *, row_number() OVER (PARTITION BY date_trunc('second', ingest_ts) ORDER BY ingest_ts, seq) AS place FROM (SELECT ingest_ts, kinesis_seq * 2 + CASE WHEN ingest_ts > event_ts + INTERVAL '70' SECOND THEN 1 ELSE 0 END AS seq FROM se))
WHERE place > 1""",
        "contract_errors_found": _ERRORS + "SELECT kinesis_seq, reason = '' AS ok, reason, n_errors FROM told",
        "ts_fallback": _ERRORS + "SELECT kinesis_seq, ingest_ts AS event_ts, CAST(ingest_ts AS DATE) AS event_date FROM told WHERE kind = 7",
        "top_violations": _ERRORS + "SELECT split_part(x, ':', 1) AS field, count(*) AS n FROM (SELECT unnest(string_split(reason, '; ')) AS x FROM told WHERE reason <> '') GROUP BY 1 ORDER BY n DESC, field LIMIT 3",
        "recent_alerts": """, p AS (SELECT CAST(ingest_ts AS DATE) AS day, source, round(CAST(count(*) FILTER (WHERE extra <> '') * 100.0 / count(*) AS DOUBLE), 6) AS pct FROM v1 GROUP BY 1, 2)
SELECT day AS raised_at, 'contract_violation' AS monitor, source AS message, CASE WHEN pct > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM p WHERE pct > 0.5 ORDER BY day DESC, source LIMIT 6""",
        "shard_distribution": """, step AS (
  SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
keys AS (SELECT coalesce(nullif(vehicle_id, ''), nullif(hub_code, ''), shipment_id) AS key FROM se),
sums AS (SELECT xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(key)), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
  lambda c, b: xor(c >> 8, crc.t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS crc32 FROM keys, crc)
SELECT 'shardId-' || lpad(CAST(crc32 % 8 AS VARCHAR), 12, '0') AS shard_id, count(*) AS n FROM sums GROUP BY 1""",
        "q_rel_versions": "SELECT ver AS schema_version, stg.source AS source, count(*) AS n FROM stg JOIN vd USING (event_id) WHERE ver <> 'unknown' GROUP BY 1, 2",
        "q_version_mix": "SELECT ver AS schema_version, count(*) AS n FROM stg JOIN vd USING (event_id) WHERE ver <> 'unknown' GROUP BY 1",
        "q_rel_alerts": """SELECT CASE WHEN pct > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'contract_violation' AS monitor, count(*) AS n, max(day) AS latest FROM (
SELECT CAST(ingest_ts AS DATE) AS day, source, round(CAST(count(*) FILTER (WHERE extra <> '') * 100.0 / count(*) AS DOUBLE), 6) AS pct FROM v1 GROUP BY 1, 2) WHERE pct > 0.5 GROUP BY 1, 2""",
        "q_ds_cold_chain": f"""SELECT round(min(temperature_c), 1) AS min_c, round(max(temperature_c), 1) AS max_c, count(*) FILTER (WHERE temperature_c > 8) AS above_8c, count(*) AS readings FROM (
SELECT DISTINCT ON (vehicle_id, event_ts, {_fixed('temperature_c')}, {_fixed('geo_lat')}, {_fixed('geo_lon')}) temperature_c FROM stg WHERE vehicle_id IS NOT NULL AND event_type IN ('gps_ping', 'temperature'))""",
    }
    out = {name: BASE.replace("WITH", "WITH RECURSIVE", 1) + text for name, text in sql.items()}
    snap = BASE.rstrip() + ", " + _SNAP
    out |= {
        "q_ops_status": f"{snap} SELECT coalesce(current_status, 'in_flight') AS status, count(*) AS shipments FROM snap GROUP BY 1",
        "q_ops_freshness": f"{snap} SELECT max(last_event_ts) AS newest_event, date_diff('second', max(last_event_ts), TIMESTAMP '2024-02-01 00:00:00') AS age_seconds FROM snap",
        "q_fin_top_hubs": f"{BASE} SELECT recon_date, hub_code, shipments, events, delivered, exceptions FROM ({_recon()}) ORDER BY events DESC, recon_date, hub_code LIMIT 8",
        "vault_hub_shipment": _hub("shipment_id", "shipment_hk"),
        "vault_hub_vehicle": _hub("vehicle_id", "vehicle_hk"),
        "vault_hub_facility": _hub("hub_code", "facility_hk", "split_part(hub_code, '-', 2) AS country,"),
        "dim_date_seeded": f"SELECT * FROM ({sql['dim_date']}) WHERE date_key > DATE '2026-06-30'",
        "generated_events": """WITH d AS (
  SELECT i AS seq, CAST('0x' || substr(md5('source|7|' || i), 1, 8) AS BIGINT) % 100 AS s, CAST('0x' || substr(md5('type|7|' || i), 1, 8) AS BIGINT) % 100 AS t,
         CAST('0x' || substr(md5('late|7|' || i), 1, 8) AS BIGINT) % 10000 AS l, CAST('0x' || substr(md5('age|7|' || i), 1, 8) AS BIGINT) % 82800 AS a FROM range(1000) r(i))
SELECT seq, CASE WHEN s < 48 THEN 'telematics_gateway' WHEN s < 70 THEN 'hub_scanner_net' WHEN s < 88 THEN 'partner_courier_api' ELSE 'driver_mobile_app' END AS source,
       CASE WHEN t < 55 THEN 'gps_ping' WHEN t < 77 THEN 'temperature' WHEN t < 90 THEN 'status' ELSE 'hub_scan' END AS event_type, CASE WHEN l < 100 THEN a + 300 ELSE 0 END AS late FROM d""",
        "compat_check": """SELECT * FROM (VALUES ('v1', 'v2', false, 'delivery_window: gone'), ('v1', 'v3', false, 'geo: gone'), ('v2', 'v1', false, 'delivery: gone'),
('v2', 'v3', false, 'delivery: gone; geo: gone'), ('v3', 'v1', false, 'position: gone'), ('v3', 'v2', false, 'delivery_window: gone; position: gone')) t(old_version, new_version, compatible, problems)""",
        "q_cost_model": """WITH r AS (SELECT unnest([1.0, 5.0, 10.0, 43.0])::DOUBLE AS reprocess_ratio), p AS (
SELECT reprocess_ratio, 61000::DOUBLE * 0.78 / reprocess_ratio + 1800::DOUBLE + 24 * 30 * 0.35 * 3::DOUBLE + 4 * 0.35 * 30 * 3::DOUBLE + 8800
 + (90::DOUBLE * 122.88 / 5.6) * (0.023 + 7 * 0.0125 + 0.15) + 8 * 730 * 0.035::DOUBLE + 3600 * 0.014::DOUBLE + 3686.4::DOUBLE * 0.047 + 1.2::DOUBLE * 0.2 + 1200000 * 0.9::DOUBLE * 0.0000166667 + 1700 AS x FROM r)
SELECT reprocess_ratio, round(x, 2) AS proposed, round(x + 0.5 * (61000 - x), 2) AS conservative FROM p""",
    }
    return out
