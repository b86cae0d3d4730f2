"""Twins of the telemetry queries."""

from __future__ import annotations

from agrispark.plans.telemetry_queries import DIRTY_EXPR, OVERRIDE_EXPRS, POSITION_EXPR
from agrispark.rules import limits
from oracle.common import LATEST, LIMITS, MEASURES, NUMBER, TEL, unpivot, values

READING = "node_id, event_id, ts, " + ", ".join(MEASURES) + ", target_crop, communication_ok"

_number = lambda v: f"regexp_replace(printf('%.1f', {v}), '\\.0$', '')"


def _alerts(source: str, limit_table: str = "lim", extra: str = "", null_as_zero: bool = False) -> str:
    v = "coalesce(v, 0.0)" if null_as_zero else "v"
    return f"""
    longr AS ({unpivot(source, ['node_id', 'event_id', 'ts'], MEASURES)}),
    hit AS (SELECT l.*, longr.node_id, longr.event_id, longr.ts, {v} AS val,
              CASE WHEN {v} < lo THEN 'low' WHEN {v} > hi THEN 'high' END AS dir,
              CASE WHEN {v} < lo THEN lo ELSE hi END AS thr
            FROM longr JOIN {limit_table} l ON l.col = longr.col WHERE {v} < lo OR {v} > hi),
    graded AS (SELECT *, greatest(abs(thr) * 0.2, 1.0) AS margin FROM hit),
    alerts AS (SELECT {extra} concat_ws('-', node_id, metric, strftime(ts, '%Y-%m-%d %H:%M:%S')) AS alert_id,
      node_id, event_id, ts, metric,
      CASE WHEN (dir = 'low' AND val <= thr - margin) OR (dir = 'high' AND val >= thr + margin) THEN 'critical' ELSE 'warning' END AS severity,
      dir AS direction, val AS value, thr AS threshold,
      label || ' is ' || dir || ' on ' || node_id AS title,
      {_number('val')} || ' ' || unit || ' is ' || CASE WHEN dir = 'low' THEN 'below' ELSE 'above' END || ' your ' || {_number('thr')} || ' ' || unit || ' alert threshold.' AS message,
      CASE WHEN dir = 'low' THEN low_advice ELSE high_advice END AS recommendation
      FROM graded)"""


_OVERRIDES = ", ".join(e.format(STR="varchar") for e in OVERRIDE_EXPRS)
_STATUS = """CASE WHEN NOT online THEN 'OFFLINE'
  WHEN coalesce(nitrogen_mg_kg, 0) < 20 OR coalesce(moisture_pct, 0) < 25 THEN 'POOR'
  WHEN coalesce(nitrogen_mg_kg, 0) BETWEEN 20 AND 30 OR coalesce(moisture_pct, 0) BETWEEN 25 AND 35 THEN 'FAIR' ELSE 'GOOD' END"""
_ONLINE = "NOT coalesce(lower(communication_ok) IN ('false', '0'), false)"
_STATES = f"states AS (SELECT *, {_STATUS} AS status FROM (SELECT *, {_ONLINE} AS online FROM latest))"
_CROP_NAME = "lower(trim(coalesce(target_crop, '')))"
_KNOWN = "('maize', 'corn', 'maize_corn', 'maize/corn')"

SQL = {
    "threshold_alerts": f"WITH {TEL}, {LATEST}, {LIMITS}, {_alerts('latest')} SELECT * FROM alerts",
    "threshold_alerts_recent": f"""WITH {TEL}, recent AS (SELECT * FROM tel ORDER BY ts DESC, event_id DESC LIMIT 500),
        latest AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) = 1),
        {LIMITS}, {_alerts('latest')} SELECT * FROM alerts""",
    "threshold_alerts_null_as_zero": f"WITH {TEL}, {LATEST}, {LIMITS}, {_alerts('latest', null_as_zero=True)} SELECT * FROM alerts",
    "alerts_with_overrides": f"""WITH {TEL}, {LATEST}, {LIMITS}, ov AS (SELECT {_OVERRIDES} FROM region),
        parsed AS (SELECT *, CASE WHEN regexp_matches(min_text, '{NUMBER}') THEN try_cast(min_text AS double) END AS mn,
                          CASE WHEN regexp_matches(max_text, '{NUMBER}') THEN try_cast(max_text AS double) END AS mx FROM ov),
        eff AS (SELECT lim.* EXCLUDE (lo, hi), users.user_id,
                  CASE WHEN mn < mx THEN mn ELSE lo END AS lo, CASE WHEN mn < mx THEN mx ELSE hi END AS hi
                FROM (SELECT DISTINCT user_id FROM ov) AS users, lim
                LEFT JOIN parsed ON parsed.metric = lim.metric AND parsed.user_id = users.user_id),
        {_alerts('latest', 'eff', 'user_id,')} SELECT * FROM alerts""",
    "alert_counts": f"""WITH {TEL}, {LIMITS}, {_alerts('tel')}
        SELECT metric, direction, severity, count(*) AS alerts FROM alerts GROUP BY ALL""",
    "latest_per_node": f"WITH {TEL}, {LATEST} SELECT {READING} FROM latest",
    "latest_in_recent_rows": f"""WITH {TEL}, recent AS (SELECT * FROM tel ORDER BY ts DESC, event_id DESC LIMIT 100)
        SELECT {READING} FROM recent QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) = 1""",
    "newest_readings": f"WITH {TEL} SELECT {READING} FROM tel ORDER BY ts DESC, event_id DESC LIMIT 300",
    "last_24_per_node": f"""WITH {TEL} SELECT node_id, event_id, ts, moisture_pct,
        row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) AS rank FROM tel
        QUALIFY rank <= 24""",
    "history_windows": f"""WITH {TEL}, kept AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) AS rn FROM tel QUALIFY rn <= 48)
        SELECT node_id, count(*) AS readings_used, CASE WHEN count(*) >= 48 THEN 'ok' ELSE 'insufficient_data' END AS status,
          min(ts) AS oldest_ts, max(ts) AS newest_ts, arg_max(coalesce(moisture_pct, -1), rn) AS om,
          CASE WHEN om < 0 THEN NULL ELSE om END AS oldest_moisture FROM kept GROUP BY node_id""",
    "history_status": f"""WITH {TEL} SELECT node_id, count(*) AS readings,
        CASE WHEN count(*) >= 72 THEN 'ok' ELSE 'insufficient_data' END AS status FROM tel GROUP BY node_id""",
    "node_count": f"WITH {TEL} SELECT count(DISTINCT node_id) AS node_count FROM tel",
    "network_averages": f"""WITH {TEL} SELECT count(*) AS rows,
        round(sum(coalesce(moisture_pct, 0)) / count(*), 6) AS avg_moisture_pct_zero_filled, round(avg(moisture_pct), 6) AS avg_moisture_pct,
        round(sum(coalesce(temperature_c, 0)) / count(*), 6) AS avg_temperature_c_zero_filled, round(avg(temperature_c), 6) AS avg_temperature_c FROM tel""",
    "node_status": f"WITH {TEL}, {LATEST}, {_STATES} SELECT node_id, ts, online, status FROM states",
    "map_layers": f"""WITH {TEL}, {LATEST}, {_STATES} SELECT node_id,
        CASE WHEN coalesce(moisture_pct, 0) < 30 THEN 'low' ELSE 'good' END AS moisture_layer,
        CASE WHEN coalesce(nitrogen_mg_kg, 0) < 25 THEN 'low' ELSE 'good' END AS nitrogen_layer,
        CASE WHEN online THEN 'connected' ELSE 'disconnected' END AS coverage_layer, lower(status) AS health_layer FROM states""",
    "nodes_needing_attention": f"""WITH {TEL}, {LATEST}, {_STATES} SELECT count(*) AS total_nodes,
        count(*) FILTER (WHERE status <> 'GOOD') AS needing_attention FROM states""",
    "metric_tone": f"""WITH {TEL}, {LATEST}, {values('rng', ['col', 'glo', 'ghi', 'flo', 'fhi'], limits.METRIC_RANGES)},
        longr AS ({unpivot('latest', ['node_id'], [r[0] for r in limits.METRIC_RANGES])})
        SELECT node_id, longr.col AS metric, coalesce(v, 0.0) AS value,
          CASE WHEN coalesce(v, 0) BETWEEN glo AND ghi THEN 'good' WHEN coalesce(v, 0) BETWEEN flo AND fhi THEN 'fair' ELSE 'poor' END AS tone,
          round(greatest(8.0, least(100.0, (coalesce(v, 0) - flo) / (fhi - flo) * 100)), 6) AS fill_percent
        FROM longr JOIN rng ON rng.col = longr.col""",
    "trend_series": f"""WITH {TEL} SELECT event_id, node_id, ts, strftime(ts, '%H:%M') AS formatted_time, strftime(ts, '%b %d') AS formatted_date,
        coalesce(nitrogen_mg_kg, 0.0) AS n, coalesce(phosphorus_mg_kg, 0.0) AS p, coalesce(potassium_mg_kg, 0.0) AS k,
        coalesce(moisture_pct, 0.0) AS moisture, coalesce(humidity_pct, 0.0) AS humidity, coalesce(temperature_c, 0.0) AS temp FROM tel""",
    "date_range_log": f"""WITH {TEL} SELECT {READING} FROM tel
        WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""",
    "date_range_whole_days": f"""WITH {TEL} SELECT {READING} FROM tel
        WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00'""",
    "readings_with_node": f"WITH {TEL} SELECT node_id, count(*) AS readings FROM tel WHERE node_id IS NOT NULL AND node_id <> '' GROUP BY node_id",
    "coerced_measures": f"""WITH {TEL}, dirty AS (SELECT event_id, {DIRTY_EXPR.format(STR='varchar')} AS moisture_text FROM tel)
        SELECT event_id, moisture_text, CASE WHEN regexp_matches(moisture_text, '{NUMBER}') THEN try_cast(trim(moisture_text) AS double) END AS moisture FROM dirty""",
    "raw_readings_renamed": f"""WITH {TEL} SELECT node_id, date_trunc('second', ts) AS ts, {', '.join(MEASURES)}, latitude, satellites, communication_ok FROM tel""",
    "filled_features": f"WITH {TEL} SELECT event_id, {', '.join(f'coalesce({m}, 0.0) AS {m}' for m in MEASURES)} FROM tel",
    "complete_readings": f"WITH {TEL} SELECT event_id, node_id, {', '.join(MEASURES)} FROM tel WHERE {' AND '.join(m + ' IS NOT NULL' for m in MEASURES)}",
    "feature_columns": f"WITH {TEL} SELECT event_id, {', '.join(MEASURES)} FROM tel",
    "crop_normalised": f"""WITH {TEL} SELECT event_id, target_crop, 'maize_corn' AS crop_key,
        ({_CROP_NAME} = '' OR {_CROP_NAME} IN {_KNOWN} OR translate({_CROP_NAME}, '/ -', '___') IN {_KNOWN}) AS crop_recognised FROM tel""",
    "unknown_crops": f"""WITH {TEL} SELECT {_CROP_NAME} AS crop, count(*) AS readings FROM tel
        WHERE NOT ({_CROP_NAME} = '' OR {_CROP_NAME} IN {_KNOWN} OR translate({_CROP_NAME}, '/ -', '___') IN {_KNOWN}) GROUP BY 1""",
    "online_flags": f"WITH {TEL} SELECT event_id, communication_ok, {_ONLINE} AS online FROM tel",
    "positioned_nodes": f"""WITH {TEL}, t AS (SELECT event_id, node_id, {POSITION_EXPR.format(STR='varchar')} AS lat_text, longitude FROM tel)
        SELECT event_id, node_id, try_cast(lat_text AS double) AS latitude, longitude FROM t WHERE try_cast(lat_text AS double) IS NOT NULL""",
    "readings_long": f"WITH {TEL} {unpivot('tel', ['event_id'], MEASURES, 'parameter', 'value')}",
    "silent_nodes": f"""WITH {TEL} SELECT node_id, max(ts) AS last_seen FROM tel GROUP BY node_id
        HAVING max(ts) < (SELECT max(ts) FROM tel) - INTERVAL 12 HOUR""",
    "farm_snapshot": f"""WITH {TEL}, recent AS (SELECT * FROM tel ORDER BY ts DESC, event_id DESC LIMIT 500)
        SELECT count(DISTINCT node_id) AS node_count, count(DISTINCT node_id) AS nodes_in_document, min(node_id) AS first_node, 'online' AS status FROM recent""",
    "busiest_node_log": f"""WITH {TEL}, c AS (SELECT node_id, count(*) AS n FROM tel GROUP BY node_id ORDER BY n DESC, node_id DESC LIMIT 1)
        SELECT {READING} FROM tel WHERE node_id = (SELECT node_id FROM c)""",
    "exported_log": f"""WITH {TEL} SELECT event_id, node_id, ts, {', '.join(MEASURES)}, satellites, communication_ok FROM tel
        WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""",
    "node_documents": f"WITH {TEL}, {LATEST} SELECT node_id, moisture_pct, target_crop FROM latest",
}
SQL["history_windows"] = "SELECT node_id, readings_used, status, oldest_ts, newest_ts, oldest_moisture FROM (" + SQL["history_windows"] + ")"
SQL["nodes_by_week"] = f"""WITH {TEL}, heard AS (SELECT node_id, ts FROM tel WHERE node_id IS NOT NULL AND node_id <> '' AND ts IS NOT NULL),
    named AS (SELECT node_id, 'all' AS name FROM heard UNION ALL SELECT node_id, 'week ' || cast(floor(epoch(ts) / (7 * 86400)) AS BIGINT) FROM heard)
    SELECT name, count(DISTINCT node_id) AS exact, count(*) AS readings, true AS close FROM named GROUP BY name"""
