"""Twins of the sequence queries."""

from __future__ import annotations

from oracle.advice import SUITABILITY
from oracle.common import LATEST, MEASURES, TEL

_W = "PARTITION BY node_id ORDER BY ts, event_id"
_FUTURE = f"""fut AS (SELECT event_id, node_id, moisture_pct, lead(moisture_pct, 24) OVER w AS future_value,
    row_number() OVER w AS rn, count(*) OVER (PARTITION BY node_id) AS n FROM tel WINDOW w AS ({_W})),
  pairs AS (SELECT * FROM fut WHERE rn + 24 <= n)"""
_SERIES = """ser AS (SELECT event_id, ts, row_number() OVER w - 1 AS seq, count(*) OVER () AS n,
    lag(moisture_pct, 47) OVER w AS first_moisture, lead(moisture_pct, 24) OVER w AS target_value,
    avg(coalesce(moisture_pct, 0)) OVER (ORDER BY ts, event_id ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS m
  FROM tel WINDOW w AS (ORDER BY ts, event_id)),
  onew AS (SELECT * FROM ser WHERE seq >= 47 AND seq + 24 < n)"""
_SHARES = """shares AS (SELECT node_id, count(*) AS readings, count(*) FILTER (WHERE suitability_label = 'Poor') / count(*) AS p0,
    count(*) FILTER (WHERE suitability_label = 'Fair') / count(*) AS p1, count(*) FILTER (WHERE suitability_label = 'Good') / count(*) AS p2 FROM suit GROUP BY node_id),
  verdicts AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'Poor' WHEN p1 >= p2 THEN 'Fair' ELSE 'Good' END AS model_label,
    cast(printf('%.4f', greatest(p0, p1, p2)) AS DOUBLE) AS model_confidence FROM shares)"""
_SUIT_LATEST = SUITABILITY.replace("FROM tel)", "FROM latest)").replace("sparts", "lparts").replace("scomp", "lcomp").replace("suit AS", "lsuit AS")
_SCALE = "(coalesce({c}, 0.0) - (SELECT min(coalesce({c}, 0.0)) FROM tel)) / ((SELECT max(coalesce({c}, 0.0)) FROM tel) - (SELECT min(coalesce({c}, 0.0)) FROM tel))"
_LABEL = "CASE suitability_label WHEN 'Poor' THEN 0 WHEN 'Fair' THEN 1 ELSE 2 END"
_SUIT_WINDOWS = f"sw AS (SELECT *, row_number() OVER ({_W}) AS rn FROM suit QUALIFY rn >= 24)"

SQL = {
    "line_forecast_metrics": f"""WITH {TEL}, w AS (SELECT event_id, ts, moisture_pct AS x, lead(moisture_pct, 24) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS y
          FROM tel WHERE node_id IS NOT NULL AND node_id <> ''),
        p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, count(*) OVER () AS n FROM w WHERE x IS NOT NULL AND y IS NOT NULL),
        fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE seq < floor(n * 0.70::DOUBLE)),
        t AS (SELECT y, y - (a + b * x) AS r FROM p, fit WHERE seq >= floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE))
        SELECT count(*) AS n, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(1 - avg(r * r) / var_pop(y), 6) AS r2, round(avg(r), 6) AS residual_mean FROM t""",
    "scaler_params": f"WITH {TEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min(coalesce({c}, 0.0)) AS data_min, max(coalesce({c}, 0.0)) AS data_max FROM tel" for c in MEASURES),
    "scaled_readings": f"WITH {TEL} SELECT event_id, {', '.join('round(' + _SCALE.format(c=c) + ', 9) AS ' + c for c in MEASURES)} FROM tel",
    "unscaled_moisture": f"WITH {TEL} SELECT event_id, round(coalesce(moisture_pct, 0.0), 6) AS moisture_pct FROM tel",
    "windows_24": f"""WITH {TEL}, w AS (SELECT node_id, event_id, ts, row_number() OVER ({_W}) - 1 AS seq, cast(24 AS BIGINT) AS length,
          lag(moisture_pct, 23) OVER ({_W}) AS first_moisture, moisture_pct AS last_moisture,
          round(avg(coalesce(nitrogen_mg_kg, 0)) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS mean_nitrogen,
          round(avg(coalesce(humidity_pct, 0)) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS mean_humidity FROM tel)
        SELECT * FROM w WHERE seq >= 23""",
    "windows_48_h24": f"""WITH {TEL}, w AS (SELECT node_id, event_id, row_number() OVER ({_W}) - 1 AS seq, count(*) OVER (PARTITION BY node_id) AS n,
          lag(moisture_pct, 47) OVER ({_W}) AS first_moisture, lead(moisture_pct, 24) OVER ({_W}) AS target_value,
          round(avg(coalesce(moisture_pct, 0)) OVER ({_W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), 6) AS mean_moisture FROM tel)
        SELECT * EXCLUDE (n) FROM w WHERE seq >= 47 AND seq + 24 < n""",
    "windows_48_h24_one_series": f"WITH {TEL}, {_SERIES} SELECT event_id, seq, first_moisture, target_value, round(m, 6) AS mean_moisture FROM onew",
    "chronological_split": f"""WITH {TEL}, {_SERIES}, s AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, count(*) OVER () AS k FROM onew)
        SELECT event_id, seq, CASE WHEN seq < floor(k * 0.7) THEN 'train' WHEN seq < floor(k * 0.7) + floor(k * 0.15) THEN 'validation' ELSE 'test' END AS split FROM s""",
    "chronological_split_per_node": f"""WITH {TEL}, s AS (SELECT node_id, ts, row_number() OVER ({_W}) - 1 AS seq, count(*) OVER (PARTITION BY node_id) AS k FROM tel)
        SELECT node_id, CASE WHEN seq < floor(k * 0.7) THEN 'train' WHEN seq < floor(k * 0.7) + floor(k * 0.15) THEN 'validation' ELSE 'test' END AS split,
          count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""",
    "window_labels": f"WITH {TEL}, {SUITABILITY}, {_SUIT_WINDOWS} SELECT node_id, event_id, cast({_LABEL} AS BIGINT) AS label FROM sw",
    "label_distribution": f"WITH {TEL}, {SUITABILITY}, {_SUIT_WINDOWS} SELECT suitability_label AS label, count(*) AS n FROM sw GROUP BY 1",
    "class_weights": f"""WITH {TEL}, {SUITABILITY}, labels(label_index, label) AS (VALUES (cast(0 AS BIGINT), 'Poor'), (1, 'Fair'), (2, 'Good')),
        c AS (SELECT suitability_label AS label, count(*) AS n FROM suit GROUP BY 1)
        SELECT label_index, labels.label, coalesce(n, 0) AS n, round(coalesce((SELECT count(*) FROM suit) / (3 * n), 1.0), 9) AS class_weight
        FROM labels LEFT JOIN c USING (label)""",
    "future_moisture": f"WITH {TEL}, {_FUTURE} SELECT event_id, node_id, moisture_pct, future_value FROM pairs",
    "persistence_metrics": f"""WITH {TEL}, {_FUTURE}, b AS (SELECT future_value - moisture_pct AS r, future_value AS y FROM pairs WHERE moisture_pct IS NOT NULL AND future_value IS NOT NULL)
        SELECT count(*) AS n, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(1 - avg(r * r) / var_pop(y), 6) AS r2, round(avg(r), 6) AS residual_mean FROM b""",
    "residual_histogram": f"""WITH {TEL}, {_FUTURE}, b AS (SELECT future_value - moisture_pct AS r FROM pairs WHERE moisture_pct IS NOT NULL AND future_value IS NOT NULL),
        e AS (SELECT min(r) AS lo, max(r) AS hi FROM b)
        SELECT cast(least(49, floor((r - lo) / ((hi - lo) / 50))) AS BIGINT) AS bin, count(*) AS n, round(min(r), 6) AS smallest, round(max(r), 6) AS largest FROM b, e GROUP BY 1""",
    "class_argmax": f"WITH {TEL}, {SUITABILITY}, {_SHARES} SELECT node_id, model_label, model_confidence FROM verdicts",
    "class_share_metrics": f"""WITH {TEL}, {SUITABILITY}, {_SHARES}, j AS (SELECT CASE suitability_label WHEN 'Poor' THEN p0 WHEN 'Fair' THEN p1 ELSE p2 END AS p,
          suitability_label = model_label AS hit FROM suit JOIN verdicts USING (node_id))
        SELECT count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(-ln(p)), 6) AS log_loss FROM j""",
    "merged_verdicts": f"""WITH {TEL}, {LATEST}, {SUITABILITY}, {_SHARES}, {_SUIT_LATEST}
        SELECT lsuit.node_id, lsuit.suitability_label, lsuit.suitability_score, v.model_label, v.model_confidence,
          coalesce(v.model_label, lsuit.suitability_label) AS verdict, CASE WHEN v.model_label IS NULL THEN 'threshold' ELSE 'model' END AS source
        FROM lsuit LEFT JOIN (SELECT * FROM verdicts WHERE readings >= 72) v USING (node_id)""",
    "verdict_report": f"""WITH {TEL}, {LATEST}, {_SUIT_LATEST}, h AS (SELECT node_id, least(count(*), 24) AS readings_used FROM tel GROUP BY node_id)
        SELECT node_id, crop_key, suitability_label, suitability_score, readings_used, CASE WHEN readings_used >= 24 THEN 'ok' ELSE 'insufficient_data' END AS status,
          suitability_label AS verdict, 'threshold' AS source FROM lsuit JOIN h USING (node_id)""",
}
SQL["scaled_with_saved_parameters"] = SQL["scaled_readings"]
