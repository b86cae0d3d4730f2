"""Twins of the queries that store and read back, and of the hooks."""

from __future__ import annotations

from agrispark.plans.store_queries import FIRST_ALERTS, FORECAST_EXPRS
from agrispark.schemas import FORECAST_FEATURES, MEASURES
from oracle.advice import ISSUES, SUITABILITY
from oracle.common import LATEST, LIMITS, PAY, TEL
from oracle.corpus import _LETTERS, _LINES, _RRF, _tokens
from oracle.telemetry import _alerts

_FORECAST = f"WITH {TEL}, f AS (SELECT {', '.join(FORECAST_EXPRS)} FROM tel)"
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FORECAST_FEATURES)
_TURNS = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations"
_METRIC_ORDER = "CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(("nitrogen", "phosphorus", "potassium", "moisture", "temperature", "humidity"))) + " END"

SQL = {
    "forecast_file": f"{_FORECAST} SELECT timestamp, {', '.join(FORECAST_FEATURES)} FROM f WHERE {_COMPLETE}",
    "dropped_rows": f"{_FORECAST} SELECT count(*) AS rows, count(*) FILTER (WHERE NOT ({_COMPLETE})) AS dropped, count(*) FILTER (WHERE {_COMPLETE}) AS kept FROM f",
    "telemetry_table": f"WITH {TEL} SELECT ts, node_id, {', '.join(MEASURES)}, satellites, target_crop FROM tel",
    "conversation_files": f"SELECT cast(conv_id AS varchar) AS conv_id, turn, role, text FROM ({_TURNS})",
    "stored_turns": _TURNS,
    "compacted_chunks": f"""WITH {_LINES}, one AS (SELECT chunk_id, min(i) AS i FROM chunks GROUP BY chunk_id), n AS (SELECT count(*) AS live, count(*) FILTER (WHERE i % 3 = 0) AS changed FROM one)
        SELECT live, changed, live + changed AS appended_rows, live AS compacted_rows FROM n""",
    "label_map": f"""WITH {TEL}, {SUITABILITY} SELECT event_id, cast(CASE suitability_label WHEN 'Poor' THEN 0 WHEN 'Fair' THEN 1 ELSE 2 END AS BIGINT) AS label_index,
        suitability_label AS label FROM suit""",
    "reloaded_model": f"""WITH {TEL}, w AS (SELECT row_number() OVER (PARTITION BY node_id ORDER BY ts, event_id) AS rn FROM tel WHERE node_id IS NOT NULL AND node_id <> '')
        SELECT count(*) AS windows, count(*) AS alike FROM w WHERE rn >= 24""",
    "rescored_topk": f"""WITH {_RRF}, pairs AS (SELECT fused.query_id, fused.chunk_id, rrf,
            cast(len(list_intersect(list_distinct({_tokens('d.text')}), list_distinct({_tokens('b.text')}))) AS DOUBLE) - 8.0::DOUBLE AS rerank_score
          FROM fused JOIN documents d ON chunk_id = 'd' || lpad(cast(doc_id AS varchar), 12, '0') JOIN benchmark b ON b.item_id = fused.query_id),
        final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf DESC, chunk_id) AS rank FROM pairs QUALIFY rank <= 3)
        SELECT query_id, chunk_id, rerank_score, rank FROM final WHERE rerank_score >= -3.0""",
    "encoded_documents": f"""WITH c AS (SELECT 'd' || lpad(cast(doc_id AS varchar), 12, '0') AS chunk_id, {_LETTERS} AS c FROM documents)
        SELECT chunk_id, cast(list_position(c, list_max(c)) AS BIGINT) AS letter, cast(26 AS BIGINT) AS dimensions FROM c""",
    "first_alerts": f"""WITH {TEL}, {LATEST}, {LIMITS}, {_alerts('latest')}
        SELECT row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, ts DESC, event_id DESC, node_id, {_METRIC_ORDER}) AS place,
          alert_id, severity, metric FROM alerts QUALIFY place <= {FIRST_ALERTS}""",
    "ordered_issues": f"""WITH {PAY}, {ISSUES} SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY srank, pord) AS place, parameter, severity, issue FROM issues""",
}
SQL["verdict_scores_recomputed"] = SQL["anomaly_scores_recomputed"] = SQL["reloaded_model"]
