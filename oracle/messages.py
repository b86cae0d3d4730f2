"""Twins of the message queries."""

from __future__ import annotations

from agrispark.plans.message_queries import ID_EXPR, PHRASE_EXPR
from agrispark.rules import lexicon as lx
from oracle.common import NUMBER, literal, values

_UTT = f"utt AS (SELECT conv_id, turn, role, CASE WHEN (conv_id+turn)%50=0 THEN '' ELSE coalesce(text,'')||' '||{PHRASE_EXPR} END AS text FROM conversations)"
_ROWS = [(intent, i, j, k, w) for i, (intent, pairs) in enumerate(lx.INTENT_KEYWORDS.items()) for j, (k, w) in enumerate(pairs)]
_CUSTOM = [r for r in _ROWS if r[0] != "intercropping"] + [
    ("weather_advice", 9, 100, "the", 2.0), ("weather_advice", 9, 101, "on", 0.5),
    ("intercropping", 1, 0, "maize", 4.5), ("intercropping", 1, 1, "alongside", 2.0),
]


def _lex(rows) -> str:
    return values("lex", ["intent", "iord", "kord", "keyword", "weight"], rows)


_SCORES = """hits AS (SELECT conv_id, turn, intent, iord, kord, keyword, weight FROM utt JOIN lex ON contains(lower(text), keyword)),
  scores AS (SELECT conv_id, turn, intent, iord, sum(weight) AS weight, least(0.3::DOUBLE + 0.7::DOUBLE * (sum(weight) / 6.0::DOUBLE), 1.0::DOUBLE) AS confidence,
      string_agg(keyword, '|' ORDER BY kord) AS keywords, list(keyword ORDER BY kord) AS kws FROM hits GROUP BY ALL),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY confidence DESC, iord) AS rn FROM scores),
  tops AS (SELECT u.conv_id, u.turn, u.text, coalesce(a.intent, 'general_knowledge') AS intent,
      CASE WHEN u.text = '' THEN 0.5::DOUBLE ELSE coalesce(a.confidence, 0.3::DOUBLE) END AS confidence, coalesce(a.keywords, '') AS keywords, a.kws,
      CASE WHEN b.confidence > a.confidence - 0.15::DOUBLE THEN b.intent END AS secondary_intent
    FROM utt u LEFT JOIN placed a ON a.conv_id = u.conv_id AND a.turn = u.turn AND a.rn = 1
    LEFT JOIN placed b ON b.conv_id = u.conv_id AND b.turn = u.turn AND b.rn = 2)"""

_any = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
_ACT = f"""act AS (SELECT conv_id, turn, {_any(lx.TELEMETRY_WORDS)} AS telemetry_exists, {_any(lx.SENSOR_VALUE_WORDS)} AS sensor_values_exist,
    {_any(lx.SYMPTOM_WORDS)} AS symptoms_reported, ({' OR '.join(f"regexp_matches(t, {literal(p)})" for p in lx.MEASUREMENT_ACTIVATION)}) AS soil_measurements_provided
  FROM (SELECT *, lower(text || ' ') AS t FROM utt))"""

_MODES = values("modes", ["intent", "imode"], list(lx.INTENT_MODES.items()))
_ATTR = values("attr", ["mode", "response_format", "requires_context", "requires_diagnostics", "memory_preference"], [(m, *a) for m, a in lx.MODE_ATTRIBUTES.items()])

_number = lambda x: f"CASE WHEN regexp_matches({x}, '{NUMBER}') THEN try_cast({x} AS DOUBLE) END"
_MEAS = ", ".join(_number(f"regexp_extract(t, {literal(lx.measurement_pattern(w))}, 1)") + f" AS m_{n}" for n, w in lx.MEASUREMENT_WORDS.items())
_COUNT = " + ".join(f"CASE WHEN m_{n} IS NULL THEN 0 ELSE 1 END" for n in lx.MEASUREMENT_WORDS)

_VALID = "valid AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM {src} WHERE role IN ('user', 'assistant') AND text IS NOT NULL)"


def _last(n: int) -> str:
    return f"""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations
        WHERE role IN ('user', 'assistant') AND text IS NOT NULL QUALIFY rank <= {n}"""


SQL = {
    "intent_scores": f"WITH {_UTT}, {_lex(_ROWS)}, {_SCORES} SELECT conv_id, turn, intent, weight, round(confidence, 6) AS confidence, keywords FROM scores",
    "intent_top": f"""WITH {_UTT}, {_lex(_ROWS)}, {_SCORES} SELECT conv_id, turn, intent, round(confidence, 6) AS confidence, keywords, secondary_intent,
        CASE WHEN text = '' THEN 'Query is empty or invalid; defaulting to general knowledge.' WHEN kws IS NULL THEN 'No specific keywords detected; defaulting to general knowledge.'
          ELSE intent || ' (' || CASE WHEN confidence > 0.75 THEN 'high' WHEN confidence > 0.5 THEN 'moderate' ELSE 'low' END || ' confidence) — matched: ' || array_to_string(kws[1:3], ', ') END AS explanation FROM tops""",
    "intent_custom_lexicon": f"WITH {_UTT}, {_lex(_CUSTOM)}, {_SCORES} SELECT intent, count(*) AS n FROM tops GROUP BY intent",
    "activation_flags": f"WITH {_UTT}, {_ACT} SELECT * FROM act",
    "routing_mode": f"""WITH {_UTT}, {_lex(_ROWS)}, {_SCORES}, {_ACT}, {_MODES}, {_ATTR},
        j AS (SELECT tops.conv_id, tops.turn, tops.intent, imode, imode = 'diagnostic_mode' AND NOT (telemetry_exists OR sensor_values_exist OR symptoms_reported OR soil_measurements_provided) AS downgraded
          FROM tops JOIN act ON act.conv_id = tops.conv_id AND act.turn = tops.turn JOIN modes ON modes.intent = tops.intent)
        SELECT conv_id, turn, intent, mode, downgraded, response_format, requires_context, requires_diagnostics, memory_preference
        FROM j JOIN attr ON attr.mode = CASE WHEN downgraded THEN 'general_mode' ELSE imode END""",
    "measurements_in_text": f"""WITH {_UTT}, m AS (SELECT conv_id, turn, {_MEAS} FROM (SELECT *, lower(text || ' ') AS t FROM utt)), c AS (SELECT *, {_COUNT} AS k FROM m)
        SELECT conv_id, turn, cast(k AS BIGINT) AS measurement_count, {', '.join(f'CASE WHEN k >= 3 THEN m_{n} END AS {n}' for n in lx.MEASUREMENT_WORDS)} FROM c""",
    "valid_messages": "SELECT role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY role",
    "conversation_ids": f"""SELECT {ID_EXPR.format(STR='varchar')} AS client_id, count(*) AS messages,
        regexp_full_match(trim({ID_EXPR.format(STR='varchar')}), '[A-Za-z0-9_-]{{8,64}}') AS accepted FROM conversations GROUP BY ALL""",
    "last_48_messages": _last(48),
    "last_6_messages": _last(6),
    "relevant_history": f"""WITH {_UTT}, {_VALID.format(src='utt')},
        asked AS (SELECT conv_id, turn, pos, list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\s+'),
            lambda w: regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')), lambda w: length(w) > 3), lambda w: lower(w))) AS words FROM valid WHERE role = 'user'),
        rec AS (SELECT a.conv_id, a.turn, a.words, v.turn AS vt, v.pos - a.pos AS off, len(list_filter(a.words, lambda w: contains(lower(v.text), w))) > 0 AS shared
          FROM asked a JOIN valid v ON v.conv_id = a.conv_id AND v.pos BETWEEN a.pos - 6 AND a.pos - 1),
        kept AS (SELECT * FROM (SELECT *, bool_or(shared) OVER (PARTITION BY conv_id, turn) AS anyshared FROM rec)
          WHERE len(words) <= 2 OR CASE WHEN anyshared THEN shared ELSE off >= -2 END)
        SELECT asked.conv_id, asked.turn, count(vt) AS kept, coalesce(string_agg(cast(vt AS varchar), ',' ORDER BY vt), '') AS kept_turns
        FROM asked LEFT JOIN kept ON kept.conv_id = asked.conv_id AND kept.turn = asked.turn GROUP BY ALL""",
    "appended_turns": """WITH mx AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id)
        SELECT conv_id, m + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role, length(text) AS chars FROM conversations JOIN mx USING (conv_id) WHERE role = 'user'""",
}
