"""Twins of the advice queries."""

from __future__ import annotations

from agrispark.rules import actions as ra
from agrispark.rules import crop_profile as cp
from agrispark.rules import severity as rs
from oracle.common import PAY, TEL, literal, unpivot, values

_PROFILE = values(
    "prof", ["param_key", "display_name", "unit", "olo", "ohi", "clo", "chi", "low_label", "high_label", "low_hint", "high_hint", "ok_hint", "ord"],
    [(*row, i) for i, row in enumerate(cp.MAIZE_PARAMETERS)],
)

_FLAGS = f"""
  longp AS ({unpivot('pay', ['event_id'], cp.PARAM_KEYS, 'param_key')}),
  base AS (SELECT event_id, p.*, v, CASE WHEN v < olo THEN olo - v WHEN v > ohi THEN v - ohi ELSE 0 END AS dev,
      CASE WHEN v < olo THEN abs(olo - clo) ELSE abs(ohi - chi) END AS shoulder,
      CASE WHEN v <= clo THEN 'LOW' WHEN v >= chi THEN 'HIGH' WHEN v < olo THEN 'LOW' WHEN v > ohi THEN 'HIGH' WHEN v IS NOT NULL THEN 'NONE' END AS direction,
      CASE WHEN v IS NULL THEN 'MISSING' WHEN v <= clo OR v >= chi THEN 'CRITICAL' WHEN v < olo OR v > ohi THEN 'WARNING' ELSE 'OK' END AS status
    FROM longp JOIN prof p USING (param_key)),
  flags AS (SELECT *, dev / (ohi - olo) * 100 AS rel,
      CASE direction WHEN 'LOW' THEN low_label WHEN 'HIGH' THEN high_label WHEN 'NONE' THEN {literal(cp.NOMINAL_LABEL)} END AS direction_label,
      CASE direction WHEN 'LOW' THEN low_hint WHEN 'HIGH' THEN high_hint WHEN 'NONE' THEN ok_hint END AS hint,
      CASE WHEN v IS NULL THEN NULL
           WHEN v BETWEEN olo AND ohi THEN greatest(70.0, 100.0 - abs(v - (olo + ohi) / 2.0) / ((ohi - olo) / 2.0) * 30.0)
           WHEN dev / shoulder <= 1.0 THEN greatest(30.0, 70.0 - dev / shoulder * 40.0)
           ELSE greatest(0.0, 60.0 - dev / shoulder * 30.0) END AS score FROM base),
  summaries AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN status = 'OK'
      THEN '[OK] ' || display_name || ': ' || v || ' ' || unit || ' (within optimal range ' || olo || '–' || ohi || ' ' || unit || ').'
      ELSE '[' || status || '] ' || display_name || ': Observed ' || v || ' ' || unit || ' (optimal: ' || olo || '–' || ohi || ' ' || unit || '). Deviation: '
        || printf('%.3f', dev) || ' ' || unit || ' ' || lower(direction) || ' — ' || direction_label || ' (' || printf('%.1f', rel) || '% outside optimal range).' END AS alert_summary
    FROM flags)"""

_names = lambda s: f"coalesce(string_agg(display_name, '|' ORDER BY ord) FILTER (WHERE status = '{s}'), '')"
_HEALTH = f"""
  health AS (SELECT event_id, cast(printf('%.1f', list_sum(list(coalesce(score, 0.0) ORDER BY ord)) / 10.0) AS DOUBLE) AS field_health_score,
      {_names('OK')} AS ok_parameters, {_names('WARNING')} AS warning_parameters, {_names('CRITICAL')} AS critical_parameters,
      {_names('MISSING')} AS missing_parameters, count(*) FILTER (WHERE status = 'WARNING') AS warning_count,
      count(*) FILTER (WHERE status = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE status = 'MISSING') AS missing_count
    FROM flags GROUP BY event_id),
  {values('bands', ['band', 'lo', 'hi', 'label', 'color'], cp.SCORE_BANDS)},
  banded AS (SELECT health.*, coalesce(band, 'CRITICAL') AS health_band, label AS health_band_label, color AS health_color,
      warning_count + critical_count > 0 AS requires_intervention
    FROM health LEFT JOIN bands ON field_health_score BETWEEN lo AND hi)"""

_section = lambda status, title: (
    f"coalesce('{title}' || chr(10) || string_agg('  • ' || alert_summary || chr(10) || '    Hint: ' || hint, chr(10) ORDER BY ord) "
    f"FILTER (WHERE status = '{status}') || chr(10) || chr(10), '')"
)

_SUIT_PARAMS = {param: column for column, param in cp.SENSOR_PARAMETERS.items()}
_PROF_BY_KEY = {row[0]: row for row in cp.MAIZE_PARAMETERS}


def _suit(param: str) -> str:
    v = _SUIT_PARAMS[param]
    lo, hi, clo, chi = _PROF_BY_KEY[param][3:7]
    return (
        f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} BETWEEN {lo} AND {hi} THEN 100.0::DOUBLE WHEN {v} < {lo} THEN "
        f"CASE WHEN {v} <= {clo} THEN 0.0::DOUBLE ELSE ({v} - {clo}::DOUBLE) / ({lo}::DOUBLE - {clo}::DOUBLE) * 100.0::DOUBLE END "
        f"ELSE CASE WHEN {v} >= {chi} THEN 0.0::DOUBLE ELSE ({chi}::DOUBLE - {v}) / ({chi}::DOUBLE - {hi}::DOUBLE) * 100.0::DOUBLE END END"
    )


_ORDERED = [k for k in cp.PARAM_KEYS if k in _SUIT_PARAMS]
SUITABILITY = (
    "sparts AS (SELECT *, " + ", ".join(f"{_suit(k)} AS s_{k}" for k in _ORDERED) + " FROM tel), "
    "scomp AS (SELECT *, coalesce(list_sum([" + ", ".join(f"s_{k}" for k in _ORDERED) + "]) / nullif("
    + " + ".join(f"CASE WHEN s_{k} IS NULL THEN 0 ELSE 1 END" for k in _ORDERED) + ", 0), 0.0) AS comp FROM sparts), "
    "suit AS (SELECT *, 'maize_corn' AS crop_key, cast(printf('%.2f', comp) AS DOUBLE) AS suitability_score, "
    "CASE WHEN comp >= 70 THEN 'Good' WHEN comp >= 45 THEN 'Fair' ELSE 'Poor' END AS suitability_label FROM scomp)"
)


def _severity(parameter: str, variant: str, v: str = "value") -> str:
    key = (parameter, variant)
    if key in rs.SALINITY_CUTS:
        cuts, names, op = rs.SALINITY_CUTS[key], rs.SALINITY_SEVERITIES, "<="
    elif key in rs.ORGANIC_CUTS:
        cuts, names, op = rs.ORGANIC_CUTS[key], rs.ORGANIC_SEVERITIES, "<"
    else:
        cuts, names, op = rs.TWO_SIDED_CUTS[key], rs.TWO_SIDED, "<="
    return "CASE " + " ".join(f"WHEN {v} {op} {c} THEN '{n}'" for c, n in zip(cuts, names)) + f" ELSE '{names[-1]}' END"


def _classes(variants: dict[str, str] | None = None) -> str:
    variants = variants or {}
    return " UNION ALL ".join(
        f"SELECT event_id, '{p}' AS parameter, {i} AS pord, {c} AS value, {lo} AS opt_low, {hi} AS opt_high, {_severity(p, variants.get(p, 'default'), c)} AS severity FROM pay WHERE {c} IS NOT NULL"
        for i, (p, c, lo, hi) in enumerate(rs.DIAGNOSIS_PARAMETERS)
    )


_ISSUE_RULES = values("txt", ["parameter", "side", "grade", "issue", "t1", "t2", "decimals", "root_cause"], rs.ISSUE_TEXTS)
ISSUES = f"""classes AS ({_classes()}), {_ISSUE_RULES},
  sided AS (SELECT *, CASE WHEN value < opt_low THEN 'low' ELSE 'high' END AS side FROM classes WHERE severity <> 'Low'),
  gradedi AS (SELECT *, CASE WHEN parameter IN ('Salinity (EC)', 'Organic Matter') THEN severity
      WHEN parameter = 'pH' AND side = 'low' AND value <= 4.0 THEN 'strong' WHEN parameter = 'pH' AND side = 'high' AND value >= 8.5 THEN 'strong'
      WHEN parameter = 'Moisture' AND side = 'low' AND value <= 8.0 THEN 'strong' WHEN parameter = 'Moisture' AND side = 'high' AND value >= 35.0 THEN 'strong'
      ELSE 'plain' END AS grade FROM sided),
  issues AS (SELECT g.*, issue, root_cause, CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Moderate' THEN 3 ELSE 4 END AS srank,
      t1 || CASE WHEN decimals = 2 THEN printf('%.2f', value) ELSE printf('%.1f', value) END || t2 AS description
    FROM gradedi g JOIN txt USING (parameter, side, grade))"""

_ACTIONS = values("act", ["parameter", "side", "aord", "action", "impact", "rule", "timeline", "depends_on", "reasoning"], ra.ACTIONS)
_PLAN = f"""{_ACTIONS},
  cand AS (SELECT i.*, aord, action, impact, timeline, depends_on,
      CASE rule WHEN 'lime' THEN printf('%.1f–%.1f tons/ha', greatest(2.0, least(8.0, (opt_low - value) * 6)), greatest(2.0, least(8.0, (opt_low - value) * 6)) + 1)
        WHEN 'sulfur' THEN printf('%.0f–%.0f kg/ha', greatest(500.0, least(2000.0, (value - opt_high) * 750)), greatest(500.0, least(2000.0, (value - opt_high) * 750)) + 500)
        WHEN 'fertilizer' THEN CASE parameter WHEN 'Nitrogen' THEN printf('%.0f kg/ha of urea', (opt_low - value) * 2 / 0.46::DOUBLE)
          WHEN 'Phosphorus' THEN printf('%.0f kg/ha of superphosphate', (opt_low - value) * 2 / 0.20::DOUBLE)
          ELSE printf('%.0f kg/ha of muriate of potash', (opt_low - value) * 2 / 0.60::DOUBLE) END
        ELSE rule END AS dosage
    FROM issues i JOIN act USING (parameter, side)),
  firsts AS (SELECT *, coalesce(max(CASE WHEN parameter = 'pH' AND severity = 'Critical' THEN 1 ELSE 0 END) OVER (PARTITION BY event_id), 0) AS phc FROM cand WHERE aord = 1),
  pointed AS (SELECT *, CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 100 WHEN 'Moderate' THEN 200 ELSE 300 END
      + CASE WHEN lower(action) LIKE '%lime%' OR lower(action) LIKE '%sulfur%' THEN CASE WHEN phc = 1 THEN -50 ELSE -10 END ELSE 0 END
      + CASE WHEN lower(action) LIKE '%drainage%' OR lower(action) LIKE '%mulch%' THEN -20 ELSE 0 END
      + CASE WHEN lower(action) LIKE '%irrigation%' OR lower(action) LIKE '%moisture%' THEN -15 ELSE 0 END
      + CASE WHEN lower(action) LIKE '%fertilizer%' THEN 50 ELSE 0 END AS points FROM firsts),
  plan AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY points, srank, pord) AS priority FROM pointed)"""
_TIMELINE = "CASE coalesce(min(srank), 4) " + " ".join(f"WHEN {i + 1} THEN {literal(t)}" for i, t in enumerate(ra.TIMELINES.values())) + " END"

_VARIANTS = {"pH": "acid_loving", "Moisture": "clay", "Temperature": "cool_season", "Salinity (EC)": "tolerant"}
_ALL_VARIANTS = [*rs.TWO_SIDED_CUTS, *rs.SALINITY_CUTS, *rs.ORGANIC_CUTS]
_COLUMN = {p: c for p, c, _, _ in rs.DIAGNOSIS_PARAMETERS}

SQL = {
    "param_flags": f"""WITH {PAY}, {_PROFILE}, {_FLAGS} SELECT event_id, 'maize_corn' AS crop_key, param_key, display_name, unit, v AS value, status, direction,
        CASE WHEN v IS NOT NULL THEN cast(printf('%.3f', dev) AS DOUBLE) END AS absolute_deviation, CASE WHEN v IS NOT NULL THEN cast(printf('%.1f', rel) AS DOUBLE) END AS relative_deviation,
        direction_label, alert_summary, cast(printf('%.1f', score) AS DOUBLE) AS parameter_score FROM summaries""",
    "flagged_params": f"""WITH {PAY}, {_PROFILE}, {_FLAGS} SELECT event_id, param_key, status, direction, hint AS intervention_hint FROM flags WHERE status IN ('WARNING', 'CRITICAL')""",
    "missing_params": f"WITH {PAY}, {_PROFILE}, {_FLAGS} SELECT event_id, param_key, display_name FROM flags WHERE status = 'MISSING'",
    "field_health": f"WITH {PAY}, {_PROFILE}, {_FLAGS}, {_HEALTH} SELECT * FROM banded",
    "health_band_distribution": f"""WITH {PAY}, {_PROFILE}, {_FLAGS}, {_HEALTH} SELECT health_band, count(*) AS n,
        min(field_health_score) AS lowest, max(field_health_score) AS highest FROM banded GROUP BY health_band""",
    "field_health_from_file": f"WITH {PAY}, {_PROFILE}, {_FLAGS}, {_HEALTH} SELECT event_id, field_health_score, health_band, health_color FROM banded",
    "evaluation_reports": f"""WITH {PAY}, {_PROFILE}, {_FLAGS}, {_HEALTH},
        body AS (SELECT event_id, {_section('CRITICAL', '--- CRITICAL FLAGS (Immediate action required) ---')}
            || {_section('WARNING', '--- WARNING FLAGS (Action recommended) ---')}
            || coalesce('--- NOMINAL PARAMETERS ---' || chr(10) || string_agg('  ✓ ' || display_name || ': ' || v || ' ' || unit, chr(10) ORDER BY ord) FILTER (WHERE status = 'OK') || chr(10) || chr(10), '')
            || coalesce('--- MISSING SENSOR DATA ---' || chr(10) || string_agg('  ? ' || display_name || ': No reading received', chr(10) ORDER BY ord) FILTER (WHERE status = 'MISSING') || chr(10) || chr(10), '') AS sections
          FROM summaries GROUP BY event_id)
        SELECT event_id, '=== FIELD EVALUATION REPORT ===' || chr(10) || 'Crop Profile  : maize_corn' || chr(10)
          || 'Field Health  : ' || field_health_score || '/100 (' || health_band || ')' || chr(10)
          || 'Status        : ' || CASE WHEN requires_intervention THEN 'INTERVENTION REQUIRED' ELSE 'ALL PARAMETERS NOMINAL' END || chr(10) || chr(10)
          || sections || '=== END EVALUATION REPORT ===' AS report FROM body JOIN banded USING (event_id)""",
    "suitability_scores": f"""WITH {TEL}, {SUITABILITY} SELECT event_id, crop_key, suitability_score, suitability_label,
        cast(printf('%.2f', s_nitrogen_ppm) AS DOUBLE) AS nitrogen_score, cast(printf('%.2f', s_soil_moisture) AS DOUBLE) AS moisture_score FROM suit""",
    "suitability_distribution": f"WITH {TEL}, {SUITABILITY} SELECT suitability_label AS label, count(*) AS n FROM suit GROUP BY 1",
    "severity_classes": f"WITH {PAY}, classes AS ({_classes()}) SELECT event_id, parameter, value, severity FROM classes",
    "severity_classes_variants": f"WITH {PAY}, classes AS ({_classes(_VARIANTS)}) SELECT parameter, severity, count(*) AS n FROM classes GROUP BY ALL",
    "severity_bands": f"WITH {PAY} " + " UNION ALL ".join(
        f"SELECT '{p}' AS parameter, '{var}' AS variant, {_severity(p, var, _COLUMN[p])} AS severity, count(*) AS n FROM pay WHERE {_COLUMN[p]} IS NOT NULL GROUP BY 3"
        for p, var in _ALL_VARIANTS),
    "soil_issues": f"""WITH {PAY}, {ISSUES} SELECT event_id, parameter, issue, value AS measured_value, cast(opt_low AS DOUBLE) AS optimal_low,
        cast(opt_high AS DOUBLE) AS optimal_high, severity, side, description, root_cause FROM issues""",
    "overall_severity": f"""WITH {PAY}, classes AS ({_classes()}), w AS (SELECT event_id,
          min(CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Moderate' THEN 3 ELSE 4 END) AS m FROM classes GROUP BY event_id)
        SELECT pay.event_id, CASE m WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 3 THEN 'Moderate' ELSE 'Low' END AS overall_severity FROM pay LEFT JOIN w USING (event_id)""",
    "interactions": f"""WITH {PAY} SELECT event_id, 'ph_nitrogen' AS interaction, {literal(rs.INTERACTION_TEXTS['ph_nitrogen'])} AS text FROM pay WHERE soil_ph < 5.0 AND nitrogen_ppm > 20
        UNION ALL SELECT event_id, 'drought_heat', {literal(rs.INTERACTION_TEXTS['drought_heat'])} FROM pay WHERE soil_moisture < 15 AND soil_temperature > 30
        UNION ALL SELECT event_id, 'drought_salt', {literal(rs.INTERACTION_TEXTS['drought_salt'])} FROM pay WHERE soil_moisture < 15""",
    "candidate_actions": f"WITH {PAY}, {ISSUES}, {_PLAN} SELECT event_id, parameter, severity, action, impact, dosage, timeline, depends_on FROM cand",
    "action_plan": f"WITH {PAY}, {ISSUES}, {_PLAN} SELECT event_id, priority, parameter, severity, action, dosage, cast(points AS BIGINT) AS points FROM plan",
    "plan_summary": f"""WITH {PAY}, {ISSUES}, {_PLAN},
        per AS (SELECT event_id, count(srank) AS issues_count,
          CASE coalesce(min(srank), 4) WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 3 THEN 'Moderate' ELSE 'Low' END AS overall_severity,
          {_TIMELINE} AS expected_timeline FROM pay LEFT JOIN issues USING (event_id) GROUP BY event_id),
        mon AS (SELECT event_id, string_agg(parameter, '|' ORDER BY parameter) AS monitoring FROM
          (SELECT event_id, parameter FROM issues UNION SELECT event_id, unnest(['Moisture', 'Temperature']) FROM per) GROUP BY event_id),
        steps AS (SELECT event_id, string_agg(action, '|' ORDER BY priority) AS first_steps FROM plan WHERE priority <= 3 GROUP BY event_id)
        SELECT event_id, issues_count, overall_severity, expected_timeline, coalesce(first_steps, '') AS first_steps, monitoring
        FROM per JOIN mon USING (event_id) LEFT JOIN steps USING (event_id)""",
}
