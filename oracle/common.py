"""Shared pieces of SQL."""

from __future__ import annotations

from agrispark.rules import limits
from agrispark.sources.telemetry import EVENT_EXTRA_EXPRS, EVENT_READING_EXPRS

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
MEASURES = ["nitrogen_mg_kg", "phosphorus_mg_kg", "potassium_mg_kg", "moisture_pct", "temperature_c", "humidity_pct"]


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"cast({value!r} as double)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def _exprs(exprs: list[str]) -> str:
    return ", ".join(e.format(STR="varchar") for e in exprs)


TEL = f"tel AS (SELECT {_exprs(EVENT_READING_EXPRS)} FROM events)"
_NAMES = {
    "nitrogen_mg_kg": "nitrogen_ppm", "phosphorus_mg_kg": "phosphorus_ppm", "potassium_mg_kg": "potassium_ppm",
    "moisture_pct": "soil_moisture", "temperature_c": "soil_temperature", "humidity_pct": "ambient_humidity",
}
PAY = (
    f"raw AS (SELECT {_exprs(EVENT_READING_EXPRS + EVENT_EXTRA_EXPRS)} FROM events), "
    "pay AS (SELECT event_id, ts, node_id, target_crop, "
    + ", ".join(f"{a} AS {b}" for a, b in _NAMES.items())
    + ", soil_ph, electrical_conductivity, organic_matter_percent, ambient_temperature FROM raw)"
)
LATEST = (
    "latest AS (SELECT * FROM tel WHERE node_id IS NOT NULL AND node_id <> '' "
    "QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) = 1)"
)


def unpivot(source: str, keys: list[str], columns: list[str], name: str = "col", value: str = "v") -> str:
    return " UNION ALL ".join(
        f"SELECT {', '.join(keys)}, '{c}' AS {name}, {c} AS {value} FROM {source}" for c in columns
    )


LIMITS = values(
    "lim", ["metric", "label", "unit", "col", "lo", "hi", "low_advice", "high_advice"], limits.ALERT_LIMITS
)
