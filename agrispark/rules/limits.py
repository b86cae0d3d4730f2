"""Alert limits, metric ranges and node-status limits of the live views."""

from __future__ import annotations

# Fixed values: (metric, label, unit, reading column, min, max, advice when low, advice when high)
ALERT_LIMITS = [
    ("nitrogen", "Nitrogen", "mg/kg", "nitrogen_mg_kg", 20.0, 50.0,
     "Inspect nutrient availability and plan a measured nitrogen application.",
     "Pause further nitrogen application and check for over-fertilisation or runoff risk."),
    ("phosphorus", "Phosphorus", "mg/kg", "phosphorus_mg_kg", 30.0, 75.0,
     "Confirm the soil test and plan phosphorus correction for the affected zone.",
     "Avoid additional phosphorus until the next soil review."),
    ("potassium", "Potassium", "mg/kg", "potassium_mg_kg", 150.0, 260.0,
     "Review potassium availability and consider a targeted correction.",
     "Hold potassium inputs and confirm the reading with a follow-up test."),
    ("moisture", "Soil moisture", "%", "moisture_pct", 25.0, 65.0,
     "Inspect irrigation and plant stress in this zone before watering.",
     "Check for standing water, drainage issues, and avoid additional irrigation."),
    ("temperature", "Temperature", "°C", "temperature_c", 18.0, 30.0,
     "Inspect crops for cold stress and protect vulnerable plants where possible.",
     "Check for heat stress and review irrigation timing or shading."),
    ("humidity", "Humidity", "%", "humidity_pct", 30.0, 85.0,
     "Check whether dry air is increasing crop water demand.",
     "Monitor for conditions that can increase disease pressure."),
]

# A breach is critical beyond this share of the limit, at least this much.
CRITICAL_MARGIN_SHARE = 0.2
CRITICAL_MARGIN_FLOOR = 1.0

# Fixed values: (reading column, good low, good high, fair low, fair high) of the node cards.
METRIC_RANGES = [
    ("nitrogen_mg_kg", 25.0, 50.0, 15.0, 60.0),
    ("phosphorus_mg_kg", 40.0, 65.0, 30.0, 75.0),
    ("potassium_mg_kg", 180.0, 230.0, 150.0, 260.0),
    ("moisture_pct", 35.0, 55.0, 25.0, 65.0),
    ("temperature_c", 22.0, 26.0, 18.0, 30.0),
]

# Node status limits for nitrogen and moisture, and map layer limits.
STATUS_NITROGEN = (20.0, 30.0)
STATUS_MOISTURE = (25.0, 35.0)
MAP_LOW_MOISTURE = 30.0
MAP_LOW_NITROGEN = 25.0

# Rows fetched by each recent-rows view, and history lengths of the models.
RECENT_ROWS = {"nodes": 100, "dashboard": 300, "alerts": 500, "map": 1000, "snapshot": 500}
SUITABILITY_HISTORY = 24
FORECAST_HISTORY = 48
FORECAST_HORIZON = 24
