"""Crop threshold profile, weights and score bands."""

from __future__ import annotations

DEFAULT_CROP = "maize_corn"

# The maize/corn profile. One row per parameter, in profile order:
# (param_key, display_name, unit, optimal_min, optimal_max, critical_min, critical_max,
#  low label, high label, low hint, high hint, nominal hint)
MAIZE_PARAMETERS = [
    ("soil_ph", "Soil pH", "pH", 5.8, 7.0, 5.0, 8.0, "acidic", "alkaline",
     "Apply lime or organic matter to raise pH gradually.",
     "Apply sulfur or acidifying amendments to lower pH gradually.",
     "Maintain current management and monitor trends."),
    ("soil_moisture", "Soil Moisture", "%", 40.0, 70.0, 20.0, 85.0, "dry", "waterlogged",
     "Increase irrigation frequency and monitor root-zone moisture.",
     "Improve drainage and reduce irrigation to prevent waterlogging.",
     "Maintain current irrigation scheduling."),
    ("soil_temperature", "Soil Temperature", "°C", 18.0, 32.0, 10.0, 40.0, "cold", "hot",
     "Use mulching or delayed planting to warm the root-zone.",
     "Increase shading or irrigation to cool the root-zone.",
     "Maintain current thermal conditions."),
    ("nitrogen_ppm", "Available Nitrogen (N)", "ppm", 20.0, 45.0, 10.0, 60.0, "deficient", "excessive",
     "Apply nitrogen fertilizer in split doses and monitor leaf color.",
     "Reduce nitrogen input and manage runoff to prevent leaching.",
     "Maintain current fertility management."),
    ("phosphorus_ppm", "Phosphorus", "ppm", 15.0, 30.0, 5.0, 50.0, "deficient", "excessive",
     "Apply phosphate fertilizer based on soil test recommendations.",
     "Reduce phosphorus application and avoid over-fertilization.",
     "Maintain current phosphorus management."),
    ("potassium_ppm", "Potassium", "ppm", 120.0, 280.0, 55.0, 400.0, "deficient", "excessive",
     "Apply potassium fertilizer and monitor tissue levels.",
     "Reduce potassium application to avoid luxury uptake and runoff.",
     "Maintain current potassium management."),
    ("electrical_conductivity", "Electrical Conductivity", "dS/m", 0.5, 1.8, 0.2, 3.0, "low salinity", "saline",
     "Check nutrient availability and adjust fertilization carefully.",
     "Improve drainage and leach excess salts where appropriate.",
     "Maintain current salinity monitoring."),
    ("organic_matter_percent", "Organic Matter", "%", 3.0, 6.0, 1.0, 8.0, "depleted", "excessive",
     "Add compost or cover crops to raise organic matter.",
     "Reduce residue accumulation and maintain balanced organic inputs.",
     "Maintain current soil organic matter practices."),
    ("ambient_humidity", "Ambient Humidity", "%", 45.0, 80.0, 25.0, 95.0, "dry", "humid",
     "Monitor transpiration stress and adjust irrigation accordingly.",
     "Increase air circulation and manage disease pressure.",
     "Maintain current environmental monitoring."),
    ("ambient_temperature", "Ambient Temperature", "°C", 22.0, 33.0, 15.0, 40.0, "cool", "hot",
     "Use protective cover or adjust planting timing.",
     "Increase shade and irrigation to reduce heat stress.",
     "Maintain current temperature monitoring."),
]

# Label used for readings inside the optimal range.
NOMINAL_LABEL = "within optimal range"

# Score bands, inclusive at both ends (band, min, max, label, colour).
SCORE_BANDS = [
    ("EXCELLENT", 85.0, 100.0, "Excellent", "#27ae60"),
    ("GOOD", 70.0, 84.9, "Good", "#2ecc71"),
    ("FAIR", 50.0, 69.9, "Fair", "#f1c40f"),
    ("POOR", 25.0, 49.9, "Poor", "#e67e22"),
    ("CRITICAL", 0.0, 24.9, "Critical", "#e74c3c"),
]

# Every parameter carries the same weight.
PARAMETER_WEIGHT = 1.0

# Accepted spellings of a crop name.
CROP_ALIASES = {
    "maize": "maize_corn",
    "corn": "maize_corn",
    "maize_corn": "maize_corn",
    "maize/corn": "maize_corn",
}

# Sensor column -> profile parameter, in model feature order.
SENSOR_PARAMETERS = {
    "nitrogen_mg_kg": "nitrogen_ppm",
    "phosphorus_mg_kg": "phosphorus_ppm",
    "potassium_mg_kg": "potassium_ppm",
    "moisture_pct": "soil_moisture",
    "temperature_c": "soil_temperature",
    "humidity_pct": "ambient_humidity",
}

FEATURES = list(SENSOR_PARAMETERS)
PARAM_KEYS = [row[0] for row in MAIZE_PARAMETERS]

# Suitability class edges and label order.
SUITABILITY_LABELS = ["Poor", "Fair", "Good"]
GOOD_MIN = 70.0
FAIR_MIN = 45.0
