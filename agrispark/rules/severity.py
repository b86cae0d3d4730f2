"""Severity cut points and the diagnosis texts attached to them."""

from __future__ import annotations

# Severities, worst first.
SEVERITIES = ["Critical", "High", "Moderate", "Low"]

# Severities met while walking up the cut points; "Low" is the optimal range.
TWO_SIDED = ["Critical", "High", "Moderate", "Moderate", "Low", "Moderate", "High", "Critical"]

# Upper-inclusive cut points per (parameter, variant).
TWO_SIDED_CUTS = {
    ("Nitrogen", "default"): [5.0, 10.0, 15.0, 20.0, 40.0, 60.0, 80.0],
    ("Phosphorus", "default"): [2.0, 5.0, 8.0, 10.0, 30.0, 50.0, 70.0],
    ("Potassium", "default"): [30.0, 50.0, 80.0, 100.0, 200.0, 300.0, 400.0],
    ("pH", "default"): [4.0, 4.5, 5.0, 6.0, 7.0, 7.5, 8.0],
    ("pH", "acid_loving"): [4.0, 4.2, 4.5, 4.8, 5.5, 6.0, 6.5],
    ("Moisture", "default"): [5.0, 8.0, 12.0, 15.0, 22.0, 28.0, 35.0],
    ("Moisture", "clay"): [8.0, 12.0, 16.0, 20.0, 30.0, 38.0, 45.0],
    ("Temperature", "default"): [10.0, 12.0, 15.0, 18.0, 30.0, 35.0, 40.0],
    ("Temperature", "cool_season"): [0.0, 3.0, 8.0, 12.0, 25.0, 32.0, 35.0],
}

# Salinity rises from optimal, upper-inclusive.
SALINITY_SEVERITIES = ["Low", "Moderate", "High", "Critical"]
SALINITY_CUTS = {
    ("Salinity (EC)", "default"): [1.0, 1.5, 2.5],
    ("Salinity (EC)", "sensitive"): [0.7, 1.0, 1.5],
    ("Salinity (EC)", "tolerant"): [2.0, 3.0, 4.5],
}

# Organic matter, each cut point belongs to the better class.
ORGANIC_SEVERITIES = ["Critical", "High", "Moderate", "Low"]
ORGANIC_CUTS = {("Organic Matter", "default"): [1.0, 1.5, 2.0]}

# Parameters in diagnosis order with reading column and optimal range.
DIAGNOSIS_PARAMETERS = [
    ("pH", "soil_ph", 6.0, 7.0),
    ("Nitrogen", "nitrogen_ppm", 20.0, 40.0),
    ("Phosphorus", "phosphorus_ppm", 10.0, 30.0),
    ("Potassium", "potassium_ppm", 100.0, 200.0),
    ("Moisture", "soil_moisture", 15.0, 22.0),
    ("Temperature", "soil_temperature", 18.0, 30.0),
    ("Salinity (EC)", "electrical_conductivity", 0.0, 1.0),
    ("Organic Matter", "organic_matter_percent", 2.0, 5.0),
]

# At or beyond these edges the issue takes its stronger name (low edge, high edge).
STRONG_EDGES = {"pH": (4.0, 8.5), "Moisture": (8.0, 35.0)}

# Parameters whose issue name follows the severity instead of an edge.
GRADED_BY_SEVERITY = ("Salinity (EC)", "Organic Matter")

# Fixed values: (parameter, side, grade, issue, text before the value, text after it, decimals, cause)
ISSUE_TEXTS = [
    ("pH", "low", "plain", "Acidic Soil", "Soil pH is ",
     ", which is below the optimal range. Acidic conditions reduce nutrient availability and may inhibit root growth.",
     1, "Natural soil type, organic acid accumulation, or excessive acid rain"),
    ("pH", "low", "strong", "Critically Acidic Soil", "Soil pH is ",
     ", which is below the optimal range. Acidic conditions reduce nutrient availability and may inhibit root growth.",
     1, "Natural soil type, organic acid accumulation, or excessive acid rain"),
    ("pH", "high", "plain", "Alkaline Soil", "Soil pH is ",
     ", which is above the optimal range. Alkaline conditions can lock up micronutrients and reduce their availability.",
     1, "High limestone content, calcite deposits, or excessive irrigation water"),
    ("pH", "high", "strong", "Critically Alkaline Soil", "Soil pH is ",
     ", which is above the optimal range. Alkaline conditions can lock up micronutrients and reduce their availability.",
     1, "High limestone content, calcite deposits, or excessive irrigation water"),
    ("Nitrogen", "low", "plain", "Nitrogen Deficiency", "Nitrogen concentration is ",
     " ppm, below the optimal range (20.0–40.0 ppm). Plants will show growth stunting and reduced yield.",
     1, "Soil naturally low in Nitrogen, or excessive leaching due to high rainfall or irrigation"),
    ("Nitrogen", "high", "plain", "Nitrogen Excess", "Nitrogen concentration is ",
     " ppm, above the optimal range. High levels can cause nutrient imbalances and reduce crop quality.",
     1, "Over-fertilization or repeated heavy applications of Nitrogen-rich manure"),
    ("Phosphorus", "low", "plain", "Phosphorus Deficiency", "Phosphorus concentration is ",
     " ppm, below the optimal range (10.0–30.0 ppm). Plants will show growth stunting and reduced yield.",
     1, "Soil naturally low in Phosphorus, or excessive leaching due to high rainfall or irrigation"),
    ("Phosphorus", "high", "plain", "Phosphorus Excess", "Phosphorus concentration is ",
     " ppm, above the optimal range. High levels can cause nutrient imbalances and reduce crop quality.",
     1, "Over-fertilization or repeated heavy applications of Phosphorus-rich manure"),
    ("Potassium", "low", "plain", "Potassium Deficiency", "Potassium concentration is ",
     " ppm, below the optimal range (100.0–200.0 ppm). Plants will show growth stunting and reduced yield.",
     1, "Soil naturally low in Potassium, or excessive leaching due to high rainfall or irrigation"),
    ("Potassium", "high", "plain", "Potassium Excess", "Potassium concentration is ",
     " ppm, above the optimal range. High levels can cause nutrient imbalances and reduce crop quality.",
     1, "Over-fertilization or repeated heavy applications of Potassium-rich manure"),
    ("Moisture", "low", "plain", "Drought Stress", "Soil moisture is ",
     "%, below the optimal range. Plants will experience water stress, reduced growth, and potential yield loss.",
     1, "Insufficient rainfall, poor irrigation, or high evaporation rates"),
    ("Moisture", "low", "strong", "Severe Drought", "Soil moisture is ",
     "%, below the optimal range. Plants will experience water stress, reduced growth, and potential yield loss.",
     1, "Insufficient rainfall, poor irrigation, or high evaporation rates"),
    ("Moisture", "high", "plain", "Waterlogging", "Soil moisture is ",
     "%, above the optimal range. Excess water reduces oxygen availability, inhibiting root respiration and promoting disease.",
     1, "Poor drainage, excessive rainfall, or over-irrigation"),
    ("Moisture", "high", "strong", "Severe Waterlogging", "Soil moisture is ",
     "%, above the optimal range. Excess water reduces oxygen availability, inhibiting root respiration and promoting disease.",
     1, "Poor drainage, excessive rainfall, or over-irrigation"),
    ("Temperature", "low", "plain", "Cold Stress", "Soil temperature is ",
     "°C, below optimal. Microbial activity and nutrient mineralization are reduced.",
     1, "Seasonal variation or lack of organic matter/mulch cover"),
    ("Temperature", "high", "plain", "Heat Stress", "Soil temperature is ",
     "°C, above optimal. High temperatures can damage root systems and promote pathogenic organisms.",
     1, "Seasonal variation or lack of organic matter/mulch cover"),
    ("Salinity (EC)", "high", "Moderate", "Mild Salinity", "Electrical conductivity is ",
     " dS/m. Some salt-sensitive crops may show stress.",
     2, "Poor irrigation water quality, salt accumulation, or saline groundwater intrusion"),
    ("Salinity (EC)", "high", "High", "Moderate Salinity", "Electrical conductivity is ",
     " dS/m. Most crops will show reduced growth.",
     2, "Poor irrigation water quality, salt accumulation, or saline groundwater intrusion"),
    ("Salinity (EC)", "high", "Critical", "High Salinity", "Electrical conductivity is ",
     " dS/m. Severe salt stress affecting most crops.",
     2, "Poor irrigation water quality, salt accumulation, or saline groundwater intrusion"),
    ("Organic Matter", "low", "Moderate", "Low Organic Matter", "Organic matter is ",
     "%. Low organic matter reduces soil structure, water retention, and nutrient availability.",
     1, "Insufficient crop residue incorporation, limited manure application, or erosion"),
    ("Organic Matter", "low", "High", "Very Low Organic Matter", "Organic matter is ",
     "%. Low organic matter reduces soil structure, water retention, and nutrient availability.",
     1, "Insufficient crop residue incorporation, limited manure application, or erosion"),
    ("Organic Matter", "low", "Critical", "Critically Low Organic Matter", "Organic matter is ",
     "%. Low organic matter reduces soil structure, water retention, and nutrient availability.",
     1, "Insufficient crop residue incorporation, limited manure application, or erosion"),
]

# Interaction limits and texts.
INTERACTION_LIMITS = {"ph_below": 5.0, "nitrogen_above": 20.0, "moisture_below": 15.0, "temperature_above": 30.0}
INTERACTION_TEXTS = {
    "ph_nitrogen": "CRITICAL: Acidic pH (4.8) locks up available nitrogen. "
                   "Even adequate nitrogen levels will not be plant-available until pH is corrected.",
    "drought_heat": "CRITICAL: Combined drought and heat stress. High temperature increases evaporation "
                    "and exacerbates water stress. Priority: Restore moisture before correcting other issues.",
    "drought_salt": "Drought stress reduces salt leaching. Once moisture is restored, "
                    "plan salt remediation through managed leaching.",
}
