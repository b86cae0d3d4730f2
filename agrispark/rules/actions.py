"""Corrective actions, dosage parameters and ranking weights."""

from __future__ import annotations

# Fixed values: (parameter, side, order, action, impact, dosage rule or text, timeline, depends on, reasoning)
ACTIONS = [
    ("pH", "low", 1, "Apply agricultural lime (CaCO₃)", "High", "lime", "Before next planting cycle", None,
     "Lime neutralizes soil acidity and raises pH to optimal range for nutrient availability."),
    ("pH", "high", 1, "Apply elemental sulfur (S)", "High", "sulfur", "2–3 weeks before planting", None,
     "Sulfur oxidation lowers pH. Slow-acting but long-lasting."),
    ("Nitrogen", "low", 1, "Apply nitrogen fertilizer (urea or ammonium nitrate)", "High", "fertilizer",
     "At planting or early vegetative stage", "pH correction must be completed first if acidic.",
     "Nitrogen is mobile and readily leached. Apply in split doses during growing season."),
    ("Phosphorus", "low", 1, "Apply phosphorus fertilizer (superphosphate or rock phosphate)", "High", "fertilizer",
     "Pre-plant or at planting", None,
     "Phosphorus is relatively immobile. Apply before planting for full-season availability."),
    ("Potassium", "low", 1, "Apply potassium fertilizer (muriate of potash or potassium nitrate)", "Moderate", "fertilizer",
     "At planting or early growth", None,
     "Potassium supports plant vigor and disease resistance. Apply in split doses if high rates needed."),
    ("Moisture", "low", 1, "Increase irrigation frequency or duration", "High",
     "Target 20–25% volumetric water content", "Immediate, maintain throughout growing season", None,
     "Adequate moisture is critical for nutrient uptake and plant function."),
    ("Moisture", "low", 2, "Apply organic mulch (2–4 cm layer)", "Moderate",
     "2–4 cm of organic material (straw, compost)", "After rain or irrigation", None,
     "Mulch reduces evaporation and maintains consistent soil moisture."),
    ("Moisture", "high", 1, "Improve soil drainage (raised beds, drainage tiles, or aeration)", "High",
     None, "Before next planting cycle", None,
     "Excess water suffocates roots. Drainage is structural and must be fixed before planting."),
    ("Temperature", "low", 1, "Mulch soil surface to retain heat", "Moderate", None, None, None,
     "Dark mulch absorbs and retains solar heat."),
    ("Temperature", "high", 1, "Increase irrigation and apply reflective mulch", "Moderate", None, None, None,
     "Water and light-colored mulch cool the soil by evaporation and reflection."),
    ("Salinity (EC)", "high", 1, "Increase irrigation to leach salts downward", "High",
     "30–50% more water than normal irrigation", "Before planting or immediately if already growing", None,
     "Salt leaching requires drainage. Excess water is applied to move salts below root zone."),
    ("Salinity (EC)", "high", 2, "Use low-salinity irrigation water source if available", "High", None, None, None,
     "High-salt irrigation water perpetuates the problem. Switch to better source if possible."),
    ("Organic Matter", "low", 1, "Incorporate crop residues and apply compost or aged manure", "Moderate",
     "5–10 tons/ha of compost or well-rotted manure annually", "Before planting, continue annually", None,
     "Organic matter improves structure, water retention, and nutrient cycling. Build organic matter over time."),
]

# Lime and sulfur per pH unit with lower and upper clamp and range width.
LIME = {"per_unit": 6.0, "least": 2.0, "most": 8.0, "span": 1.0}
SULFUR = {"per_unit": 750.0, "least": 500.0, "most": 2000.0, "span": 500.0}

# Kg of pure nutrient per ppm, then share of nutrient in the product.
KG_PER_PPM = 2.0
FERTILIZERS = {
    "Nitrogen": (0.46, "urea"),
    "Phosphorus": (0.20, "superphosphate"),
    "Potassium": (0.60, "muriate of potash"),
}

# Base points per severity, then keyword adjustments of the action ranking.
SEVERITY_POINTS = {"Critical": 0, "High": 100, "Moderate": 200, "Low": 300}
PH_WORDS = ("lime", "sulfur")
PH_POINTS_CRITICAL, PH_POINTS = -50, -10
STRUCTURE_WORDS, STRUCTURE_POINTS = ("drainage", "mulch"), -20
WATER_WORDS, WATER_POINTS = ("irrigation", "moisture"), -15
FERTILIZER_WORDS, FERTILIZER_POINTS = ("fertilizer",), 50

# Expected timeline per worst severity.
TIMELINES = {
    "Critical": "2–4 weeks for immediate interventions; 1–2 months for full correction",
    "High": "1–2 months with consistent management",
    "Moderate": "2–4 months for full correction",
    "Low": "Ongoing monitoring; improvements expected within growing season",
}

# How many actions are first steps, and what is monitored in any case.
FIRST_STEPS = 3
ALWAYS_MONITORED = ("Moisture", "Temperature")
