"""Intent lexicon, routing table, activation lists and measurement patterns."""

from __future__ import annotations

# Intents in order with their (keyword, weight) pairs.
INTENT_KEYWORDS = {
    "general_knowledge": [
        ("what is", 1.0), ("how does", 1.0), ("explain", 1.0), ("define", 1.5),
        ("tell me about", 1.0), ("describe", 1.0), ("what are", 1.0), ("basics", 1.0),
        ("introduction", 1.0), ("overview", 1.0), ("farming practices", 2.0),
        ("agriculture fundamentals", 3.0), ("soil science", 3.0),
    ],
    "intercropping": [
        ("plant alongside", 4.0), ("companion planting", 5.0), ("intercrop", 5.0),
        ("plant together", 4.0), ("with maize", 3.0), ("with corn", 3.0),
        ("plant with", 2.0), ("compatible crops", 4.0), ("crop combination", 4.5),
        ("mixed cropping", 5.0), ("polyculture", 5.0), ("associate", 2.0),
        ("alongside", 2.0), ("rotate", 2.0), ("succession planting", 4.0),
        ("growing together", 3.0), ("partner crop", 4.0),
    ],
    "crop_selection": [
        ("what should i plant", 3.5), ("best crop", 3.0), ("suitable crop", 3.5),
        ("grow", 1.0), ("what to plant", 3.0), ("crop for", 2.0), ("which crop", 2.5),
        ("plant for", 2.0), ("growing season", 2.5), ("crop choice", 3.5),
        ("cultivar selection", 4.5), ("variety recommendation", 4.5),
        ("best variety", 3.5), ("should i grow", 3.0), ("plant in this soil", 3.0),
        ("variety", 3.0), ("suited for", 3.0), ("best suited", 3.5),
    ],
    "soil_diagnosis": [
        ("soil condition", 3.5), ("soil is", 2.0), ("my soil", 2.0),
        ("soil problem", 3.5), ("soil issue", 3.5), ("what's wrong with", 2.5),
        ("diagnose soil", 5.0), ("soil analysis", 4.0), ("acidic soil", 3.5),
        ("alkaline soil", 3.5), ("poor soil", 2.5), ("soil quality", 3.0),
        ("heavy clay", 3.0), ("sandy soil", 3.0), ("compacted soil", 3.5),
        ("waterlogged", 3.0), ("soil health", 3.0),
    ],
    "sensor_analysis": [
        ("sensor", 4.0), ("telemetry", 5.0), ("reading", 2.5), ("ph:", 4.0),
        ("nitrogen:", 4.0), ("phosphorus:", 4.0), ("potassium:", 4.0),
        ("moisture:", 4.0), ("temperature:", 3.5), ("salinity:", 4.0),
        ("ec:", 4.0), ("ppm", 3.0), ("percent", 1.5), ("degree", 1.5),
        ("data from sensor", 4.5), ("sensor shows", 4.5), ("my sensor says", 4.5),
        ("interpret data", 4.0), ("node_id", 4.5), ("hardware node", 4.5),
    ],
    "fertilizer_recommendation": [
        ("fertilizer", 4.5), ("fertilize", 4.0), ("nutrient", 3.0),
        ("nitrogen", 2.0), ("phosphorus", 2.0), ("potassium", 2.0),
        ("npk", 5.0), ("manure", 3.5), ("compost", 3.0), ("amendment", 3.5),
        ("deficiency", 3.0), ("feed", 1.5), ("boost", 1.5), ("enhance growth", 2.0),
        ("nutrient boost", 3.5), ("application rate", 4.0), ("dosage", 3.5),
        ("chemical fertilizer", 4.0), ("organic fertilizer", 4.0),
    ],
    "disease_diagnosis": [
        ("disease", 4.0), ("pest", 4.0), ("infection", 3.5), ("sick plant", 4.0),
        ("leaves yellow", 3.5), ("spots on leaves", 4.0), ("wilting", 3.0),
        ("blight", 4.5), ("rust", 3.5), ("mold", 3.5), ("insect", 3.0),
        ("bug", 2.0), ("infestation", 4.0), ("fungal", 4.0), ("bacterial", 4.0),
        ("viral", 4.0), ("symptom", 4.0), ("illness", 3.5), ("damage pattern", 4.0),
        ("powdery mildew", 5.0), ("aphid", 4.5), ("caterpillar", 4.0),
    ],
    "yield_optimization": [
        ("yield", 4.0), ("productivity", 3.5), ("increase yield", 4.5),
        ("improve yield", 4.5), ("maximize production", 4.5), ("higher yield", 4.0),
        ("better harvest", 3.5), ("optimize", 2.5), ("efficiency", 2.0),
        ("production rate", 3.0), ("yield per hectare", 4.5), ("crop performance", 3.5),
        ("growth rate", 2.5), ("maximize", 2.0),
    ],
    "irrigation": [
        ("irrigation", 5.0), ("water", 1.5), ("watering", 2.0),
        ("drought", 2.5), ("drainage", 3.0), ("flooding", 2.5),
        ("water schedule", 4.0), ("irrigation schedule", 5.0), ("how often water", 4.0),
        ("water frequency", 4.0), ("water depth", 3.5), ("field capacity", 4.5),
        ("wilting point", 4.5), ("sprinkler", 3.5), ("drip system", 4.5),
    ],
    "weather_advice": [
        ("weather", 4.0), ("rain", 2.0), ("rainfall", 2.5), ("forecast", 4.0),
        ("season", 2.0), ("climate", 3.0), ("frost", 3.5), ("monsoon", 4.5),
        ("wind", 2.0), ("humidity", 2.5), ("sunny", 2.0), ("cloudy", 2.0),
        ("seasonal", 2.5), ("climate suitability", 4.0), ("growing period", 3.0),
        ("frost risk", 4.5),
    ],
}

# Weight of a keyword given without one, and the confidence scale.
BARE_KEYWORD_WEIGHT = 2.0
CONFIDENCE_BASE, CONFIDENCE_SPAN, CONFIDENCE_FULL_WEIGHT = 0.3, 0.7, 6.0
FALLBACK_INTENT = "general_knowledge"
FALLBACK_CONFIDENCE, EMPTY_CONFIDENCE = 0.3, 0.5
SECONDARY_GAP = 0.15

# Intent -> response mode.
INTENT_MODES = {
    "general_knowledge": "general_mode",
    "intercropping": "intercropping_mode",
    "crop_selection": "general_mode",
    "soil_diagnosis": "diagnostic_mode",
    "sensor_analysis": "diagnostic_mode",
    "fertilizer_recommendation": "diagnostic_mode",
    "disease_diagnosis": "diagnostic_mode",
    "yield_optimization": "general_mode",
    "irrigation": "general_mode",
    "weather_advice": "general_mode",
}

# Mode -> (format, needs context, needs diagnostics, memory preference).
MODE_ATTRIBUTES = {
    "general_mode": ("natural", True, False, "minimal"),
    "intercropping_mode": ("structured", True, False, "minimal"),
    "diagnostic_mode": ("structured", True, True, "selective"),
}

# Substrings and patterns that activate diagnosis.
TELEMETRY_WORDS = ["node_", "telemetry", "sensor node", "live data"]
SENSOR_VALUE_WORDS = ["ph:", "nitrogen:", "phosphorus:", "potassium:", "moisture:", "temp:"]
SYMPTOM_WORDS = [
    "yellow", "wilt", "spot", "blight", "pest", "rot", "insect", "bug",
    "mold", "fungus", "bacterial", "infestation", "sick", "damage", "rust",
    "dying", "pale", "stunt", "chewed", "curl", "lesion", "spots",
]
MEASUREMENT_ACTIVATION = [
    r"ph\s*(?:of|is|:)?\s*[\d.]+",
    r"nitrogen\s*(?:of|is|:)?\s*[\d.]+",
    r"phosphorus\s*(?:of|is|:)?\s*[\d.]+",
    r"potassium\s*(?:of|is|:)?\s*[\d.]+",
    r"moisture\s*(?:of|is|:)?\s*[\d.]+\s*%",
    r"[\d.]+\s*(?:ppm|%|celsius|°c|ds/m)",
]

# Words announcing each measurement; the number may follow ':' or '='.
MEASUREMENT_WORDS = {
    "ph": "ph",
    "nitrogen": "nitrogen|n",
    "phosphorus": "phosphorus|phosphate",
    "potassium": "potassium|potash",
    "moisture": "moisture|soil moisture",
    "temperature": "temperature|temp",
    "salinity": "salinity|ec|conductivity",
    "organic_matter": "organic matter|om",
}
LEAST_MEASUREMENTS = 3


def measurement_pattern(words: str) -> str:
    """The number is the last group; the words must start at a word boundary."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + words + r")\s*[:=]?\s*([0-9.]+)"


# Conversation rules.
CONVERSATION_ROLES = ["user", "assistant"]
CONVERSATION_ID = "^[A-Za-z0-9_-]{8,64}$"
STORED_MESSAGES = 48
HISTORY_MESSAGES = 6
HISTORY_FALLBACK = 2
HISTORY_WORD_LENGTH = 3
HISTORY_FEW_WORDS = 2
