"""Explicit schemas of every input."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names as the sensor nodes write them, and the names used here.
RAW_COLUMNS = {
    "Timestamp": "ts",
    "Node_ID": "node_id",
    "Nitrogen_mg_k": "nitrogen_mg_kg",
    "Phosphorus_m": "phosphorus_mg_kg",
    "Potassium_mg_": "potassium_mg_kg",
    "Moisture_%": "moisture_pct",
    "Temperature_C": "temperature_c",
    "Humidity_%": "humidity_pct",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Altitude_m": "altitude_m",
    "Satellites": "satellites",
    "Season": "season",
    "Target_Crop": "target_crop",
    "communication_ok": "communication_ok",
}

MEASURES = [
    "nitrogen_mg_kg", "phosphorus_mg_kg", "potassium_mg_kg", "moisture_pct", "temperature_c", "humidity_pct",
]

# Every raw field lands as text and is coerced on the way in.
RAW_TELEMETRY = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

TELEMETRY = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
     T.StructField("node_id", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in MEASURES]
    + [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
       T.StructField("satellites", T.StringType()), T.StructField("target_crop", T.StringType()),
       T.StructField("communication_ok", T.StringType())]
)

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

# Forecast file columns; the static ones are dropped before modelling.
FORECAST_FEATURES = ["temperature", "humidity", "moisture", "N", "P", "K", "Rainfall"]
FORECAST_STATICS = ["lat", "lon", "Crop", "Soil_Type", "Variety"]
FORECAST_CSV = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(name, T.DoubleType()) for name in FORECAST_FEATURES]
    + [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
       T.StructField("Crop", T.StringType()), T.StructField("Soil_Type", T.StringType()),
       T.StructField("Variety", T.StringType())]
)

_PARAMETER = T.StructType(
    [T.StructField("display_name", T.StringType()), T.StructField("unit", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("optimal_min", "optimal_max", "critical_min", "critical_max")]
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("direction_labels", "intervention_hints")]
)
_BAND = T.StructType([
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("label", T.StringType()), T.StructField("color", T.StringType()),
])
CROP_PROFILES = T.StructType([
    T.StructField("crop_profiles", T.MapType(T.StringType(), T.StructType([
        T.StructField("parameters", T.MapType(T.StringType(), _PARAMETER)),
        T.StructField("composite_health_scoring", T.StructType([
            T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("score_bands", T.MapType(T.StringType(), _BAND)),
        ])),
    ]))),
])

CONVERSATION_JSON = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
    ]))),
    T.StructField("updated_at", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()),
    T.StructField("chunk_index", T.IntegerType()), T.StructField("char_count", T.IntegerType()),
    T.StructField("extraction_method", T.StringType()),
])
