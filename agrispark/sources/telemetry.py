"""Telemetry readers and the canonical reading shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrispark import schemas
from agrispark.functions.numeric import to_number
from agrispark.session import spread

# Readings derived from the events table. Integer arithmetic and one division by ten, so that any
# engine produces the same doubles; {STR} is the engine's text type.
EVENT_READING_EXPRS = [
    "event_id",
    "ts",
    "'NODE_'||lpad(cast(user_id as {STR}), cast(greatest(4, length(cast(user_id as {STR}))) as int), '0') as node_id",
    "case when event_id%97=0 then null else cast((event_id*37)%800  as double)/cast(10 as double) end as nitrogen_mg_kg",
    "case when event_id%89=0 then null else cast((event_id*53)%900  as double)/cast(10 as double) end as phosphorus_mg_kg",
    "case when event_id%83=0 then null else cast((event_id*71)%4500 as double)/cast(10 as double) end as potassium_mg_kg",
    "case when event_id%79=0 then null else cast((event_id*29)%1000 as double)/cast(10 as double) end as moisture_pct",
    "case when event_id%73=0 then null else cast((event_id*17)%450  as double)/cast(10 as double) end as temperature_c",
    "case when event_id%71=0 then null else cast((event_id*43)%1000 as double)/cast(10 as double) end as humidity_pct",
    "cast(8481000+(user_id%50)*500 as double)/cast(1000000 as double) as latitude",
    "cast(4541000+(user_id%50)*500 as double)/cast(1000000 as double) as longitude",
    "case when event_id%11=0 then 'ERR' else cast(4+event_id%5 as {STR}) end as satellites",
    "case user_id%5 when 0 then 'Maize' when 1 then ' Corn ' when 2 then 'Cassava' when 3 then 'maize/corn' else null end as target_crop",
    "case when event_id%50=0 then 'false' when event_id%3=0 then 'true' else null end as communication_ok",
]

# The four measurements the sensor nodes do not carry, same style.
EVENT_EXTRA_EXPRS = [
    "case when event_id%67=0 then null else cast((event_id*13)%70+30 as double)/cast(10 as double) end as soil_ph",
    "case when event_id%61=0 then null else cast((event_id*31)%40 as double)/cast(10 as double) end as electrical_conductivity",
    "case when event_id%59=0 then null else cast((event_id*19)%90 as double)/cast(10 as double) end as organic_matter_percent",
    "case when event_id%53=0 then null else cast((event_id*23)%450 as double)/cast(10 as double) end as ambient_temperature",
]


def readings_from_events(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Readings in canonical shape from ``events.parquet``; unused columns are pruned by the scan.

    ``heavy`` spreads a scan of few partitions over all cores.
    """
    events = spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet")
    if heavy:
        events = spread(events, "event_id")
    return events.selectExpr(*[e.format(STR="string") for e in EVENT_READING_EXPRS])


def payloads_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-parameter payloads: the six sensor measures under their profile names plus four more."""
    events = spread(spark.read.schema(schemas.EVENTS).parquet(f"{sf_dir}/events.parquet"), "event_id")
    wide = events.selectExpr(*[e.format(STR="string") for e in EVENT_READING_EXPRS + EVENT_EXTRA_EXPRS])
    return sensor_to_profile_names(wide)


def sensor_to_profile_names(readings: DataFrame) -> DataFrame:
    """Sensor columns renamed to profile parameters."""
    from agrispark.rules.crop_profile import SENSOR_PARAMETERS

    return readings.withColumnsRenamed(SENSOR_PARAMETERS)


def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Batch scan of a raw telemetry table (parquet, json, csv, orc or jdbc) in canonical shape."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("json", "csv"):
        reader = reader.schema(schemas.RAW_TELEMETRY)
    return canonical(reader.load(path) if fmt != "jdbc" else reader.load())


def canonical(raw: DataFrame) -> DataFrame:
    """Rename raw columns, coerce measures, parse the timestamp. Absent columns become NULL."""
    present = set(raw.columns)

    def field(raw_name: str, name: str) -> Column:
        if raw_name not in present:
            return F.lit(None).cast("double" if name in _NUMERIC else "string").alias(name)
        col = F.col(f"`{raw_name}`")
        if name in _NUMERIC:
            return to_number(col.cast("string")).alias(name)
        if name == "ts":
            return col.cast("string").try_cast("timestamp_ntz").alias(name)
        return col.cast("string").alias(name)

    return raw.select(*[field(raw_name, name) for raw_name, name in schemas.RAW_COLUMNS.items()])


_NUMERIC = set(schemas.MEASURES) | {"latitude", "longitude", "altitude_m"}


def read_forecast_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FORECAST_CSV).option("header", True).csv(path)
