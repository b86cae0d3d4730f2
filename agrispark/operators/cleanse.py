"""Filters, coercion and reshaping of readings and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from agrispark.functions.numeric import to_number, zero_if_missing
from agrispark.functions.text import strip
from agrispark.rules import crop_profile as cp
from agrispark.rules import lexicon


def for_node(readings: DataFrame, node_id: str | Column) -> DataFrame:
    return readings.where(F.col("node_id") == node_id)


def time_range(readings: DataFrame, start: str | None = None, end: str | None = None,
               inclusive_end_day: bool = False) -> DataFrame:
    """Closed range, either bound optional. An end given as a date means its midnight unless the whole day counts."""
    out = readings
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bound = F.lit(end).cast("timestamp_ntz")
        if inclusive_end_day:
            out = out.where(F.col("ts") < F.lit(end).cast("date").cast("timestamp_ntz") + F.expr("interval 1 day"))
        else:
            out = out.where(F.col("ts") <= bound)
    return out


def with_node_id(readings: DataFrame) -> DataFrame:
    """Rows without a node id are skipped."""
    return readings.where(F.col("node_id").isNotNull() & (F.col("node_id") != ""))


def fill_features(readings: DataFrame, features: list[str] = cp.FEATURES) -> DataFrame:
    return readings.na.fill(0.0, features)


def complete_rows(frame: DataFrame, features: list[str], observation: Observation | None = None) -> DataFrame:
    """Rows with every feature present; the observation counts rows read and rows dropped in the same pass."""
    if observation is not None:
        missing = F.lit(False)
        for name in features:
            missing = missing | F.col(name).isNull()
        frame = frame.observe(
            observation, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing.cast("long")), F.lit(0)).alias("dropped")
        )
    return frame.na.drop("any", subset=features)


def select_features(frame: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Fixed feature order, static columns gone."""
    return frame.select(*keys, *features)


def crop_key(target_crop: Column, profiles: list[str] | None = None) -> tuple[Column, Column]:
    """Profile key of a raw crop name and whether the name was recognised.

    Tried in order: profile key, alias, then both again with separators as underscores; else the default.
    """
    known = profiles or [cp.DEFAULT_CROP]
    aliases = {**{a: k for a, k in cp.CROP_ALIASES.items() if k in known}, **{k: k for k in known}}
    fallback = cp.DEFAULT_CROP if cp.DEFAULT_CROP in known else known[0]
    lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    name = F.lower(strip(F.coalesce(target_crop, F.lit(""))))
    found = F.coalesce(F.try_element_at(lookup, name), F.try_element_at(lookup, F.translate(name, "/ -", "___")))
    return F.coalesce(found, F.lit(fallback)), found.isNotNull() | (name == "")


def normalise_crop(readings: DataFrame, profiles: list[str] | None = None) -> DataFrame:
    key, recognised = crop_key(F.col("target_crop"), profiles)
    return readings.withColumns({"crop_key": key, "crop_recognised": recognised})


def unknown_crops(readings: DataFrame, profiles: list[str] | None = None) -> DataFrame:
    """Each unrecognised crop name once, with the number of readings that carry it."""
    named = normalise_crop(readings, profiles).where(~F.col("crop_recognised"))
    return named.groupBy(F.lower(strip(F.col("target_crop"))).alias("crop")).agg(F.count(F.lit(1)).alias("readings"))


def with_position(readings: DataFrame, lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """Rows whose coordinates parse."""
    as_number = lambda c: F.col(c) if dict(readings.dtypes)[c] == "double" else to_number(F.col(c))
    return readings.withColumns({lat: as_number(lat), lng: as_number(lng)}).where(
        F.col(lat).isNotNull() & F.col(lng).isNotNull()
    )


def to_long(readings: DataFrame, keys: list[str], columns: list[str], name: str = "column") -> DataFrame:
    """One row per (reading, parameter), NULLs kept."""
    return readings.select(*keys, *columns).unpivot(keys, columns, name, "value")


def chart_series(readings: DataFrame) -> DataFrame:
    """Chart columns of each reading; missing measures plot as zero."""
    short = {
        "n": "nitrogen_mg_kg", "p": "phosphorus_mg_kg", "k": "potassium_mg_kg",
        "moisture": "moisture_pct", "humidity": "humidity_pct", "temp": "temperature_c",
    }
    return readings.select(
        "event_id", "node_id", "ts",
        F.date_format("ts", "HH:mm").alias("formatted_time"),
        F.date_format("ts", "MMM dd").alias("formatted_date"),
        *[zero_if_missing(F.col(c)).alias(a) for a, c in short.items()],
    )


def valid_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin(lexicon.CONVERSATION_ROLES) & F.col("text").isNotNull())


def split_by_conversation_id(messages: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by the form of the conversation id."""
    ok = F.coalesce(strip(F.col(id_column)).rlike(lexicon.CONVERSATION_ID), F.lit(False))
    return messages.where(ok), messages.where(~ok)


def relevant_only(scored: DataFrame, column: str = "score", cut: float | None = None) -> DataFrame:
    from agrispark.rules.corpus import RELEVANCE_CUT

    return scored.where(F.col(column) >= (RELEVANCE_CUT if cut is None else cut))
