"""Registered queries that write the given tables in each source format and read them back, and further hooks."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agrispark import schemas
from agrispark.operators import alerts, cleanse, diagnosis, latest, models, retrieval, sequences
from agrispark.plans import corpus_queries, flows
from agrispark.session import staging_path
from agrispark.sources import conversations, exports, telemetry
from agrispark.sources import corpus as corpus_store

FIRST_ALERTS = 100

# Forecast columns derived from readings, the same in every engine.
FORECAST_EXPRS = [
    "ts as timestamp", "temperature_c as temperature", "humidity_pct as humidity", "moisture_pct as moisture", "nitrogen_mg_kg as N",
    "phosphorus_mg_kg as P", "potassium_mg_kg as K", "cast(event_id%30 as double)/cast(10 as double) as Rainfall", "latitude as lat",
    "longitude as lon", "'Maize' as Crop", "'Clay' as Soil_Type", "'V1' as Variety",
]


def _forecast_file(spark, sf):
    path = staging_path(spark, "forecast")
    telemetry.readings_from_events(spark, sf).selectExpr(*FORECAST_EXPRS).write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
    ).csv(path)
    return cleanse.select_features(telemetry.read_forecast_csv(spark, path), ["timestamp"], schemas.FORECAST_FEATURES)


def forecast_file(spark, sf):
    """A forecast file written as CSV and read back, incomplete rows dropped."""
    return cleanse.complete_rows(_forecast_file(spark, sf), schemas.FORECAST_FEATURES)


def dropped_rows(spark, sf):
    """How many rows of the forecast file were read and how many dropped, counted in the same pass."""
    seen = Observation()
    kept = cleanse.complete_rows(_forecast_file(spark, sf), schemas.FORECAST_FEATURES, seen).count()
    return spark.createDataFrame([(seen.get["rows"], seen.get["dropped"], kept)], "rows long, dropped long, kept long")


def telemetry_table(spark, sf):
    """Raw telemetry stored under its own column names, as JSON, and read in canonical shape."""
    path = staging_path(spark, "telemetry")
    readings = telemetry.readings_from_events(spark, sf)
    readings.select(*[F.col(ours).cast("string").alias(raw) for raw, ours in schemas.RAW_COLUMNS.items() if ours in readings.columns]).write.json(path)
    return telemetry.read_telemetry(spark, path, "json").select("ts", "node_id", *schemas.MEASURES, "satellites", "target_crop")


def conversation_files(spark, sf):
    """Conversations written as JSON, one on every line, and read back."""
    path = staging_path(spark, "conversations")
    conversations.write_conversations(spark.read.parquet(f"{sf}/conversations.parquet"), path)
    return conversations.read_conversations(spark, path, lines=True)


def stored_turns(spark, sf):
    """Conversations stored in two batches, the first three turns and the rest; the second is tried twice."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    path = staging_path(spark, "turns")
    placed = sequences.with_position_in_key(turns, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096).cast("long"))
    first, rest = (placed.where(p).select("conv_id", F.col("seq").alias("place"), "role", "text") for p in ("seq < 3", "seq >= 3"))
    for batch, part in ((0, first), (1, rest), (1, rest)):
        conversations.store_turns(spark, part, path, "place", batch)
    return conversations.read_turns(spark, path, turns.schema["conv_id"].dataType.simpleString())


def compacted_chunks(spark, sf):
    """Chunks stored, a third of them changed, compacted, and the same stored again: rows before and after."""
    chunks = corpus_queries._line_chunks(spark, sf).drop("origin").dropDuplicates(["chunk_id"])
    path = staging_path(spark, "chunks")
    corpus_store.write_chunks(spark, chunks, path)
    third = spark.read.parquet(path).select(*schemas.CHUNKS.fieldNames()).where(F.col("chunk_index") % 3 == 0)  # as stored, one row an id
    changed = retrieval.write_once(spark, third.withColumn("text", F.concat("text", F.lit(" changed"))), f"{path}-changed")
    corpus_store.write_chunks(spark, changed, path)
    corpus_store.compact_chunks(spark, path, f"{path}-compact", 16)
    corpus_store.write_chunks(spark, changed, f"{path}-compact")
    rows = lambda p: spark.read.parquet(p).agg(F.count(F.lit(1))).scalar()
    newest = corpus_store.read_chunks(spark, f"{path}-compact", F.col("text").endswith(" changed").alias("is_changed")).agg(
        F.count(F.lit(1)).alias("live"), F.count_if("is_changed").alias("changed")
    )
    return newest.withColumn("appended_rows", rows(path)).withColumn("compacted_rows", rows(f"{path}-compact"))


def label_map(spark, sf):
    """Suitability classes of the readings named through the saved and reloaded label map."""
    from agrispark.functions.soil import label_index
    from agrispark.operators import scoring
    from agrispark.sources import dims

    path = staging_path(spark, "labels")
    exports.save_label_map(spark, path)
    scored = scoring.suitability(telemetry.readings_from_events(spark, sf), dims.crop_profiles(spark))
    indexed = scored.select("event_id", label_index(F.col("suitability_label")).cast("int").alias("label_index"))
    return indexed.join(F.broadcast(exports.load_label_map(spark, path)), "label_index").select("event_id", F.col("label_index").cast("long").alias("label_index"), "label")


def reloaded_model(spark, sf):
    """Windows classed by a fitted model and by the same model saved and reloaded: how many, and how many alike."""
    samples = flows.suitability_samples(telemetry.readings_from_events(spark, sf))
    model, path = models.fit_suitability(samples, sequences.class_weights(samples)), staging_path(spark, "model")
    model.write().overwrite().save(path)
    before = models.classify(model, samples).select("node_id", "event_id", F.col("model_label").alias("before"))
    after = models.classify(PipelineModel.load(path), samples).select("node_id", "event_id", "model_label")
    return before.join(after, ["node_id", "event_id"]).agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("before") == F.col("model_label")).alias("alike")
    )


def _shared_tokens():
    words = lambda text: {t for t in re.split("[^a-zA-Z0-9]", text.lower()) if len(t) > 1}
    return lambda queries, texts: [len(words(q) & words(t)) - 8.0 for q, t in zip(queries, texts)]


def rescored_topk(spark, sf):
    """Fused candidates re-scored by a pair scorer that counts shared words, cut and ranked."""
    chunks, queries = corpus_queries._document_chunks(spark, sf), corpus_queries._benchmark(spark, sf)
    texts = retrieval.attach_text(corpus_queries._candidates(spark, sf), chunks).join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    final = cleanse.relevant_only(retrieval.final_ranking(retrieval.rescore(texts, _shared_tokens)), "rerank_score")
    return final.select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


def _letter_counts():
    return lambda texts: np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], float)


def encoded_documents(spark, sf):
    """Documents encoded by a hook; the most frequent letter is the place of the largest coordinate."""
    vectors = retrieval.embed(corpus_queries._document_chunks(spark, sf), _letter_counts)
    return vectors.select("chunk_id", F.array_position("embedding", F.array_max("embedding")).cast("long").alias("letter"), F.size("embedding").cast("long").alias("dimensions"))


def first_alerts(spark, sf):
    """The first hundred current alerts with their place: critical first, then newest node, then metric."""
    newest = latest.latest_per_node(telemetry.readings_from_events(spark, sf))
    order = alerts.alert_order()
    top = alerts.threshold_alerts(newest).orderBy(*order).limit(FIRST_ALERTS)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).select("place", "alert_id", "severity", "metric")


def ordered_issues(spark, sf):
    """Issues of every payload in order: worst first, parameters in their own order within a severity."""
    issues = diagnosis.soil_issues(telemetry.payloads_from_events(spark, sf), ["event_id"])
    place = F.row_number().over(W.partitionBy("event_id").orderBy("severity_rank", "param_ord"))
    return issues.select("event_id", place.cast("long").alias("place"), "parameter", "severity", "issue")


QUERIES = {f.__name__: f for f in [
    forecast_file, dropped_rows, telemetry_table, conversation_files, stored_turns, compacted_chunks, label_map, reloaded_model, rescored_topk,
    encoded_documents, first_alerts, ordered_issues,
]}
