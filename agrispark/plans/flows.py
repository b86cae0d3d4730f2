"""End-to-end flows: what needs attention, suitability verdicts, action plans, grounded contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrispark.operators import (
    alerts, cleanse, context, corpus, diagnosis, latest, models, prescriptions, retrieval, scoring, sequences,
)
from agrispark.rules import corpus as rc
from agrispark.rules import crop_profile as cp
from agrispark.rules import limits
from agrispark.session import staging_path
from agrispark.sources import dims


def current_alerts(readings: DataFrame, recent_rows: int | None = None, alert_limits: DataFrame | None = None,
                   ordered: bool = True) -> DataFrame:
    """Alerts on the latest reading of every node, critical first if ``ordered``: a global sort is a shuffle of its own."""
    newest = latest.latest_in_recent_rows(readings, recent_rows) if recent_rows else latest.latest_per_node(readings)
    found = alerts.threshold_alerts(newest, alert_limits)
    return found.orderBy(*alerts.alert_order()) if ordered else found


def plans_for(payloads: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ranked actions, one summary row per payload)."""
    ranked = prescriptions.ranked_issues(diagnosis.soil_issues(payloads, keys), keys)
    healthy = diagnosis.overall_severity(payloads, keys).where("overall_severity = 'Low'")
    return prescriptions.action_plan(ranked, keys), prescriptions.plan_summary(ranked, keys, healthy)


def suitability_samples(readings: DataFrame, length: int = limits.SUITABILITY_HISTORY) -> DataFrame:
    """Scaled windows with the class of their last reading, which travels with the reading through the windows."""
    labelled = scoring.suitability(readings, dims.crop_profiles(readings.sparkSession))
    scaled = sequences.scale(labelled, sequences.scaler_params(readings))
    path = staging_path(readings.sparkSession, "windows")
    windows = sequences.sliding_windows(cleanse.fill_features(scaled), length, carry=["suitability_label"], path=path)
    return models.as_features(sequences.window_labels(windows), length)


def verdict_report(readings: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """One row per node: rule verdict on its latest reading, model verdict on its last window where there is one."""
    length = limits.SUITABILITY_HISTORY
    spark = readings.sparkSession
    rules = scoring.suitability(latest.latest_per_node(readings), dims.crop_profiles(spark)).select(
        "node_id", "crop_key", "suitability_label", "suitability_score", "parameter_scores"
    )
    scaled = sequences.scale(readings, sequences.scaler_params(readings))
    history = latest.history_windows(scaled, length, cp.FEATURES)
    base = rules.join(history.select("node_id", "readings_used", "status"), "node_id", "left")
    if model is None:
        return base.select("*", F.col("suitability_label").alias("verdict"), F.lit("threshold").alias("source"))
    steps = F.transform("rows", lambda r: F.array(*[F.coalesce(r[c], F.lit(0.0)) for c in cp.FEATURES]))
    full = models.as_features(history.withColumn("window", steps).select("node_id", "window"), length)
    return models.merge_verdicts(base, models.classify(model, full), ["node_id"])


def forecast_samples(readings: DataFrame) -> DataFrame:
    """48-row windows with the moisture 24 rows later, split by time. Readings that lack a feature are left out."""
    readings = cleanse.complete_rows(readings, cp.FEATURES)
    scaled = sequences.scale(readings, sequences.scaler_params(readings))
    path = staging_path(readings.sparkSession, "windows")
    windows = sequences.sliding_windows(
        scaled, limits.FORECAST_HISTORY, horizon=limits.FORECAST_HORIZON, target="moisture_pct", path=path
    )
    split = sequences.split_windows(windows, limits.FORECAST_HISTORY, limits.FORECAST_HORIZON)
    return models.as_features(split, limits.FORECAST_HISTORY)


def hybrid_candidates(index: retrieval.SparseIndex, chunk_vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
                      top_k: int = rc.DEFAULT_TOP_K) -> DataFrame:
    """Fused candidates of both legs, each leg twice the requested depth."""
    depth = top_k * rc.CANDIDATE_FACTOR
    sparse = retrieval.bm25_search(index, queries, depth)
    dense = retrieval.dense_search(chunk_vectors, query_vectors, depth)
    return retrieval.fuse(dense, sparse)


def grounded_contexts(candidates: DataFrame, chunks: DataFrame, queries: DataFrame,
                      load_scorer: Callable | None = None, cut: float = rc.RELEVANCE_CUT) -> DataFrame:
    """Re-scored top chunks above the relevance cut, as one budgeted context per query."""
    texts = retrieval.attach_text(candidates, chunks).join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    final = retrieval.final_ranking(retrieval.rescore(texts, load_scorer))
    qualified = cleanse.relevant_only(final, "rerank_score", cut)
    return context.within_budget(context.context_blocks(queries, qualified))


def ingest(documents: DataFrame) -> DataFrame:
    """Cleaned, chunked documents long enough to store."""
    return corpus.long_enough(corpus.chunk_documents(corpus.clean_documents(documents)))
