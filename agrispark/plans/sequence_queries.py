"""Registered queries over windows, labels, splits and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from agrispark.operators import cleanse, latest, models, scoring, sequences
from agrispark.plans import flows
from agrispark.rules import crop_profile as cp
from agrispark.rules import limits
from agrispark.session import staging_path
from agrispark.sources import dims, exports
from agrispark.sources.telemetry import readings_from_events


def _readings(spark, sf):
    return readings_from_events(spark, sf)


def _labelled(spark, sf):
    return scoring.suitability(_readings(spark, sf), dims.crop_profiles(spark))


def _mean(column: str, feature: int):
    values = F.transform(column, lambda step: F.coalesce(step[feature], F.lit(0.0)))
    return F.round(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(column), 6)


def scaler_params(spark, sf):
    return sequences.scaler_params(_readings(spark, sf))


def scaled_readings(spark, sf):
    readings = _readings(spark, sf)
    scaled = sequences.scale(readings, sequences.scaler_params(readings))
    return scaled.select("event_id", *[F.round(c, 9).alias(c) for c in cp.FEATURES])


def scaled_with_saved_parameters(spark, sf):
    """Scaler parameters saved, loaded and applied."""
    readings, path = _readings(spark, sf), staging_path(spark, "scaler")
    exports.save_scaler(sequences.scaler_params(readings), path)
    scaled = sequences.scale(readings, exports.load_scaler(spark, path))
    return scaled.select("event_id", *[F.round(c, 9).alias(c) for c in cp.FEATURES])


def unscaled_moisture(spark, sf):
    """Scaled and scaled back: the stored parameters invert the transformation."""
    from agrispark.functions.numeric import min_max_unscale

    readings = _readings(spark, sf)
    params = sequences.scaler_params(readings)
    ends = params.where("feature = 'moisture_pct'").agg(F.first(F.struct("data_min", "data_max"))).scalar()
    scaled = sequences.scale(readings, params)
    back = scaled.withColumn("_e", ends).select(
        "event_id", F.round(min_max_unscale(F.col("moisture_pct"), F.col("_e")["data_min"], F.col("_e")["data_max"]), 6).alias("moisture_pct")
    )
    return back


def windows_24(spark, sf):
    windows = sequences.sliding_windows(_readings(spark, sf), limits.SUITABILITY_HISTORY)
    return windows.select(
        "node_id", "event_id", "ts", "seq", F.size("window").cast("long").alias("length"),
        F.element_at("window", 1)[3].alias("first_moisture"), F.element_at("window", -1)[3].alias("last_moisture"),
        _mean("window", 0).alias("mean_nitrogen"), _mean("window", 5).alias("mean_humidity"),
    )


def _forecast_windows(spark, sf, key=None):
    return sequences.sliding_windows(
        _readings(spark, sf), limits.FORECAST_HISTORY, horizon=limits.FORECAST_HORIZON, target="moisture_pct", key=key
    )


def windows_48_h24(spark, sf):
    return _forecast_windows(spark, sf).select(
        "node_id", "event_id", "seq", F.element_at("window", 1)[3].alias("first_moisture"), "target_value", _mean("window", 3).alias("mean_moisture")
    )


def windows_48_h24_one_series(spark, sf):
    return _forecast_windows(spark, sf, key=[]).select(
        "event_id", "seq", F.element_at("window", 1)[3].alias("first_moisture"), "target_value", _mean("window", 3).alias("mean_moisture")
    )


def chronological_split(spark, sf):
    samples = _forecast_windows(spark, sf, key=[]).select("event_id", "ts")
    return sequences.chronological_split(samples, []).select("event_id", "seq", "split")


def chronological_split_per_node(spark, sf):
    samples = cleanse.with_node_id(_readings(spark, sf)).select("node_id", "event_id", "ts")
    return sequences.chronological_split(samples, ["node_id"]).groupBy("node_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def window_labels(spark, sf):
    windows = sequences.sliding_windows(_labelled(spark, sf), limits.SUITABILITY_HISTORY, carry=["suitability_label"])
    return sequences.window_labels(windows).select("node_id", "event_id", F.col("label").cast("long").alias("label"))


def label_distribution(spark, sf):
    windows = sequences.sliding_windows(_labelled(spark, sf), limits.SUITABILITY_HISTORY, ["moisture_pct"], carry=["suitability_label"])
    return scoring.class_distribution(windows)


def class_weights(spark, sf):
    weights = sequences.class_weights(_labelled(spark, sf))
    return weights.select(F.col("label_index").cast("long").alias("label_index"), "label", "n", F.round("class_weight", 9).alias("class_weight"))


def future_moisture(spark, sf):
    return sequences.future_value(_readings(spark, sf), "moisture_pct").select("event_id", "node_id", "moisture_pct", "future_value")


def persistence_metrics(spark, sf):
    pairs = sequences.future_value(_readings(spark, sf), "moisture_pct")
    metrics = models.regression_metrics(pairs, "moisture_pct", "future_value")
    return metrics.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2", "residual_mean")])


def residual_histogram(spark, sf):
    pairs = sequences.future_value(_readings(spark, sf), "moisture_pct")
    bins = models.residual_histogram(pairs, "moisture_pct", "future_value")
    return bins.select("bin", "n", F.round("smallest", 6).alias("smallest"), F.round("largest", 6).alias("largest"))


def _class_shares(spark, sf):
    """Share of each class among a node's readings: the simplest probabilistic classifier."""
    counts = [F.count_if(F.col("suitability_label") == x) for x in cp.SUITABILITY_LABELS]
    rows = F.count(F.lit(1))
    return _labelled(spark, sf).groupBy("node_id").agg(F.array(*[c / rows for c in counts]).alias("probabilities"), rows.alias("readings"))


def class_argmax(spark, sf):
    label, confidence = models.argmax_class(F.col("probabilities"))
    return _class_shares(spark, sf).select("node_id", label.alias("model_label"), confidence.alias("model_confidence"))


def class_share_metrics(spark, sf):
    from agrispark.functions.soil import label_index

    scored = _labelled(spark, sf).select("node_id", label_index(F.col("suitability_label")).alias("label"))
    metrics = models.classification_metrics(scored.join(_class_shares(spark, sf), "node_id"), "probabilities", "label")
    return metrics.select("n", F.round("accuracy", 9).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))


def merged_verdicts(spark, sf):
    """Rule verdict on the latest reading next to the node's majority class, used from 72 readings on."""
    readings = _readings(spark, sf)
    rules = scoring.suitability(latest.latest_per_node(readings), dims.crop_profiles(spark)).select("node_id", "suitability_label", "suitability_score")
    label, confidence = models.argmax_class(F.col("probabilities"))
    enough = limits.FORECAST_HISTORY + limits.FORECAST_HORIZON
    shares = _class_shares(spark, sf).where(F.col("readings") >= enough)
    return models.merge_verdicts(rules, shares.select("node_id", label.alias("model_label"), confidence.alias("model_confidence")), ["node_id"])


def verdict_report(spark, sf):
    return flows.verdict_report(_readings(spark, sf)).select(
        "node_id", "crop_key", "suitability_label", "suitability_score", "readings_used", "status", "verdict", "source"
    )


def forecast_metrics(spark, sf):
    samples = flows.forecast_samples(_readings(spark, sf))
    model = models.fit_forecast(samples.where("split = 'train'"))
    predicted = _in_units(model.transform(samples.where("split = 'test'")), cleanse.complete_rows(_readings(spark, sf), cp.FEATURES), ["prediction", "target_value"])
    return models.regression_metrics(predicted, "prediction", "target_value")


def boosted_forecast(spark, sf):
    """Boosted trees next to the persistence forecast on the test windows, in the value's own unit."""
    path, readings = staging_path(spark, "forecasts"), cleanse.complete_rows(_readings(spark, sf), cp.FEATURES)
    samples = flows.forecast_samples(_readings(spark, sf))
    model = models.fit_boosted_forecast(samples)
    moisture = F.element_at("window", -1)[cp.FEATURES.index("moisture_pct")]
    test = model.transform(samples.where("split = 'test'")).withColumn("persistence", moisture)
    _in_units(test, readings, ["prediction", "persistence", "target_value"]).select("node_id", "event_id", "prediction", "persistence", "target_value").write.parquet(path)
    stored = spark.read.parquet(path)
    rows = [models.regression_metrics(stored, name, "target_value").withColumn("forecast", F.lit(name)) for name in ("prediction", "persistence")]
    return rows[0].unionByName(rows[1]).withColumn("trees", F.lit(model.stages[-1].getNumTrees).cast("long"))


def _in_units(frame, readings, columns):
    """Scaled moisture values back in their own unit."""
    from agrispark.functions.numeric import min_max_unscale

    ends = sequences.scaler_params(readings).where("feature = 'moisture_pct'").agg(F.first(F.struct("data_min", "data_max"))).scalar()
    low, high = F.col("_e")["data_min"], F.col("_e")["data_max"]
    return frame.withColumn("_e", ends).withColumns({c: min_max_unscale(F.col(c), low, high) for c in columns}).drop("_e")


def line_forecast_metrics(spark, sf):
    """A line from moisture to moisture a day later, fitted to scaled training pairs, judged in its own unit on test pairs."""
    from agrispark.functions.numeric import min_max_scale

    readings = _readings(spark, sf)
    pairs = sequences.future_value(readings, "moisture_pct").where("moisture_pct IS NOT NULL AND future_value IS NOT NULL")
    split = sequences.chronological_split(pairs, [])
    ends = sequences.scaler_params(readings).where("feature = 'moisture_pct'").agg(F.first(F.struct("data_min", "data_max"))).scalar()
    scaled = split.withColumn("_s", ends).select("split", *[
        min_max_scale(F.col(c), F.col("_s")["data_min"], F.col("_s")["data_max"]).alias(n) for c, n in (("moisture_pct", "x"), ("future_value", "y"))
    ])
    line = scaled.where("split = 'train'").agg(F.struct(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))).scalar()
    test = scaled.where("split = 'test'").withColumn("_l", line).select("y", (F.col("_l")["a"] + F.col("_l")["b"] * F.col("x")).alias("prediction"))
    metrics = models.regression_metrics(_in_units(test, readings, ["prediction", "y"]), "prediction", "y")
    return metrics.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2", "residual_mean")])


def model_verdicts(spark, sf):
    readings = _readings(spark, sf)
    samples = flows.suitability_samples(readings)
    model = models.fit_suitability(samples, sequences.class_weights(samples))
    report = flows.verdict_report(readings, model)
    return report.select("node_id", "suitability_label", "model_label", "model_confidence", "verdict", "source")


def anomalous_windows(spark, sf):
    samples = flows.suitability_samples(_readings(spark, sf))
    scores = models.anomaly_scores(models.fit_anomaly(samples), samples)
    return models.anomaly_flags(scores).where("is_anomaly").select("node_id", "event_id", "reconstruction_error")


def _stored_rows(spark, path, rows):
    """Rows of numbers stored one by one, and read back as one array of arrays for an expression."""
    spark.createDataFrame(list(enumerate(rows)), "place long, weights array<double>").write.parquet(path)
    stored = F.sort_array(F.collect_list(F.struct("place", "weights")))
    return spark.read.parquet(path).agg(F.transform(stored, lambda r: r["weights"])).scalar()


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def verdict_scores_recomputed(spark, sf):
    """Windows classed by the fitted model and by plain expressions over its stored coefficients: how many, how many alike."""
    samples = flows.suitability_samples(_readings(spark, sf))
    model = models.fit_suitability(samples, sequences.class_weights(samples))
    fitted = model.stages[-1]
    rows = [[*c, b] for c, b in zip(fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist())]
    weights = _stored_rows(spark, staging_path(spark, "coefficients"), rows)
    given = models.classify(model, samples).withColumn("_x", F.concat(vector_to_array("features"), F.array(F.lit(1.0)))).withColumn("_w", weights)
    margins = given.withColumn("_m", F.transform("_w", lambda w: _dot(w, F.col("_x"))))
    powers = margins.withColumn("_e", F.transform("_m", lambda m: F.exp(m - F.array_max("_m"))))
    total = F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v)
    label, _ = models.argmax_class(F.col("_e"))
    near = F.abs(F.array_max("_e") / total - F.col("model_confidence")) < 1e-4
    return powers.agg(F.count(F.lit(1)).alias("windows"), F.count_if((label == F.col("model_label")) & near).alias("alike"))


def anomaly_scores_recomputed(spark, sf):
    """Reconstruction errors of the fitted model and of plain expressions over its stored components: how many, how many alike."""
    samples = flows.suitability_samples(_readings(spark, sf))
    model = models.fit_anomaly(samples)
    scaler, pca = model.stages
    components = _stored_rows(spark, staging_path(spark, "components"), pca.pc.toArray().T.tolist())
    spread = [1.0 / d if d else 0.0 for d in scaler.std.toArray().tolist()]
    moments = _stored_rows(spark, staging_path(spark, "moments"), [scaler.mean.toArray().tolist(), spread])
    scored = models.anomaly_scores(model, samples).withColumn("_c", components).withColumn("_s", moments).withColumn("_x", vector_to_array("features"))
    centred = F.zip_with("_x", F.col("_s")[0], lambda x, m: x - m)
    standard = scored.withColumn("_z", F.zip_with(centred, F.col("_s")[1], lambda x, d: x * d))
    projected = standard.withColumn("_p", F.transform("_c", lambda c: _dot(c, F.col("_z"))))
    error = F.greatest(_dot(F.col("_z"), F.col("_z")) - _dot(F.col("_p"), F.col("_p")), F.lit(0.0)) / F.size("_z")
    return projected.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.abs(error - F.col("reconstruction_error")) < 1e-9).alias("alike"))


QUERIES = {f.__name__: f for f in [
    scaler_params, scaled_readings, scaled_with_saved_parameters, unscaled_moisture, windows_24, windows_48_h24, windows_48_h24_one_series,
    chronological_split, chronological_split_per_node, window_labels, label_distribution, class_weights,
    future_moisture, persistence_metrics, residual_histogram, class_argmax, class_share_metrics, merged_verdicts,
    verdict_report, forecast_metrics, boosted_forecast, line_forecast_metrics, model_verdicts, anomalous_windows,
    verdict_scores_recomputed, anomaly_scores_recomputed,
]}
