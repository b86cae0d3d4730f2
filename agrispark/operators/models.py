"""Model training, scoring and metrics on window features.

Sequence networks are replaced by MLlib estimators over the same windows, labels and splits.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrispark.functions.numeric import rounded
from agrispark.rules import crop_profile as cp


def as_features(windows: DataFrame, length: int) -> DataFrame:
    """Flattened window as an ML vector; only windows of exactly ``length`` rows pass."""
    return windows.where(F.size("window") == length).withColumn(
        "features", array_to_vector(F.transform(F.flatten("window"), lambda v: F.coalesce(v, F.lit(0.0))))
    )


def fit_forecast(samples: DataFrame, label: str = "target_value") -> PipelineModel:
    """Value ``horizon`` rows ahead from the flattened window."""
    stages = [LinearRegression(featuresCol="features", labelCol=label, regParam=0.01, solver="l-bfgs", maxIter=50)]
    return Pipeline(stages=stages).fit(samples.where(F.col(label).isNotNull()))


def fit_boosted_forecast(samples: DataFrame, label: str = "target_value", most_trees: int = 30) -> PipelineModel:
    """The same by boosted trees on the training part, which stop when the validation part gets no better."""
    parts = samples.where(F.col(label).isNotNull() & F.col("split").isin("train", "validation"))
    stages = [GBTRegressor(
        featuresCol="features", labelCol=label, maxIter=most_trees, maxDepth=3, stepSize=0.2, seed=1, maxBins=16,
        validationIndicatorCol="is_validation", validationTol=0.01,
    )]
    return Pipeline(stages=stages).fit(parts.withColumn("is_validation", F.col("split") == "validation"))


def fit_suitability(samples: DataFrame, weights: DataFrame) -> PipelineModel:
    """Poor / Fair / Good classifier with inverse-frequency weights."""
    weighted = samples.join(F.broadcast(weights.select(F.col("label_index").alias("label"), "class_weight")), "label")
    stages = [LogisticRegression(featuresCol="features", labelCol="label", weightCol="class_weight", maxIter=40, regParam=0.001)]
    return Pipeline(stages=stages).fit(weighted)


def fit_anomaly(samples: DataFrame, components: int = 12) -> PipelineModel:
    """Projection onto the main components of standardised windows."""
    stages = [
        StandardScaler(inputCol="features", outputCol="standard", withMean=True, withStd=True),
        PCA(k=components, inputCol="standard", outputCol="projected"),
    ]
    return Pipeline(stages=stages).fit(samples)


def anomaly_scores(model: PipelineModel, samples: DataFrame) -> DataFrame:
    """Squared reconstruction error per value: what the projection loses of the standardised window."""
    norm = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda acc, v: acc + v * v)
    return model.transform(samples).withColumn(
        "reconstruction_error",
        F.greatest(norm("standard") - norm("projected"), F.lit(0.0)) / F.size(vector_to_array("standard")),
    ).drop("standard", "projected")


def anomaly_flags(scores: DataFrame, share: float = 0.99) -> DataFrame:
    """Windows above the given quantile of the error."""
    edge = scores.agg(F.percentile_approx("reconstruction_error", share)).scalar()
    return scores.withColumn("is_anomaly", F.col("reconstruction_error") > edge)


def argmax_class(probabilities: Column) -> tuple[Column, Column]:
    """(label, confidence rounded to four digits) of the most likely class; the first wins a tie."""
    best = F.array_max(probabilities)
    labels = F.array(*[F.lit(x) for x in cp.SUITABILITY_LABELS])
    return F.element_at(labels, F.array_position(probabilities, best).cast("int")), rounded(best, 4)


def classify(model: PipelineModel, samples: DataFrame) -> DataFrame:
    scored = model.transform(samples).withColumn("probabilities", vector_to_array("probability"))
    label, confidence = argmax_class(F.col("probabilities"))
    return scored.withColumns({"model_label": label, "model_confidence": confidence}).drop(
        "rawPrediction", "probability", "prediction"
    )


def regression_metrics(frame: DataFrame, predicted: str, actual: str) -> DataFrame:
    """MAE, RMSE and R² in two aggregations without leaving the cluster."""
    both = frame.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    residual = F.col(actual) - F.col(predicted)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(residual)).alias("mae"), F.avg(residual * residual).alias("_mse"),
        F.var_pop(actual).alias("_var"), F.avg(residual).alias("residual_mean"),
    ).select("n", "mae", F.sqrt("_mse").alias("rmse"), (1 - F.col("_mse") / F.nullif(F.col("_var"), F.lit(0.0))).alias("r2"), "residual_mean")


def residual_histogram(frame: DataFrame, predicted: str, actual: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the smallest and largest residual; the last bin includes its upper end."""
    residuals = frame.select((F.col(actual) - F.col(predicted)).alias("residual")).where(F.col("residual").isNotNull())
    ends = residuals.agg(F.struct(F.min("residual").alias("lo"), F.max("residual").alias("hi"))).scalar()
    lo, hi = F.col("_ends")["lo"], F.col("_ends")["hi"]
    index = F.least(F.lit(bins - 1), F.floor((F.col("residual") - lo) / F.nullif((hi - lo) / bins, F.lit(0.0))))
    return (
        residuals.withColumn("_ends", ends).groupBy(F.coalesce(index, F.lit(0)).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("residual").alias("smallest"), F.max("residual").alias("largest"))
    )


def classification_metrics(frame: DataFrame, probabilities: str, label: str) -> DataFrame:
    """Accuracy and mean log loss; the label is a class index."""
    p = F.greatest(F.element_at(F.col(probabilities), F.col(label) + 1), F.lit(1e-15))
    hit = F.array_position(F.col(probabilities), F.array_max(probabilities)) - 1 == F.col(label)
    return frame.agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(-F.log(p)).alias("log_loss")
    )


def merge_verdicts(rules: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Model verdict where there is one, rule verdict otherwise, with the source named."""
    return rules.join(predictions.select(*keys, "model_label", "model_confidence"), keys, "left").withColumns({
        "verdict": F.coalesce("model_label", "suitability_label"),
        "source": F.when(F.col("model_label").isNotNull(), "model").otherwise("threshold"),
    })
