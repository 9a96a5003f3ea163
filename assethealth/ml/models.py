"""Feature pipeline, models and batch scoring on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assethealth.functions.columns import clamp, rounded
from assethealth.ml.data import CATEGORIES, FEATURES
from assethealth.ml.metrics import risk_tier

NUMBERS = tuple(f for f in FEATURES if f not in CATEGORIES)


def feature_stages() -> list:
    """Indexed categories, one vector of the 25 features, scaled to mean 0 and deviation 1."""
    indexed = [f"{c}_idx" for c in CATEGORIES]
    return [
        StringIndexer(inputCols=list(CATEGORIES), outputCols=indexed, handleInvalid="keep", stringOrderType="frequencyDesc"),
        VectorAssembler(inputCols=[*NUMBERS, *indexed], outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def classifier(name: str, seed: int = 42) -> object:
    """``logistic``, ``forest`` or ``boosted``; all but the last weigh samples."""
    makers = {
        "logistic": lambda: LogisticRegression(labelCol="label_failure", weightCol="sample_weight", maxIter=50),
        "forest": lambda: RandomForestClassifier(labelCol="label_failure", weightCol="sample_weight", numTrees=50, maxDepth=8, seed=seed),
        "boosted": lambda: GBTClassifier(labelCol="label_failure", maxIter=40, maxDepth=5, seed=seed),
    }
    return makers[name]()


def regressor(name: str, seed: int = 42) -> object:
    makers = {
        "linear": lambda: LinearRegression(labelCol="label_rul", maxIter=50),
        "forest": lambda: RandomForestRegressor(labelCol="label_rul", numTrees=50, maxDepth=8, seed=seed),
        "boosted": lambda: GBTRegressor(labelCol="label_rul", maxIter=40, maxDepth=5, seed=seed),
    }
    return makers[name]()


def fit(rows: DataFrame, model: object) -> PipelineModel:
    return Pipeline(stages=[*feature_stages(), model]).fit(rows)


def with_failure_risk(rows: DataFrame, model: PipelineModel) -> DataFrame:
    kept = rows.columns
    scored = model.transform(rows)
    return scored.select(*kept, rounded(vector_to_array("probability")[1], 4).alias("prob_failure"), F.col("prediction").cast("int").alias("pred_failure"))


def with_remaining_life(rows: DataFrame, model: PipelineModel) -> DataFrame:
    kept = rows.columns
    return model.transform(rows).select(*kept, rounded(clamp(F.col("prediction"), 0.0, 120.0), 2).alias("pred_rul"))


def scored(rows: DataFrame, risk: PipelineModel, life: PipelineModel, top: int = 3) -> DataFrame:
    """Predictions with their tier and the ``top`` features by importance, with observed values."""
    out = with_remaining_life(with_failure_risk(rows, risk), life)
    weights = risk.stages[-1].featureImportances.toArray()
    names = [*NUMBERS, *CATEGORIES]
    best = sorted(zip(weights, names, strict=True), key=lambda x: (-x[0], x[1]))[:top]
    parts = [F.struct(F.lit(n).alias("feature"), F.lit(round(float(w), 4)).alias("importance"), F.col(n).cast("string").alias("observed_value")) for w, n in best]
    return out.withColumns({"maintenance_priority": risk_tier(F.col("prob_failure"), F.col("pred_rul")), "top_features": F.array(*parts)})
