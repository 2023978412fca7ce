"""The hybrid classifier: features, rules, model, arbitration, smoothing, report; one shuffle by document throughout."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FT
from . import models, report, rules, smoother


def classified(elements: DataFrame, model: PipelineModel | None = None, threshold: float = 0.90, smoothing: bool = True, model_name: str = "logistic_regression") -> DataFrame:
    """Elements with label, conf, tier, detection_method, final_label, final_conf and smooth_reason."""
    if model is not None:
        rows = models.predicted(FT.all_features(elements), model)
        rows = rules.arbitrated(rules.with_rules(rows), threshold, F.col("ml_type"), F.col("ml_confidence"), model_name)
    else:
        rows = rules.arbitrated(rules.with_rules(FT.with_position(FT.with_text(elements))), threshold)
    if smoothing:
        return smoother.smoothed(rows)
    return rows.withColumns({"final_label": F.col("label"), "final_conf": F.col("conf"), "smooth_reason": F.lit("initial_prediction")})


def summary(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Per document: counts by tier, the label map and the mean confidence (1 for a document without elements)."""
    return report.average_confidence(docs, rows).join(report.tiers(rows), "doc_id", "left").join(report.type_counts(rows, "final_label"), "doc_id", "left")
