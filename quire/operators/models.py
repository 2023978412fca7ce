"""Structure models: alphabetical labels, exact stratified split, balanced weights, scaling, two classifiers, inference."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as FT
from ..sources.corpus import synthetic_corpus

MODELS = ("logistic_regression", "decision_tree")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = rows / (labels * rows of the label)."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    w = W.partitionBy()
    return n.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


def stratified(df: DataFrame, label: str, key: str, train: float = 0.8) -> DataFrame:
    """Adds in_train: exactly floor(train * n) rows of each label, by hash of the key."""
    w = W.partitionBy(label)
    rank = F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("in_train", rank <= F.floor(F.count("*").over(w) * F.lit(train)))


def scaler_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, scale: population deviation, 1 where a feature doesn't vary."""
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.feature", "x.mean", F.when(F.col("x.sd") > 0, F.col("x.sd")).otherwise(1.0).alias("scale"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda z: F.exp(z - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def linear_logits(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Constant weights folded into the plan: one dot product per class."""
    dot = lambda ws, b: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(w)) for w in ws]), lambda x, w: x.cast("double") * w), F.lit(float(b)), lambda a, x: a + x)
    return F.array(*[dot(ws, b) for ws, b in zip(weights, bias)])


def argmax(probabilities: Column) -> Column:
    """0-based index of the largest; the lowest if several are."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def pipeline(kind: str, n_rows: int) -> Pipeline:
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}; one of {', '.join(MODELS)}")
    stages = [
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=FT.NAMES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        # the scaler divides by the sample deviation; the features are scaled by the population's
        ElementwiseProduct(scalingVec=Vectors.dense([(n_rows / max(1, n_rows - 1)) ** 0.5] * len(FT.NAMES)), inputCol="scaled", outputCol="features"),
    ]
    if kind == "logistic_regression":
        stages.append(LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", family="multinomial", regParam=1.0 / max(1, n_rows), elasticNetParam=0.0, standardization=False, maxIter=1500, probabilityCol="probability"))
    else:
        stages.append(DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxDepth=12, minInstancesPerNode=2, maxBins=256, seed=42))
    return Pipeline(stages=stages)


def training_rows(spark: SparkSession, documents: int = 120, seed: int = 42) -> DataFrame:
    """Labelled feature rows of the synthetic corpus, with a fixed median size of 11."""
    rows = FT.all_features(synthetic_corpus(spark, documents, seed), fixed_median=11.0)
    return rows.select("label", F.concat_ws("-", "doc_id", "idx").alias("key"), *[F.col(c).cast("double").alias(c) for c in FT.NAMES])


def train(spark: SparkSession, kind: str = "logistic_regression", documents: int = 120, seed: int = 42) -> tuple[PipelineModel, float]:
    """The fitted pipeline and its accuracy on the held-out fifth."""
    rows = stratified(training_rows(spark, documents, seed), "label", "key")
    weights = balanced_weights(rows.filter("in_train"), "label").select("label", "weight")
    rows = rows.join(F.broadcast(weights), "label").cache()  # one row per label
    fit = rows.filter("in_train")
    model = pipeline(kind, fit.count()).fit(fit)
    score = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="accuracy").evaluate(model.transform(rows.filter("not in_train")))
    rows.unpersist()
    return model, score


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str, kind: str = "logistic_regression") -> PipelineModel:
    """The saved model; trained and saved first if there is none."""
    try:
        return PipelineModel.load(path)
    except Exception as e:
        if "does not exist" not in str(e) and "Input path" not in str(e):
            raise
        model, _ = train(spark, kind)
        save(model, path)
        return model


def predicted(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ml_type, ml_confidence, ml_probabilities (map) to rows with the 32 features."""
    names = model.stages[0].labels
    features = df.withColumns({f"__{c}": F.col(c) for c in FT.NAMES}).withColumns({c: F.col(c).cast("double") for c in FT.NAMES})
    out = features
    for stage in model.stages[1:]:
        out = stage.transform(out)
    p = F.slice(vector_to_array("probability"), 1, len(names))
    out = out.withColumn("__p", p)
    labels = F.array(*[F.lit(x) for x in names])
    out = out.withColumns({"ml_type": F.get(labels, argmax(F.col("__p"))), "ml_confidence": F.array_max("__p"), "ml_probabilities": F.map_from_arrays(labels, "__p")})
    out = out.withColumns({c: F.col(f"__{c}") for c in FT.NAMES})
    return out.drop("raw", "scaled", "features", "rawPrediction", "probability", "prediction", "__p", *[f"__{c}" for c in FT.NAMES])


