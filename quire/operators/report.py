"""Reports: counts by label and tier, totals, previews and response shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import LABELS


def type_counts(df: DataFrame, label: str) -> DataFrame:
    """doc_id and the map label -> count."""
    n = df.groupBy("doc_id", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("type_counts"))


def type_pivot(df: DataFrame, label: str) -> DataFrame:
    """One column per label, 0 where it is absent."""
    return df.groupBy("doc_id").agg(*[F.count_if(F.col(label) == y).alias(f"{y}_count") for y in LABELS])


def tiers(df: DataFrame) -> DataFrame:
    """Elements labelled by rules and by the model, before smoothing, and those that smoothing changed; one may count twice."""
    return df.groupBy("doc_id").agg(F.count_if(F.col("tier") == "rule").alias("rule_count"), F.count_if(F.col("tier") == "ml").alias("ml_count"), F.count_if(F.col("final_label") != F.col("label")).alias("smoothed_count"), F.count("*").alias("total"))


def average_confidence(docs: DataFrame, df: DataFrame, conf: str = "final_conf") -> DataFrame:
    """Mean confidence of every document of `docs`, 1 without elements; summed in whole hundredths, so that order can't matter."""
    mean = df.groupBy("doc_id").agg((F.sum(F.round(F.col(conf) * 100).cast("long")) / F.count("*") / F.lit(100)).alias("m"))
    return docs.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(1.0)).alias("avg_confidence"))


def totals(df: DataFrame) -> DataFrame:
    """Needs with_text."""
    return df.groupBy("doc_id").agg(F.count("*").alias("elements"), F.sum(F.col("wc").cast("long")).alias("words"), F.sum(F.length("text").cast("long")).alias("chars"))


def preview(df: DataFrame) -> DataFrame:
    """The first 160 characters, null without text."""
    return df.withColumn("preview", F.when(F.col("text") != "", F.substring("text", 1, 160)))


def summary_lines(df: DataFrame, k: int = 15) -> DataFrame:
    """The first k elements as summary lines: a table's rows parted by bars, other text on one line."""
    line = F.when(F.col("kind") == "table", F.substring(F.replace("text", F.lit("\n"), F.lit(" | ")), 1, 60)).otherwise(F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 65))
    return df.filter(F.col("idx") < k).withColumn("line", line)


def omitted(df: DataFrame, k: int = 15) -> DataFrame:
    return df.groupBy("doc_id").agg(F.greatest(F.lit(0), F.count("*") - k).cast("long").alias("omitted"))


def bands(df: DataFrame, conf: str) -> DataFrame:
    band = F.when(F.col(conf) >= 0.9, "high").when(F.col(conf) >= 0.75, "medium").otherwise("low")
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def element_response(df: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """The element list of a report; formatting joined by position, null without."""
    rows = preview(df).select("doc_id", "idx", F.col("final_label").alias("element_type"), F.col("final_conf").alias("confidence"), F.col("tier").alias("detection_method"), F.coalesce("matched_rule", F.lit("")).alias("reason"), "preview")
    if styles is None:
        return rows.withColumn("formatting", F.lit(None).cast("string"))
    s = styles.select("doc_id", "idx", F.to_json(F.struct("font", "font_size_pt", "alignment", "bold", "italic")).alias("formatting"))
    return rows.join(s, ["doc_id", "idx"], "left")


def document_response(df: DataFrame, label: str = "final_label") -> DataFrame:
    """One JSON document per doc_id: totals and statistics."""
    return totals(df).join(type_counts(df, label), "doc_id").select("doc_id", F.to_json(F.struct("elements", "words", "chars", F.col("type_counts").alias("statistics"), F.array().cast("array<string>").alias("errors"), F.array().cast("array<string>").alias("warnings"))).alias("report"))


def format_summary(df: DataFrame, doc_id: int, k: int = 15) -> str:
    """A text report of one document: counts in label order and the first k elements. Driver-side, of a few rows."""
    own = df.filter(F.col("doc_id") == doc_id)
    head = totals(own).first()
    counts = {r["label"]: r["n"] for r in own.groupBy(F.col("final_label").alias("label")).agg(F.count("*").alias("n")).collect()}
    lines = [f"Document {doc_id}: {head['elements'] if head else 0} elements, {head['words'] if head else 0} words, {head['chars'] if head else 0} characters"]
    lines += [f"  {y}: {counts[y]}" for y in LABELS if y in counts]
    shown = summary_lines(own, k).orderBy("idx").select("idx", "final_label", "line").collect()
    lines += [f"  [{r['idx']:03d}] {r['final_label']}: {r['line']}" for r in shown]
    if head and head["elements"] > k:
        lines.append(f"  ... and {head['elements'] - k} more")
    return "\n".join(lines)


def words_of(df: DataFrame) -> DataFrame:
    return df.withColumn("words", X.words("text"))
