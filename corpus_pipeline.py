"""Corpus pipeline: five stages of the training-data operators, each written as Parquet and reread as the next one's input.

Every function takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
`documents`; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard, langid, mixing, packing, pii
from quire.llm.common import free_name, stored
from quire.llm.queries import tokenizer_path

#: A document whose best language has a lower posterior is rejected, as is one without letters.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language."""
    model = langid.train(docs.filter(~langid.held_out()), "text", "lang", F.col("doc_id"))
    lang, score = free_name(docs.columns, "__lang_pred"), free_name(docs.columns, "__score")
    rows = langid.with_language(docs, model, "text", lang, score)
    return rows.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, cfg=jaccard.JoinConfig(words=5, percent=80))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates."""
    n = free_name(docs.columns, "__n")
    rows = pii.replaced(docs, count=n)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(n) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's weight takes them; the last of a source may be cut short."""
    order = mixing.training_order(mixing.mix(docs, carry=True), "size", "row")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    cut_short = F.col("words") < F.col("size")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out["text"] = F.when(cut_short, part).otherwise(out["text"])
    if "n_chars" in out:
        out["n_chars"] = F.when(cut_short, F.length(part).cast("long")).otherwise(out["n_chars"])
    return order.select(*[x.alias(c) for c, x in out.items()])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, packing.PackConfig(tokenizer_path()))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("PII surrogates", surrogates), ("mixing to weights", mixture), ("packing", sequences)]

#: Naive Bayes, keyed surrogates and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
