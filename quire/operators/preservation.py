"""Proof that text is preserved: normalised tokens, ordered fingerprints and positional differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def normalized(x: Column | str, unicode_form: bool = True) -> Column:
    """NFKC, line ends to LF, runs of blanks to one space, lines stripped, empty lines dropped."""
    c = X.nfkc(F.coalesce(X._c(x), F.lit(""))) if unicode_form else F.coalesce(X._c(x), F.lit(""))
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda s: X.strip(F.regexp_replace(s, r"[ \t\x0B\f]+", " "))), lambda s: s != ""), "\n")


def with_token(df: DataFrame, unicode_form: bool = True) -> DataFrame:
    return df.withColumn("token", normalized("text", unicode_form))


def fingerprint(tokens: DataFrame) -> DataFrame:
    """Per document: sha256, element_count, word_count, char_count; tokens in order, joined by an empty line."""
    joined = tokens.groupBy("doc_id").agg(F.expr("listagg(case when token <> '' then token end, '\n\n') within group (order by idx)").alias("body"), F.count("*").alias("element_count"))
    body = F.coalesce("body", F.lit(""))
    return joined.select("doc_id", F.sha2(body.cast("binary"), 256).alias("sha256"), "element_count", X.count_tokens(body).cast("long").alias("word_count"), F.length(body).cast("long").alias("char_count"))


def differences(source: DataFrame, output: DataFrame) -> DataFrame:
    """doc_id, idx, state (same, changed, missing, added) of every position of either side."""
    a = source.select("doc_id", "idx", F.col("token").alias("l"))
    b = output.select("doc_id", "idx", F.col("token").alias("r"))
    both = a.join(b, ["doc_id", "idx"], "full_outer")
    return both.select("doc_id", "idx", F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "added").when(F.col("l") != F.col("r"), "changed").otherwise("same").alias("state"))


def report(source: DataFrame, output: DataFrame) -> DataFrame:
    """Per document: the index lists, both hashes and whether all agrees."""
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("idx"))))
    lists = differences(source, output).groupBy("doc_id").agg(ids("changed").alias("changed"), ids("missing").alias("missing"), ids("added").alias("added"))
    a, b = (fingerprint(x).select("doc_id", F.col("sha256").alias(n)) for x, n in ((source, "source_hash"), (output, "output_hash")))
    rows = lists.join(a, "doc_id", "left").join(b, "doc_id", "left")
    return rows.withColumn("is_identical", F.col("source_hash").eqNullSafe(F.col("output_hash")) & (F.size("changed") == 0) & (F.size("missing") == 0) & (F.size("added") == 0))


def identity(source: DataFrame, output: DataFrame) -> DataFrame:
    """Per document: whether the hashes agree, and the message that says so."""
    a, b = fingerprint(source), fingerprint(output)
    rows = a.alias("a").join(b.alias("b"), "doc_id")
    same = F.col("a.sha256") == F.col("b.sha256")
    differs = F.format_string("Content mismatch! Hash A (%s...) != Hash B (%s...). Chars: %d vs %d, Words: %d vs %d.", F.substring("a.sha256", 1, 12), F.substring("b.sha256", 1, 12), F.col("a.char_count"), F.col("b.char_count"), F.col("a.word_count"), F.col("b.word_count"))
    return rows.select("doc_id", same.alias("is_identical"), F.when(same, "100% textual content preservation verified.").otherwise(differs).alias("message"))


def checked(source: DataFrame, output: DataFrame) -> DataFrame:
    """The report; reading it fails if any document differs."""
    return report(source, output).withColumn("is_identical", F.when(F.col("is_identical"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("content differs in document "), F.col("doc_id").cast("string")))))
