"""The 32 structural features as columns; text features are row-local, positions and neighbours one window over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as X

ROMAN = X.EDGE_L + r"[IVXLCDM]+" + X.EDGE_R
CITATION = r"(\[\d+\]|\([A-Za-z]+(\s+et\s+al\.)?,\s*\d{4}\))"
YEAR = r"(?U)\b(18|19|20)\d{2}\b"
BULLET = r"^[*\-•–—◦▪▫►⁃]\s+"

SURFACE = ["char_length", "word_count", "avg_word_length", "uppercase_ratio", "is_all_caps", "is_title_case", "digit_ratio", "ends_with_period", "ends_with_colon", "ends_with_question"]
LEXICAL = ["stopword_ratio", "sentence_count", "starts_with_number", "contains_roman_numeral", "citation_marker_count", "year_mention_count"]
POSITION = ["relative_doc_position", "is_front_matter", "is_back_matter", "prev_elem_word_count", "next_elem_word_count", "distance_from_doc_start", "distance_to_doc_end", "is_isolated"]
TYPOGRAPHY = ["is_bold", "is_italic", "all_runs_bold", "font_size_pt", "relative_font_size", "has_drawing", "is_table", "is_list_marker"]
NAMES = SURFACE + LEXICAL + POSITION + TYPOGRAPHY


def window(order: str = "idx", key: str = "doc_id") -> W:
    return W.partitionBy(key).orderBy(order)


def with_text(df: DataFrame) -> DataFrame:
    """Adds t (stripped text), low, style_lc, wc: computed once for all operators."""
    rows = df.withColumn("t", X.strip(F.coalesce("text", F.lit(""))))
    return rows.withColumns({"low": F.lower("t"), "style_lc": F.lower(F.coalesce("style", F.lit(""))), "wc": X.count_tokens("t")})


def with_position(df: DataFrame) -> DataFrame:
    """Adds n (elements of the document) and pos (idx over n - 1); one exchange by document, which later windows reuse."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    return df.withColumn("n", n).withColumn("pos", F.when(F.col("n") > 1, F.col("idx") / (F.col("n") - 1)).otherwise(F.lit(0.0)))


def any_run(field: str) -> Column:
    return F.exists("runs", lambda r: F.coalesce(r[field], F.lit(False)))


def max_size() -> Column:
    """The largest run size; null without one."""
    return F.array_max(F.transform("runs", lambda r: r["font_size_pt"]))


def with_median(df: DataFrame) -> DataFrame:
    """Adds median_size: of the document's positive run sizes, 11 without any. Sizes are reduced before they are joined."""
    sizes = df.select("doc_id", F.explode("runs").alias("r")).select("doc_id", F.col("r.font_size_pt").alias("s")).filter("s > 0")
    medians = sizes.groupBy("doc_id").agg(F.median("s").alias("m")).withColumnRenamed("doc_id", "m_doc")
    return df.join(medians, df["doc_id"] == medians["m_doc"], "left").withColumn("median_size", F.coalesce("m", F.lit(11.0))).drop("m", "m_doc")


def text_features(df: DataFrame) -> DataFrame:
    """F1 to F16 and F25 to F32 without the relative size; needs with_text."""
    t, wc = F.col("t"), F.col("wc")
    rows = df.withColumns({"__words": X.words("low"), "__alpha": X.count(t, r"\p{L}"), "__runs": F.filter("runs", lambda r: X.strip(F.coalesce(r["text"], F.lit(""))) != ""), "__max": max_size()})
    stop = F.size(F.filter("__words", lambda w: F.array_contains(X.literal_set(X.STOPWORDS), w)))
    length = F.length(t)
    return rows.withColumns({
        "char_length": length.cast("long"),
        "word_count": wc.cast("long"),
        "avg_word_length": length / F.greatest(F.lit(1), wc),
        "uppercase_ratio": X.count(t, r"\p{Lu}") / F.greatest(F.lit(1), F.col("__alpha")),
        "is_all_caps": X.is_upper(t) & (length > 3),
        "is_title_case": X.is_title(t) & (wc > 1),
        "digit_ratio": X.count(t, r"[\p{Nd}²³¹⁰-⁹₀-₉]") / F.greatest(F.lit(1), length),
        "ends_with_period": t.endswith("."),
        "ends_with_colon": t.endswith(":"),
        "ends_with_question": t.endswith("?"),
        "stopword_ratio": X.ratio(stop, F.size("__words")),
        "sentence_count": X.count(t, r"(?U)[.!?]+(?:\s+|$)").cast("long"),
        "starts_with_number": t.rlike(r"^\p{Nd}+"),
        "contains_roman_numeral": t.rlike(ROMAN),
        "citation_marker_count": X.count(t, CITATION).cast("long"),
        "year_mention_count": X.count(t, YEAR).cast("long"),
        "is_bold": any_run("bold"),
        "is_italic": any_run("italic"),
        "all_runs_bold": (F.size("__runs") > 0) & F.forall("__runs", lambda r: F.coalesce(r["bold"], F.lit(False))),
        "font_size_pt": F.coalesce("__max", F.lit(0.0)),
        "has_drawing": (F.col("kind") == "figure") | (F.col("kind") == "paragraph") & F.col("contains_drawing"),
        "is_table": F.col("kind") == "table",
        "is_list_marker": (F.col("kind") == "paragraph") & F.col("list_info").isNotNull() | t.rlike(BULLET),
    }).drop("__words", "__alpha", "__runs", "__max")


def position_features(df: DataFrame) -> DataFrame:
    """F17 to F24; needs with_text and with_position."""
    w = window()
    rows = df.withColumns({"__prev": F.lag("wc", 1, 0).over(w), "__next": F.lead("wc", 1, 0).over(w)})
    return rows.withColumns({
        "relative_doc_position": F.col("pos"),
        "is_front_matter": F.col("pos") < 0.10,
        "is_back_matter": F.col("pos") > 0.80,
        "prev_elem_word_count": F.col("__prev").cast("long"),
        "next_elem_word_count": F.col("__next").cast("long"),
        "distance_from_doc_start": F.col("idx").cast("long"),
        "distance_to_doc_end": (F.col("n") - 1 - F.col("idx")).cast("long"),
        "is_isolated": (F.col("wc") < 20) & ((F.col("__prev") > 25) | (F.col("__next") > 25)),
    }).drop("__prev", "__next")


def all_features(df: DataFrame, fixed_median: float | None = None) -> DataFrame:
    """All 32 features beside the element's columns."""
    rows = with_text(df)
    rows = rows.withColumn("median_size", F.lit(fixed_median)) if fixed_median else with_median(rows)
    rows = position_features(with_position(text_features(rows)))
    return rows.withColumn("relative_font_size", F.when(F.col("font_size_pt") > 0, F.col("font_size_pt") - F.col("median_size")).otherwise(F.lit(0.0)))


def vector(df: DataFrame) -> DataFrame:
    """`df` with the features as one array<double> column `vector`, in the order of NAMES."""
    return df.withColumn("vector", F.array(*[F.col(c).cast("double") for c in NAMES]))
