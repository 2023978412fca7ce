"""Publication formatting: profiles as a small dimension, broadcast, and a style record for every element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The presets. Alignment codes: 0 left, 1 centre, 2 right, 3 justified.
FIELDS = [
    "name", "body_font", "body_size_pt", "body_alignment", "body_line_spacing", "body_first_indent_cm", "top_margin_cm", "bottom_margin_cm", "left_margin_cm", "right_margin_cm",
    "heading_1_size_pt", "subheading_size_pt", "title_size_pt", "author_size_pt", "caption_size_pt", "reference_size_pt", "list_size_pt", "table_size_pt",
]
DEFAULTS = ("Times New Roman", 12.0, 3, 1.5, 1.27, 1.52, 1.52, 1.97, 1.96, 16.0, 12.0, 18.0, 12.0, 10.0, 10.0, 12.0, 10.0)
PRESETS = {
    "hackathon_default": {},
    "trade": {"body_size_pt": 10.5, "body_first_indent_cm": 0.635, "top_margin_cm": 1.905, "bottom_margin_cm": 1.905, "left_margin_cm": 1.588, "right_margin_cm": 1.588, "heading_1_size_pt": 14.0, "title_size_pt": 26.0},
    "academic": {"body_size_pt": 11.0, "body_first_indent_cm": 0.635, "top_margin_cm": 2.54, "bottom_margin_cm": 2.54, "left_margin_cm": 2.54, "right_margin_cm": 2.54, "heading_1_size_pt": 14.0},
    "fiction": {"body_size_pt": 11.0, "body_first_indent_cm": 0.635, "top_margin_cm": 2.0, "bottom_margin_cm": 2.0, "left_margin_cm": 2.0, "right_margin_cm": 2.0, "heading_1_size_pt": 15.0, "title_size_pt": 24.0},
}


def profiles(spark: SparkSession, extra: dict[str, dict] | None = None) -> DataFrame:
    """One row per profile; `extra` adds profiles as changes of the default."""
    rows = [(name, *[{**dict(zip(FIELDS[1:], DEFAULTS)), **changes}[f] for f in FIELDS[1:]]) for name, changes in {**PRESETS, **(extra or {})}.items()]
    return spark.createDataFrame(rows, "name string, body_font string, body_size_pt double, body_alignment int, " + ", ".join(f"{f} double" for f in FIELDS[4:]))


def alignment_name(code: Column) -> Column:
    return F.when(code == 0, "left").when(code == 1, "center").when(code == 2, "right").when(code == 3, "justified").otherwise("inherit")


def presets(spark: SparkSession) -> DataFrame:
    """The presets as an interface shows them."""
    return profiles(spark).withColumn("body_alignment", F.when(F.col("body_alignment") == 3, "justified").otherwise("left"))


def refined_type(label: Column, style_lc: Column, low: Column) -> Column:
    return (
        F.when((label == "heading") & style_lc.contains("heading 1") & (low.startswith("chapter ") | low.startswith("part ")), "chapter")
        .when((label == "heading") & ~style_lc.contains("heading 1") & (style_lc.contains("heading 2") | style_lc.contains("heading 3")), "subheading")
        .otherwise(label)
    )


#: label -> (size field, bold, italic, alignment code or None for the body's, first indent or None, left indent, page break, keep with next)
STYLES = {
    "title": ("title_size_pt", True, False, 1, 0.0, 0.0, False, False),
    "author": ("author_size_pt", False, False, 1, 0.0, 0.0, False, False),
    "chapter": ("heading_1_size_pt", True, False, 0, 0.0, 0.0, True, True),
    "heading": ("heading_1_size_pt", True, False, 0, 0.0, 0.0, False, True),
    "subheading": ("subheading_size_pt", True, False, 0, 0.0, 0.0, False, True),
    "caption": ("caption_size_pt", False, True, 1, 0.0, 0.0, False, False),
    "reference": ("reference_size_pt", False, False, 0, -0.762, 0.762, False, False),
    "list": ("list_size_pt", False, False, 0, -0.635, 0.635, False, False),
    "table": ("table_size_pt", False, False, 0, 0.0, 0.0, False, False),
    "figure": ("body_size_pt", False, False, 1, 0.0, 0.0, False, False),
}


def formatted(df: DataFrame, dim: DataFrame, label: str = "label", profile: str | None = None) -> DataFrame:
    """doc_id, idx, profile and the applied style; every profile of `dim`, or one. Needs with_text."""
    dim = F.broadcast(dim if profile is None else dim.filter(F.col("name") == profile))  # a handful of rows
    rows = df.withColumn("fmt_type", refined_type(F.col(label), F.col("style_lc"), F.col("low"))).join(dim, F.lit(True))
    y = F.col("fmt_type")

    def by(field: int, default):
        out = None
        for name, style in STYLES.items():
            v = style[field]
            v = F.col(v) if field == 0 else default if v is None else F.lit(v)
            out = F.when(y == name, v) if out is None else out.when(y == name, v)
        return out.otherwise(default)

    table = F.col("kind") == "table"
    return rows.select(
        "doc_id", "idx", F.col("name").alias("profile"), y.alias("element_type"), F.col("body_font").alias("font"), by(0, F.col("body_size_pt")).alias("font_size_pt"),
        alignment_name(by(3, F.col("body_alignment"))).alias("alignment"), F.when(y == "table", 1.0).otherwise(F.col("body_line_spacing")).alias("line_spacing"), by(4, F.col("body_first_indent_cm")).alias("first_line_indent_cm"),
        by(5, F.lit(0.0)).alias("left_indent_cm"), by(1, F.lit(False)).alias("bold"), by(2, F.lit(False)).alias("italic"), by(6, F.lit(False)).alias("page_break_before"), by(7, F.lit(False)).alias("keep_with_next"), table.alias("table_header_bold"),
    )


def run_overrides(df: DataFrame, styles: DataFrame) -> DataFrame:
    """doc_id, idx, profile, runs with font and size set; bold and italic are set except in body paragraphs."""
    rows = df.select("doc_id", "idx", "runs").join(styles, ["doc_id", "idx"])
    body = F.col("element_type") == "paragraph"
    runs = F.transform("runs", lambda r: F.struct(r["text"].alias("text"), F.when(body, r["bold"]).otherwise(F.col("bold")).alias("bold"), F.when(body, r["italic"]).otherwise(F.col("italic")).alias("italic"), F.col("font").alias("font_name"), F.col("font_size_pt").alias("font_size_pt")))
    return rows.select("doc_id", "idx", "profile", runs.alias("runs"))


def page_geometry(dim: DataFrame) -> DataFrame:
    return dim.select("name", "top_margin_cm", "bottom_margin_cm", "left_margin_cm", "right_margin_cm")


def progress(df: DataFrame) -> DataFrame:
    """Percentage after each element; needs with_position."""
    return df.select("doc_id", "idx", F.floor((F.col("idx") + 1) / F.greatest(F.lit(1), F.col("n")) * 90).cast("long").alias("progress"))
