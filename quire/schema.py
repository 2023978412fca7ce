"""Data model: the element row, its nested types and the label vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

#: Labels in declaration order (summaries sort by it).
LABELS = ["paragraph", "heading", "subheading", "chapter", "title", "author", "table", "figure", "caption", "list", "reference", "unknown"]
#: Labels that models predict.
TRAINED_LABELS = LABELS[:-1]
LABEL_ALIASES = {
    "BODY_PARAGRAPH": "paragraph",
    "CHAPTER_HEADING": "chapter",
    "AUTHOR_DETAILS": "author",
    "LIST_ITEM": "list",
    "REFERENCES": "reference",
}

RUN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("bold", T.BooleanType()),
    T.StructField("italic", T.BooleanType()),
    T.StructField("underline", T.BooleanType()),
    T.StructField("font_name", T.StringType()),
    T.StructField("font_size_pt", T.DoubleType()),
    T.StructField("superscript", T.BooleanType()),
    T.StructField("subscript", T.BooleanType()),
])
LIST_INFO = T.StructType([T.StructField("num_id", T.IntegerType()), T.StructField("ilvl", T.IntegerType()), T.StructField("is_bullet", T.BooleanType()), T.StructField("is_numbered", T.BooleanType())])
CELL = T.StructType([T.StructField("row_idx", T.IntegerType()), T.StructField("col_idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType()))])
FIGURE = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("image_filename", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("width_pt", T.DoubleType()), T.StructField("height_pt", T.DoubleType()), T.StructField("caption_text", T.StringType())])

ELEMENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("element_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("element_type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("detection_method", T.StringType()),
    T.StructField("list_info", LIST_INFO),
    T.StructField("contains_drawing", T.BooleanType()),
    T.StructField("alignment", T.StringType()),
    T.StructField("rows_count", T.IntegerType()),
    T.StructField("cols_count", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.ArrayType(CELL))),
    T.StructField("figure", FIGURE),
])

DOCUMENT = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("modified", T.StringType()),
    T.StructField("revision", T.IntegerType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("source_file_sha256", T.StringType()),
])
