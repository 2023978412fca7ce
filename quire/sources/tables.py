"""Element views over the star-schema tables: ordered rows (doc_id, idx, kind, text, style, runs, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The manuscript overlay: valid SQL in Spark and DuckDB alike, so that both read the same elements. `line` is the document's line.
SLOT = "((doc_id * 31 + idx) % 16)"
OVERLAY = {
    "kind": f"case when {SLOT} = 3 then 'table' when {SLOT} = 5 then 'figure' else 'paragraph' end",
    "text": f"""case {SLOT}
        when 0 then 'Chapter ' || cast(idx % 9 + 1 as string) || ': Foundations'
        when 1 then '1.2 System Overview' when 2 then '1.2.1 Detailed Design'
        when 3 then 'Node' || chr(9) || 'Rate' || chr(10) || 'n1' || chr(9) || '12'
        when 4 then case when doc_id % 3 = 0 then 'Throughput as shown above' else 'Table 1.2: Latency comparison' end
        when 5 then '' when 6 then 'Figure 1.1: State transition diagram'
        when 7 then '• ' || line when 9 then '[3] Smith, J. (1999) Systems of ' || substring(line, 1, 20)
        when 10 then case when doc_id % 4 = 0 then 'Bibliography' else 'References' end
        when 11 then '  ' when 13 then 'see ' || substring(line, 1, 30) || ' in 1999' when 12 then 'Machine Learning Systems'
        when 14 then case doc_id % 12 when 0 then 'Department of Computing, University of Paris' when 1 then 'Abstract: the study' when 2 then 'Acknowledgements'
            when 3 then 'Conclusions' when 4 then 'Part Two: The Return' when 5 then 'CHAPTER XIV' when 6 then 'a. Primary node' when 7 then '1. Initialize registers to state zero.'
            when 8 then 'Fig. 2 — Network Latency Plot' when 9 then 'Tbl. 3: Latency Comparisons' when 10 then 'Knuth, D. E. (1997). The Art of Computer Programming.' else '1. Introduction and Motivations' end
        else line end""",
    "style": f"""case {SLOT} when 0 then 'Heading 1' when 1 then 'Heading 2' when 2 then 'Heading 3' when 3 then null when 8 then 'List Bullet'
        when 6 then case when doc_id % 2 = 0 then 'Caption' else 'Normal' end
        when 15 then case doc_id % 5 when 0 then 'Title' when 1 then 'Author' when 2 then 'Subtitle' when 3 then 'Heading 1' else case when doc_id % 2 = 0 then 'Caption' else 'Body Text' end end else 'Normal' end""",
    "bold": f"case when {SLOT} in (0, 1, 13) then true when {SLOT} in (2, 9) then false else null end",
    "italic": f"case when {SLOT} in (6, 13) then true else null end",
    "size": f"case when {SLOT} = 0 then 18.0 when {SLOT} in (1, 13) then 14.0 when {SLOT} in (4, 7, 12) then 11.0 when {SLOT} = 9 then 10.5 else null end",
    "listed": f"{SLOT} = 8",
    "contains_drawing": f"{SLOT} = 11 and doc_id % 2 = 0",
    "rows_count": f"case when {SLOT} = 3 then 2 else 0 end",
    "cols_count": f"case when {SLOT} = 3 then 2 else 0 end",
}
#: Expanded to two runs: the first five characters and the rest; only the first is set when doc_id is odd.
RUN_SPLIT = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, line: one row per line of a document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))


def manuscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines with a deterministic overlay that brings every structure: the common input of the operators."""
    rows = doc_elements(spark, sf_dir).selectExpr("doc_id", "idx", *[f"{v} as {k}" for k, v in OVERLAY.items()])
    size, bold, italic = F.col("size").cast("double"), F.col("bold"), F.col("italic")
    odd = F.col("doc_id") % 2 == 1
    run = lambda t, first: F.struct(
        t.alias("text"), (bold if first else F.when(odd, F.lit(None)).otherwise(bold)).cast("boolean").alias("bold"), (italic if first else F.lit(None)).cast("boolean").alias("italic"),
        F.lit(None).cast("boolean").alias("underline"), F.lit(None).cast("string").alias("font_name"), (size if first else size - 1).alias("font_size_pt"),
        F.lit(None).cast("boolean").alias("superscript"), F.lit(None).cast("boolean").alias("subscript"),
    )
    text = F.col("text")
    runs = F.when((F.col("kind") == "paragraph") & (text != ""), F.array(run(F.substring(text, 1, RUN_SPLIT), True), run(F.substring(text, RUN_SPLIT + 1, 1_000_000_000), False))).otherwise(F.array().cast("array<" + "struct<text:string,bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size_pt:double,superscript:boolean,subscript:boolean>" + ">"))
    listed = F.when(F.col("listed"), F.struct(F.lit(1).alias("num_id"), F.lit(0).alias("ilvl"), F.lit(True).alias("is_bullet"), F.lit(False).alias("is_numbered")))
    return rows.select("doc_id", "idx", "kind", "text", "style", runs.alias("runs"), listed.alias("list_info"), "contains_drawing", "rows_count", "cols_count")


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, idx, tag, style, text, bold: the blocks of a web page by its opening tags."""
    html = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<!--.*?-->", "")
    marked = F.regexp_replace(html, r"(?i)<(title|h1|p|li|footer)(\s[^>]*)?>", "\x01$1\x02")
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(marked, "\x01")).alias("idx", "piece")).filter("idx > 0")
    tag = F.lower(F.substring_index("piece", "\x02", 1))
    raw = F.substring(F.col("piece"), F.length(tag) + 2, F.lit(1_000_000_000))
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)<[^>]*>", ""), r"\s+", " "))
    style = F.when(tag == "title", "Title").when(tag == "h1", "Heading 1").when(tag == "li", "List Bullet").otherwise("Normal")
    return rows.select("page_id", F.col("idx"), tag.alias("tag"), style.alias("style"), text.alias("text"), F.col("piece").contains("<b>").alias("bold"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, rows_count, cols_count, text: each order's lines as a table, cells by tab, rows by line end."""
    li = read(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.trim("l_returnflag")).alias("row"))
    return li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(
        "o_orderkey", F.size("rows").cast("long").alias("rows_count"), F.lit(3).cast("long").alias("cols_count"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n").alias("text")
    )


def conv_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text: a second ordered stream."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def initial_type() -> Column:
    """The type that native list data and the style name give before any classification."""
    s = F.lower(F.coalesce(F.col("style"), F.lit("")))
    return (
        F.when(F.col("kind") == "table", "table")
        .when(F.col("kind") == "figure", "figure")
        .when(F.col("list_info").isNotNull(), "list")
        .when(s == "title", "title")
        .when(s.isin("subtitle", "author"), "author")
        .when(s.contains("heading"), "heading")
        .when(s.contains("caption"), "caption")
        .when(s.contains("reference") | s.contains("bibliography"), "reference")
        .when(s.contains("list") | s.contains("bullet"), "list")
        .otherwise("paragraph")
    )


def list_info(num_id: Column, ilvl: Column, style: Column) -> Column:
    """Native numbering data, else what the style name tells; null if neither says anything."""
    s = F.lower(F.coalesce(style, F.lit("")))
    pack = lambda bullet, numbered: F.struct(num_id.alias("num_id"), F.coalesce(ilvl, F.lit(0)).alias("ilvl"), F.lit(bullet).alias("is_bullet"), F.lit(numbered).alias("is_numbered"))
    return F.when(num_id.isNotNull(), pack(False, True)).when(s.contains("bullet"), pack(True, False)).when(s.contains("number") | s.contains("list"), pack(False, True))
