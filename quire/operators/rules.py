"""Tier-1 rule engine: the first rule that holds, as one CASE of rule numbers and a literal table of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDCH = r"[\p{L}\p{N}_"
NOT_WORD = r"(?:$|[^\p{L}\p{N}_])"
# The patterns of the rules.
CHAPTER = r"(?idu)^(chapter|ch\.|part|book|section)\s+([0-9ivxlcdm]+|[a-z]+)" + r"(?=$|[^\p{L}\p{N}_])[:\s\-—]*.*$"
FRONT_HEADER = r"(?idu)^(prologue|epilogue|preface|foreword|acknowledgments?|abstract|introduction)\s*$"
CAPTION = r"(?idu)^(figure|fig\.|table|tbl\.|plate|chart|graph|illustration)\s+\p{Nd}+[.:\s\-—]+"
NUMBERED = r"(?d)^(\p{Nd}+(\.\p{Nd}+)*)\.?\s+([A-Z]" + WORDCH + r"\s,–—\-?]+)$"
NUMBERED_SUB = r"(?d)^(\p{Nd}+\.\p{Nd}+\.\p{Nd}+(\.\p{Nd}+)*)\.?\s+([A-Z]" + WORDCH + r"\s,–—\-?]+)$"
BULLET = r"^[*\-•–—◦▪▫►⁃]\s+"
NUMBER_LIST = r"^(\p{Nd}+[.)]|\([0-9]+\)|[a-zA-Z][.)]|\([a-zA-Z]\))\s+"
SHORT_TITLE = r"(?d)^[A-Z]" + WORDCH + r"'-]*(?:\s+[A-Za-z]" + WORDCH + r"'-]*){1,5}$"
REF_NUMERIC = r"^\[\p{Nd}+\]\s+[A-Z]"
REF_NUMBERED_YEAR = r"(?d)^(\[\p{Nd}+\]|\p{Nd}+[.)])\s+[A-Z][a-zA-Z\s\-.]+,?\s+.*?(?<![\p{L}\p{N}_])(18|19|20)\p{Nd}{2}" + NOT_WORD
REF_AUTHOR_YEAR = r"(?d)^[A-Z][a-zA-Z\s\-]+,\s+[A-Z]\.\s*(.*?(?<![\p{L}\p{N}_])(19|20)\p{Nd}{2}" + NOT_WORD + ")"
REF_HEADER = r"(?idu)^(references|bibliography|works cited|literature cited)\s*$"
AFFILIATION = r"(?iu)(?<![\p{L}\p{N}_])(department of|university|faculty of|institute of|laboratory|ph\.d|m\.d)" + NOT_WORD + r"|(?iu)(?<![\p{L}\p{N}_])(dr\.|prof\.|email:)(?=[\p{L}\p{N}_])|(?iu)(?<=[\p{L}\p{N}_])@[\p{L}\p{N}_.\-]+\.(edu|org|ac\.uk|gov|com)" + NOT_WORD

#: rule number -> (rule name, label, confidence); 0: no rule. 11 is a heading or, if its number has a dot, a subheading.
RULES: dict[int, tuple[str, str, float]] = {
    1: ("rule_table_element", "table", 1.00),
    2: ("rule_figure_element", "figure", 1.00),
    3: ("rule_native_list_metadata", "list", 0.99),
    4: ("rule_list_style", "list", 0.97),
    5: ("rule_caption_pattern", "caption", 0.98),
    6: ("rule_chapter_prefix", "chapter", 0.99),
    7: ("rule_front_matter_chapter", "chapter", 0.95),
    8: ("rule_references_header", "heading", 0.98),
    9: ("rule_reference_entry_pattern", "reference", 0.97),
    10: ("rule_numbered_subheading", "subheading", 0.97),
    11: ("rule_numbered_heading", "heading", 0.96),
    12: ("rule_list_regex_marker", "list", 0.96),
    13: ("rule_short_title_heading", "heading", 0.93),
    14: ("rule_front_matter_title", "title", 0.95),
    15: ("rule_author_affiliation", "author", 0.96),
}


def rule_id() -> Column:
    """Number of the first rule that holds, 0 if none does; needs with_text and with_position."""
    t, s, wc, pos, kind = F.col("t"), F.col("style_lc"), F.col("wc"), F.col("pos"), F.col("kind")
    para = kind == "paragraph"
    dot = t.endswith(".")
    return (
        F.when(kind == "table", 1)
        .when((kind == "figure") | para & F.col("contains_drawing") & (t == ""), 2)
        .when(para & F.col("list_info").isNotNull(), 3)
        .when(s.contains("bullet") | s.contains("list"), 4)
        .when(t.rlike(CAPTION) | s.contains("caption"), 5)
        .when(t.rlike(CHAPTER), 6)
        .when((pos < 0.25) & t.rlike(FRONT_HEADER), 7)
        .when((pos > 0.50) & t.rlike(REF_HEADER), 8)
        .when((pos > 0.50) & (t.rlike(REF_NUMBERED_YEAR) | t.rlike(REF_NUMERIC) | t.rlike(REF_AUTHOR_YEAR)), 9)
        .when((wc < 20) & ~dot & t.rlike(NUMBERED_SUB), 10)
        .when((wc < 15) & ~dot & t.rlike(NUMBERED), 11)
        .when((wc < 80) & (t.rlike(BULLET) | t.rlike(NUMBER_LIST)), 12)
        .when((pos >= 0.10) & (wc <= 6) & ~t.rlike(r"[.:?!]$") & t.rlike(SHORT_TITLE), 13)
        .when((pos < 0.10) & ((s == "title") | (pos == 0) & (wc <= 15) & ~dot), 14)
        .when((pos < 0.10) & (t.rlike(AFFILIATION) | s.isin("author", "subtitle")), 15)
        .otherwise(0)
    )


def _looked_up(field: int) -> Column:
    table = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.lit(v[field]))])
    return table[F.col("rule_id")]


def reason() -> Column:
    texts = {1: "Native TableElement structure", 2: "Native FigureElement or pure drawing block", 6: "Matches explicit chapter marker pattern", 7: "Matches standalone front-matter chapter/section title",
             8: "Matches 'References' or 'Bibliography' section header in back-matter", 9: "Matches citation entry format [N] or Author (Year) in back-matter", 10: "Matches hierarchical decimal subheading pattern (X.Y.Z)",
             12: "Starts with bullet character or numbered list prefix", 13: "Short title-case label without list or sentence punctuation", 14: "First block in front-matter with title characteristics", 15: "Contains academic affiliation, email, or author credentials in front-matter"}  # fixed values
    r = F.col("rule_id")
    return (
        F.when(r == 3, F.format_string("Word numbering numPr present (num_id=%s, ilvl=%s)", F.coalesce(F.col("list_info.num_id").cast("string"), F.lit("None")), F.col("list_info.ilvl")))
        .when(r == 4, F.format_string("Word style indicates list: '%s'", "style"))
        .when(r == 5, F.format_string("Matches caption prefix or style '%s'", F.coalesce("style", F.lit("None"))))
        .when(r == 11, F.format_string("Matches numbered heading pattern (%s)", F.regexp_extract("t", NUMBERED, 1)))
        .otherwise(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v))])[r])
    )


def with_rules(df: DataFrame) -> DataFrame:
    """Adds rule_id, rule_name, rule_type, rule_confidence (null where no rule holds)."""
    rows = df.withColumn("rule_id", rule_id())
    sub = (F.col("rule_id") == 11) & F.regexp_extract("t", NUMBERED, 1).contains(".")
    return rows.withColumns({"rule_name": _looked_up(0), "rule_type": F.when(sub, "subheading").otherwise(_looked_up(1)), "rule_confidence": _looked_up(2)})


def arbitrated(df: DataFrame, threshold: float = 0.90, model_type: Column | None = None, model_confidence: Column | None = None, model_name: str = "none") -> DataFrame:
    """Adds label, conf, tier, detection_method: blank text, then a rule of at least the threshold, then the model (without one: paragraph)."""
    blank = (F.col("t") == "") & ~F.col("kind").isin("table", "figure") & ~F.col("contains_drawing")
    rule = F.col("rule_confidence") >= threshold
    rule = F.coalesce(rule, F.lit(False))
    other = model_type if model_type is not None else F.lit("paragraph")
    other_conf = model_confidence if model_confidence is not None else F.lit(0.5)
    rows = df.withColumns({
        "label": F.when(blank, "paragraph").when(rule, F.col("rule_type")).otherwise(other),
        "conf": F.when(blank, 1.0).when(rule, F.col("rule_confidence")).otherwise(other_conf),
        "tier": F.when(blank | rule, "rule").otherwise("ml"),
        "matched_rule": F.when(blank, "rule_empty_paragraph").when(rule, F.col("rule_name")),
    })
    return rows.withColumn("detection_method", F.concat("tier", F.lit(":"), F.coalesce("matched_rule", F.lit(model_name))))
