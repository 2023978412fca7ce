"""Configurable pattern detector. The configuration shapes the plan: disabled categories and unused patterns emit no branch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as FT
from ..functions import text as X
from .rules import NOT_WORD, WORDCH

CATEGORIES = ("chapter", "heading", "figure", "table", "reference", "list", "front_matter", "special_section")

# Number words, numerals and patterns.
NUMBER_WORDS = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
    "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth"
)
ROMAN = "(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{1,3})"
HEAD = r"^(?:chapter|ch\.|part|book|section)\s+"
TAIL = r"[:\s\-—]*(.*)$"
CHAPTER_DIGIT = "(?idu)" + HEAD + r"(\p{Nd}+)" + TAIL
CHAPTER_WORD = "(?idu)" + HEAD + f"({NUMBER_WORDS})" + TAIL
CHAPTER_ROMAN = "(?idu)" + HEAD + f"({ROMAN})" + TAIL
TITLE_TAIL = r"[.:]?\s+([A-Z]" + WORDCH + r"\s,–—\-?]+)$"
HEADING_1 = r"(?d)^(\p{Nd}+)" + TITLE_TAIL
HEADING_2 = r"(?d)^(\p{Nd}+\.\p{Nd}+)" + TITLE_TAIL
HEADING_3 = r"(?d)^(\p{Nd}+\.\p{Nd}+\.\p{Nd}+(?:\.\p{Nd}+)*)" + TITLE_TAIL
FIGURE = r"(?idu)^(?:figure|fig\.|fig)\s+(\p{Nd}+(?:\.\p{Nd}+)?)[:\s\-—.]*(.*)$"
TABLE = r"(?idu)^(?:table|tbl\.|tbl)\s+(\p{Nd}+(?:\.\p{Nd}+)?)[:\s\-—.]*(.*)$"
REF_HEADER = r"(?idu)^(?:references|bibliography|works cited|literature cited)\s*$"
REF_ENTRY = r"(?d)^((?:\[\p{Nd}+\]|\p{Nd}+[.)])\s+[A-Z][a-zA-Z\s\-.]+,?\s+.*?(?<![\p{L}\p{N}_])(?:18|19|20)\p{Nd}{2})" + NOT_WORD
LIST_NUMBER = r"(?d)^(?:(\p{Nd}+)[.)]|\((\p{Nd}+)\))\s+(.*)$"
LIST_LETTER = r"(?d)^(?:([a-zA-Z])[.)]|\(([a-zA-Z])\))\s+(.*)$"
LIST_BULLET = r"(?d)^([*\-•–—◦▪▫►⁃])\s+(.*)$"
ABSTRACT = r"(?idu)^(?:abstract|executive summary)\s*[:\-—]*\s*(.*)$"
ACKNOWLEDGE = r"(?idu)^(?:acknowledgements?|acknowledgments?)\s*[:\-—]*\s*(.*)$"
CONCLUSION = r"(?idu)^(?:conclusion|conclusions|concluding remarks|summary and conclusions)\s*[:\-—]*\s*(.*)$"
AFFILIATION = (
    r"(?iu)((?<![\p{L}\p{N}_])(?:department of|university of|university|faculty of|school of|institute of|laboratory|ph\.d|m\.d|by\s+[A-Z])(?=$|[^\p{L}\p{N}_])"
    r"|(?<![\p{L}\p{N}_])(?:dr\.|prof\.|author:|email:)(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])@[\p{L}\p{N}_.\-]+\.(?:edu|org|ac\.uk|gov|com)(?=$|[^\p{L}\p{N}_]))"
)


@dataclass(frozen=True)
class DetectorConfig:
    """custom_patterns: label -> patterns, in order; confidence: rule name -> value; thresholds of front and back matter."""

    enabled: frozenset[str] = field(default_factory=lambda: frozenset(CATEGORIES))
    custom_patterns: dict[str, list[str]] = field(default_factory=dict)
    confidence: dict[str, float] = field(default_factory=dict)
    front: float = 0.20
    back: float = 0.60

    def conf(self, name: str, default: float) -> Column:
        return F.lit(float(self.confidence.get(name, default)))


def detected(df: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Adds detected_type, detected_confidence, pattern_matched, detect_reason; needs with_text and with_position."""
    t, s, wc, pos, kind, low, idx = (F.col(c) for c in ("t", "style_lc", "wc", "pos", "kind", "low", "idx"))
    para = kind == "paragraph"
    rows = df.withColumns({"__bold": FT.any_run("bold"), "__size": F.coalesce(FT.max_size(), F.lit(11.0))})
    bold, size = F.col("__bold"), F.col("__size")
    up = lambda c, by: F.least(F.lit(1.0), c + by)
    g = lambda p, i: F.regexp_extract(t, p, i)
    null = F.lit(None).cast("string")
    branches: list[tuple[Column, str, Column, Column, str]] = [
        (kind == "table", "table", cfg.conf("table_primitive", 1.0), F.concat(F.col("rows_count").cast("string"), F.lit("x"), F.col("cols_count").cast("string"), F.lit(" table")), "native table grid structure"),
        ((kind == "figure") | para & F.col("contains_drawing") & (t == ""), "figure", cfg.conf("figure_primitive", 1.0), F.when(kind != "figure", "drawing"), "native drawing or inline graphic object"),
        (t == "", "body_paragraph", F.lit(1.0), F.lit(""), "empty paragraph break"),
    ]
    for label, patterns in cfg.custom_patterns.items():
        for p in patterns:
            branches.append((t.rlike(f"(?idu){p}"), label, cfg.conf("custom_pattern", 0.99), F.regexp_extract(t, f"(?idu){p}", 0), f"matched custom user pattern '{p}'"))
    on = cfg.enabled.__contains__
    if on("chapter"):
        c = cfg.conf("chapter_digit", 0.98)
        branches.append(((wc <= 25) & t.rlike(CHAPTER_DIGIT), "chapter_heading", F.when(bold | (size >= 14.0), up(c, 0.01)).otherwise(c), F.concat(F.lit("Chapter "), g(CHAPTER_DIGIT, 1)), "matched chapter regex with numeric digit"))
        c = cfg.conf("chapter_word", 0.98)
        branches.append(((wc <= 25) & t.rlike(CHAPTER_WORD), "chapter_heading", F.when(X.is_upper(t), up(c, 0.01)).otherwise(c), F.concat(F.lit("CHAPTER "), F.upper(g(CHAPTER_WORD, 1))), "matched chapter regex with spelled-out number word"))
        branches.append(((wc <= 25) & t.rlike(CHAPTER_ROMAN), "chapter_heading", cfg.conf("chapter_roman", 0.98), F.concat(F.lit("CHAPTER "), F.upper(g(CHAPTER_ROMAN, 1))), "matched chapter regex with Roman numeral"))
    if on("special_section"):
        branches.append(((wc <= 10) & (pos <= cfg.front) & t.rlike(ABSTRACT), "abstract", F.lit(0.98), t, "matched abstract section heading in front-matter"))
        branches.append(((wc <= 10) & t.rlike(ACKNOWLEDGE), "acknowledgements", F.lit(0.98), t, "matched acknowledgements section heading"))
        branches.append(((wc <= 10) & t.rlike(CONCLUSION), "conclusion", F.lit(0.97), t, "matched conclusion section heading"))
    if on("reference"):
        branches.append(((pos >= cfg.front) & t.rlike(REF_HEADER), "references", F.lit(0.99), t, "matched references/bibliography section header"))
        branches.append(((pos >= cfg.back) & t.rlike(REF_ENTRY), "reference_entry", F.lit(0.97), F.substring(g(REF_ENTRY, 1), 1, 25), "matched academic citation entry in back-matter"))
    if on("figure"):
        branches.append((t.rlike(FIGURE), "figure_caption", F.lit(0.98), F.concat(F.when(low.startswith("fig."), "Fig. ").otherwise("Figure "), g(FIGURE, 1)), "matched figure caption pattern"))
    if on("table"):
        branches.append((t.rlike(TABLE), "table_caption", F.lit(0.98), F.concat(F.lit("Table "), g(TABLE, 1)), "matched table caption pattern"))
    if on("heading"):
        can = (wc <= 20) & ~t.endswith(".")
        for p, label, name, base, why in ((HEADING_3, "heading_3", "heading_l3", 0.96, "matched decimal level-3 subheading regex"), (HEADING_2, "heading_2", "heading_l2", 0.96, "matched decimal level-2 heading regex"), (HEADING_1, "heading_1", "heading_l1", 0.95, "matched numbered level-1 heading regex")):
            c = cfg.conf(name, base)
            branches.append((can & t.rlike(p), label, F.when(bold, up(c, 0.02)).otherwise(c), g(p, 1), why))
    if on("list"):
        branches.append((para & F.col("list_info").isNotNull(), "list_item", F.lit(0.99), F.lit("numPr"), "native OpenXML numbering metadata (numPr)"))
        branches.append((t.rlike(LIST_BULLET), "list_item", F.lit(0.97), g(LIST_BULLET, 1), "matched bullet list marker"))
        branches.append((t.rlike(LIST_NUMBER), "list_item", F.lit(0.96), F.concat(g(LIST_NUMBER, 1), g(LIST_NUMBER, 2), F.lit(".")), "matched sequential numbered list prefix"))
        branches.append((t.rlike(LIST_LETTER), "list_item", F.lit(0.95), F.concat(g(LIST_LETTER, 1), g(LIST_LETTER, 2), F.lit(".")), "matched lettered list prefix"))
    if on("front_matter"):
        front = pos <= cfg.front
        found = g(AFFILIATION, 1)
        branches.append((front & (t.rlike(AFFILIATION) | s.isin("author", "subtitle")), "author", F.lit(0.96), F.when(found != "", found).otherwise("Author"), "matched academic affiliation or author credential in front-matter"))
        branches.append((front & ((s == "title") | (idx == 0) & (wc <= 15) & ~t.endswith(".")), "title", F.when(bold | (size >= 16.0) | (s == "title"), 0.98).otherwise(0.95), F.lit("Title"), "front-matter title heuristic (prominence and position)"))
        branches.append((front & (idx == 1) & (wc <= 15) & ~t.endswith(".") & ~bold, "subtitle", F.lit(0.90), F.lit("Subtitle"), "front-matter block following title"))
    for mark, label in (("heading 1", "heading_1"), ("heading 2", "heading_2"), ("heading 3", "heading_3"), ("caption", "caption")):
        branches.append((s.contains(mark), label, F.lit(0.92), F.col("style"), f"Word style indicates {mark.title()}"))
    branches.append((F.lit(True), "body_paragraph", F.lit(0.88), null, "standard narrative body paragraph"))
    number = F.lit(len(branches))
    for k in range(len(branches) - 1, 0, -1):
        number = F.when(branches[k - 1][0], F.lit(k)).otherwise(number)
    rows = rows.withColumn("__branch", number)
    # a second projection looks labels up by number and builds the captures for the branch that was taken alone
    b = F.col("__branch")
    look = lambda i: F.create_map(*[x for k, v in enumerate(branches, 1) for x in (F.lit(k), F.lit(v[i]))])[b]

    def chosen(i: int, default: Column) -> Column:
        out = None
        for k, v in enumerate(branches, 1):
            out = F.when(b == k, v[i]) if out is None else out.when(b == k, v[i])
        return out.otherwise(default)

    return rows.withColumns({"detected_type": look(1), "detected_confidence": chosen(2, F.lit(0.88)), "pattern_matched": chosen(3, null), "detect_reason": look(4)}).drop("__branch", "__bold", "__size")
