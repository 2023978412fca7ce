"""The 34 linguistic features; their definitions differ from the structural ones and share no columns with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as FT
from . import text as X

_L, _R = r"(?<![\p{L}\p{N}_])", r"(?=$|[^\p{L}\p{N}_])"
# Keyword patterns.
CHAPTER = rf"(?iu){_L}(?:chapter|part|book){_R}|(?iu){_L}ch\.(?=[\p{{L}}\p{{N}}_])"
AUTHOR = rf"(?iu){_L}(?:department|university|faculty|school|institute|laboratory|ph\.d|m\.d){_R}|(?iu){_L}(?:dr\.|prof\.|author:|email:)(?=[\p{{L}}\p{{N}}_])|(?iu)(?<=[\p{{L}}\p{{N}}_])@[\p{{L}}\p{{N}}_.\-]+\.(?=[\p{{L}}\p{{N}}_])"
REFERENCE = rf"(?iu){_L}(?:references?|bibliography|works cited|literature cited){_R}"
ABSTRACT = rf"(?iu){_L}(?:abstract|executive summary){_R}"
ACKNOWLEDGE = rf"(?iu){_L}(?:acknowledgements?|acknowledgments?){_R}"
CONCLUSION = rf"(?iu){_L}(?:conclusions?|concluding remarks){_R}"
MARKER = r"^(?:\p{Nd}+[.)]|[*\-•–—◦▪▫►⁃]|\([0-9a-zA-Z]\))\s+"

NAMES = [
    "text_length", "word_count", "is_all_caps", "starts_with_number", "contains_chapter_keyword", "paragraph_position", "sentence_count", "avg_sentence_length", "avg_word_length", "is_title_case", "uppercase_ratio",
    "ends_with_period", "ends_with_colon", "ends_with_question", "punctuation_count", "punctuation_ratio", "prev_paragraph_word_count", "next_paragraph_word_count", "is_isolated", "contains_author_keyword",
    "contains_reference_keyword", "contains_abstract_keyword", "contains_acknowledgement_keyword", "contains_conclusion_keyword", "stopword_ratio", "lexical_diversity", "original_style", "is_default_style", "font_size_pt",
    "is_bold", "is_italic", "is_larger_than_surroundings", "has_numbering_marker", "contains_roman_numeral",
]
CORE = ["text_length", "word_count", "is_all_caps", "starts_with_number", "contains_chapter_keyword", "paragraph_position"]


def linguistic(df: DataFrame) -> DataFrame:
    """Keys (doc_id, idx), kind and the struct `nlp` of the 34 features."""
    rows = FT.with_position(FT.with_median(FT.with_text(df)))
    t = F.col("t")
    w = FT.window()
    # neighbours' tokens are counted on their unstripped text, which has the same words
    rows = rows.withColumns({"__w": X.words("t"), "__alpha": X.count(t, r"\p{L}"), "__size": FT.max_size(), "__tw": F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0)), "__n": F.size(X.words("t"))})
    rows = rows.withColumns({"__prev": F.lag("__n", 1, 0).over(w), "__next": F.lead("__n", 1, 0).over(w), "__sent": F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.size(X.sentences(t))))})
    n, prev, nxt, sent, length = F.col("__n"), F.col("__prev"), F.col("__next"), F.col("__sent"), F.length(t)
    cap = lambda x: x.rlike("^[A-Z]")
    title = (F.size("__tw") > 1) & F.forall(F.transform("__tw", lambda x, i: cap(x) | (i > 0) & F.lower(x).isin(*X.MINOR_WORDS)), lambda b: b) & F.exists("__tw", cap)
    low_words = F.transform("__w", lambda x: F.lower(x))
    values = {
        "text_length": length.cast("long"),
        "word_count": n.cast("long"),
        "is_all_caps": X.is_upper(t) & (n >= 1),
        "starts_with_number": t.rlike(r"^\p{Nd}+"),
        "contains_chapter_keyword": t.rlike(CHAPTER),
        "paragraph_position": F.col("pos"),
        "sentence_count": sent.cast("long"),
        "avg_sentence_length": X.ratio(n, sent),
        "avg_word_length": X.ratio(F.aggregate(F.transform("__w", lambda x: F.length(x)), F.lit(0), lambda a, x: a + x), n),
        "is_title_case": title,
        "uppercase_ratio": X.ratio(X.count(t, r"\p{Lu}"), F.col("__alpha")),
        "ends_with_period": t.endswith("."),
        "ends_with_colon": t.endswith(":"),
        "ends_with_question": t.endswith("?"),
        "punctuation_count": X.count(t, r"\p{Punct}").cast("long"),
        "punctuation_ratio": X.ratio(X.count(t, r"\p{Punct}"), length),
        "prev_paragraph_word_count": prev.cast("long"),
        "next_paragraph_word_count": nxt.cast("long"),
        "is_isolated": (n < 20) & ((prev > 10) | (nxt > 10)) & ((prev > n * 2) | (nxt > n * 2)),
        "contains_author_keyword": t.rlike(AUTHOR),
        "contains_reference_keyword": t.rlike(REFERENCE),
        "contains_abstract_keyword": t.rlike(ABSTRACT),
        "contains_acknowledgement_keyword": t.rlike(ACKNOWLEDGE),
        "contains_conclusion_keyword": t.rlike(CONCLUSION),
        "stopword_ratio": X.ratio(F.size(F.filter(low_words, lambda x: F.array_contains(X.literal_set(X.STOPWORDS), x))), n),
        "lexical_diversity": X.ratio(F.size(F.array_distinct(low_words)), n),
        "original_style": F.col("style"),
        "is_default_style": F.col("style_lc").isin("normal", "body text", ""),
        "font_size_pt": F.col("__size"),
        "is_bold": FT.any_run("bold"),
        "is_italic": FT.any_run("italic"),
        "is_larger_than_surroundings": F.coalesce((F.col("__size") > 0) & (F.col("__size") >= F.col("median_size") + 1.5), F.lit(False)),
        "has_numbering_marker": t.rlike(MARKER) | F.col("list_info").isNotNull(),
        "contains_roman_numeral": t.rlike(FT.ROMAN),
    }
    return rows.select("doc_id", "idx", "kind", F.struct(*[values[c].alias(c) for c in NAMES]).alias("nlp"))
