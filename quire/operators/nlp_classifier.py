"""Linguistic classifier: ordered conditions over the linguistic features, with the cues that led to each label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classified(df: DataFrame) -> DataFrame:
    """Adds nlp_type, nlp_confidence, nlp_cues to rows with the struct `nlp`."""
    f = lambda c: F.col(f"nlp.{c}")
    pos, wc, stop = f("paragraph_position"), f("word_count"), f("stopword_ratio")
    strong = f("is_bold") | f("is_larger_than_surroundings")
    cased = f("is_title_case") | f("is_all_caps")
    numbered = f("starts_with_number") | f("has_numbering_marker")
    cue = lambda text, when=None: F.lit(text) if when is None else F.when(when, F.lit(text))
    plus = lambda base, by, top, when: F.when(when, F.least(F.lit(top), F.lit(base) + F.lit(by))).otherwise(F.lit(base))
    rules = [
        (f("text_length") == 0, "body_paragraph", F.lit(1.0), [cue("empty_text_block")]),
        ((pos < 0.08) & (wc <= 15) & ~f("ends_with_period") & cased, "title", plus(0.90, 0.06, 0.98, strong), [cue("front_matter_position"), cue("title_capitalization"), cue("typographic_prominence", strong), cue("low_stopword_density", stop < 0.30)]),
        ((pos < 0.15) & f("contains_author_keyword"), "author", F.lit(0.95), [cue("contains_affiliation_lexicon"), cue("front_matter_position")]),
        ((pos < 0.20) & f("contains_abstract_keyword") & (wc <= 8), "abstract", F.lit(0.97), [cue("abstract_keyword_in_front_matter"), cue("concise_heading_length")]),
        (f("contains_reference_keyword") & (pos > 0.40) & (wc <= 5), "references", F.lit(0.98), [cue("reference_keyword_in_back_matter"), cue("concise_heading_length")]),
        ((pos > 0.50) & (wc >= 6) & numbered & (f("lexical_diversity") > 0.70), "reference_entry", F.lit(0.94), [cue("high_lexical_diversity_citation"), cue("back_matter_numbered_item")]),
        (f("contains_chapter_keyword") & (wc <= 20), "chapter_heading", plus(0.95, 0.03, 0.99, f("is_bold") | f("is_all_caps")), [cue("contains_chapter_keyword"), cue("prominent_styling", f("is_bold") | f("is_all_caps"))]),
        ((wc <= 12) & ~f("ends_with_period") & ~f("ends_with_question") & (cased | strong) & f("is_isolated"), "heading", plus(0.88, 0.05, 0.96, strong), [cue("short_isolated_block"), cue("unpunctuated_terminal"), cue("bold_or_large_font", strong), cue("low_stopword_ratio", stop < 0.25), cue("numbered_section_prefix", f("starts_with_number"))]),
        (f("has_numbering_marker") & (wc < 60), "list_item", F.lit(0.96), [cue("numbering_or_bullet_marker")]),
        (f("contains_conclusion_keyword") & (wc <= 6), "conclusion", F.lit(0.95), [cue("conclusion_keyword"), cue("concise_heading")]),
        (F.lit(True), "body_paragraph", F.lit(0.90), [cue("standard_narrative_characteristics"), cue("terminal_period_punctuation", f("ends_with_period")), cue("high_natural_stopword_frequency", stop >= 0.35), F.when(f("sentence_count") >= 1, F.format_string("multi_sentence_flow(%d_sentences)", f("sentence_count")))]),
    ]
    number = F.lit(len(rules))
    for k in range(len(rules) - 1, 0, -1):
        number = F.when(rules[k - 1][0], F.lit(k)).otherwise(number)
    rows = df.withColumn("__rule", number)

    def pick(make):
        out = None
        for k, r in enumerate(rules, 1):
            out = F.when(F.col("__rule") == k, make(r)) if out is None else out.when(F.col("__rule") == k, make(r))
        return out

    return rows.withColumns({"nlp_type": pick(lambda r: F.lit(r[1])), "nlp_confidence": pick(lambda r: r[2]), "nlp_cues": pick(lambda r: F.array_compact(F.array(*r[3])))}).drop("__rule")
