"""DuckDB equivalents of the element views and operators, as one chain of common table expressions."""

from __future__ import annotations

from ..functions.features import BULLET, CITATION, ROMAN
from ..functions.text import MINOR_WORDS, STOPWORDS
from ..operators.detector import NUMBER_WORDS
from ..operators.detector import ROMAN as NUMERAL
from ..operators.smoother import CAPTION_PREFIXES, CUE_PREFIXES, CUES
from ..sources.tables import OVERLAY, RUN_SPLIT

W, NW, L, R = r"\p{L}\p{N}_", r"[^\p{L}\p{N}_]", r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def m(pattern: str, x: str = "t") -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def count(pattern: str, x: str = "t") -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def starts(prefixes, x: str = "low") -> str:
    return "(" + " or ".join(f"starts_with({x}, {q(p)})" for p in prefixes) + ")"


def has(values, x: str = "low") -> str:
    return "(" + " or ".join(f"contains({x}, {q(v)})" for v in values) + ")"


_LINES = "select doc_id, cast(i - 1 as int) as idx, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)"
_overlay = ", ".join(f"{v} as {k}" for k, v in OVERLAY.items())

_TITLE_TAIL = rf"[.:]?\s+([A-Z][{W}\s,–—\-?]+)$"
_HEAD = r"(?i)^(?:chapter|ch\.|part|book|section)\s+"
D1, D2, D3 = (_HEAD + x + r"[:\s\-—]*(.*)$" for x in (r"(\d+)", f"({NUMBER_WORDS})", f"({NUMERAL})"))
H1, H2, H3 = (x + _TITLE_TAIL for x in (r"^(\d+)", r"^(\d+\.\d+)", r"^(\d+\.\d+\.\d+(?:\.\d+)*)"))
FIG, TAB = (rf"(?i)^(?:{x})\s+(\d+(?:\.\d+)?)[:\s\-—.]*(.*)$" for x in (r"figure|fig\.|fig", r"table|tbl\.|tbl"))
REF_HEADER = r"(?i)^(?:references|bibliography|works cited|literature cited)\s*$"
REF_ENTRY = rf"^((?:\[\d+\]|\d+[.)])\s+[A-Z][a-zA-Z\s\-.]+,?\s+(?:.*?{NW})?(?:18|19|20)\d{{2}})" + R
L_NUM, L_LET, L_BUL = r"^(?:(\d+)[.)]|\((\d+)\))\s+(.*)$", r"^(?:([a-zA-Z])[.)]|\(([a-zA-Z])\))\s+(.*)$", r"^([*\-•–—◦▪▫►⁃])\s+(.*)$"
ABS, ACK, CON = (rf"(?i)^(?:{x})\s*[:\-—]*\s*(.*)$" for x in ("abstract|executive summary", "acknowledgements?|acknowledgments?", "conclusion|conclusions|concluding remarks|summary and conclusions"))
AFF = rf"(?i){L}(department of|university of|university|faculty of|school of|institute of|laboratory|ph\.d|m\.d|by\s+[A-Z]){R}"
AFF2 = rf"(?i){L}(dr\.|prof\.|author:|email:)[{W}]"
AFF3 = rf"(?i)[{W}](@[{W}.\-]+\.(?:edu|org|ac\.uk|gov|com)){R}"
NUMBERED = rf"^(\d+(\.\d+)*)\.?\s+([A-Z][{W}\s,–—\-?]+)$"
NUMBERED_SUB = rf"^(\d+\.\d+\.\d+(\.\d+)*)\.?\s+([A-Z][{W}\s,–—\-?]+)$"
R_AFF = rf"(?i){L}(department of|university|faculty of|institute of|laboratory|ph\.d|m\.d){R}|{L}(dr\.|prof\.|email:)[{W}]|[{W}]@[{W}.\-]+\.(edu|org|ac\.uk|gov|com){R}"
KW = {
    "chapter": rf"(?i){L}(?:chapter|part|book){R}|{L}ch\.[{W}]",
    "author": rf"(?i){L}(?:department|university|faculty|school|institute|laboratory|ph\.d|m\.d){R}|{L}(?:dr\.|prof\.|author:|email:)[{W}]|[{W}]@[{W}.\-]+\.[{W}]",
    "reference": rf"(?i){L}(?:references?|bibliography|works cited|literature cited){R}",
    "abstract": rf"(?i){L}(?:abstract|executive summary){R}",
    "acknowledgement": rf"(?i){L}(?:acknowledgements?|acknowledgments?){R}",
    "conclusion": rf"(?i){L}(?:conclusions?|concluding remarks){R}",
}
_UP, _ALPHA = count(r"\p{Lu}"), count(r"\p{L}")
_ISUP = f"({m(r'\p{Lu}')} and not {m(r'[\p{Ll}\p{Lt}]')})"
_ISTITLE = f"({m(r'[\p{Lu}\p{Ll}\p{Lt}]')} and not {m(r'[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]')} and not {m(r'(?:^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}')})"
_bold, _italic = "coalesce(list_bool_or(list_transform(runs, lambda r: coalesce(r.bold, false))), false)", "coalesce(list_bool_or(list_transform(runs, lambda r: coalesce(r.italic, false))), false)"
_max = "list_max(list_transform(runs, lambda r: r.size))"


def ratio(a: str, b: str) -> str:
    return f"case when {b} > 0 then ({a}) / ({b}) else 0.0::double end"


def d(x: float) -> str:
    return f"{x!r}::double"


# rule numbers and outcomes
_rule = f"""case when kind = 'table' then 1 when kind = 'figure' or (kind = 'paragraph' and contains_drawing and t = '') then 2
  when kind = 'paragraph' and listed then 3 when contains(sl, 'bullet') or contains(sl, 'list') then 4
  when {m(r'(?i)^(figure|fig\.|table|tbl\.|plate|chart|graph|illustration)\s+\d+[.:\s\-—]+')} or contains(sl, 'caption') then 5
  when {m(r'(?i)^(chapter|ch\.|part|book|section)\s+([0-9ivxlcdm]+|[a-z]+)(?:$|' + NW + r'[:\s\-—]*.*$)')} then 6
  when pos < 0.25 and {m(r'(?i)^(prologue|epilogue|preface|foreword|acknowledgments?|abstract|introduction)\s*$')} then 7
  when pos > 0.50 and {m(REF_HEADER)} then 8
  when pos > 0.50 and ({m(REF_ENTRY)} or {m(r'^\[\d+\]\s+[A-Z]')} or {m(r'^[A-Z][a-zA-Z\s\-]+,\s+[A-Z]\.\s*(?:.*?' + NW + r')?(19|20)\d{2}' + R)}) then 9
  when wc < 20 and not ends_with(t, '.') and {m(NUMBERED_SUB)} then 10 when wc < 15 and not ends_with(t, '.') and {m(NUMBERED)} then 11
  when wc < 80 and ({m(BULLET)} or {m(r'^(\d+[.)]|\([0-9]+\)|[a-zA-Z][.)]|\([a-zA-Z]\))\s+')}) then 12
  when pos >= 0.10 and wc <= 6 and not {m(r'[.:?!]$')} and {m(rf"^[A-Z][{W}'-]*(?:\s+[A-Za-z][{W}'-]*){{1,5}}$")} then 13
  when pos < 0.10 and (sl = 'title' or (pos = 0 and wc <= 15 and not ends_with(t, '.'))) then 14
  when pos < 0.10 and ({m(R_AFF)} or sl in ('author', 'subtitle')) then 15 else 0 end"""
_names = "['rule_table_element','rule_figure_element','rule_native_list_metadata','rule_list_style','rule_caption_pattern','rule_chapter_prefix','rule_front_matter_chapter','rule_references_header','rule_reference_entry_pattern','rule_numbered_subheading','rule_numbered_heading','rule_list_regex_marker','rule_short_title_heading','rule_front_matter_title','rule_author_affiliation']"
_types = "['table','figure','list','list','caption','chapter','chapter','heading','reference','subheading','heading','list','heading','title','author']"
_confs = "[1.0::double,1.0,0.99,0.97,0.98,0.99,0.95,0.98,0.97,0.97,0.96,0.96,0.93,0.95,0.96]"


def detector(custom: str = "", on: set | None = None, chapter_digit: str = "0.98") -> str:
    """The detector as one CASE over (type, confidence, pattern) structs; custom: branches put first."""
    on = on if on is not None else {"chapter", "heading", "figure", "table", "reference", "list", "front_matter", "special_section"}
    b: list[tuple[str, str, str, str]] = []

    def add(cond, label, conf, pattern):
        b.append((cond, label, conf, pattern))

    add("kind = 'table'", "table", "1.0", "rows_count || 'x' || cols_count || ' table'")
    add("kind = 'figure' or (kind = 'paragraph' and contains_drawing and t = '')", "figure", "1.0", "case when kind <> 'figure' then 'drawing' end")
    add("t = ''", "body_paragraph", "1.0", "''")
    if custom:
        add(m("(?i)" + custom), "custom_module", "0.99", f"regexp_extract(t, {q('(?i)' + custom)}, 0)")
    x = lambda p, g: f"regexp_extract(t, {q(p)}, {g})"
    up = lambda c, by: f"least(1.0::double, {c}::double + {by}::double)"
    if "chapter" in on:
        add(f"wc <= 25 and {m(D1)}", "chapter_heading", f"case when bold_any or coalesce(max_size, 11.0) >= 14.0 then {up(chapter_digit, 0.01)} else {chapter_digit}::double end", f"'Chapter ' || {x(D1, 1)}")
        add(f"wc <= 25 and {m(D2)}", "chapter_heading", f"case when {_ISUP} then {up(0.98, 0.01)} else 0.98::double end", f"'CHAPTER ' || upper({x(D2, 1)})")
        add(f"wc <= 25 and {m(D3)}", "chapter_heading", "0.98", f"'CHAPTER ' || upper({x(D3, 1)})")
    if "special_section" in on:
        add(f"wc <= 10 and pos <= 0.20 and {m(ABS)}", "abstract", "0.98", "t")
        add(f"wc <= 10 and {m(ACK)}", "acknowledgements", "0.98", "t")
        add(f"wc <= 10 and {m(CON)}", "conclusion", "0.97", "t")
    if "reference" in on:
        add(f"pos >= 0.20 and {m(REF_HEADER)}", "references", "0.99", "t")
        add(f"pos >= 0.60 and {m(REF_ENTRY)}", "reference_entry", "0.97", f"substring({x(REF_ENTRY, 1)}, 1, 25)")
    if "figure" in on:
        add(m(FIG), "figure_caption", "0.98", f"case when starts_with(low, 'fig.') then 'Fig. ' else 'Figure ' end || {x(FIG, 1)}")
    if "table" in on:
        add(m(TAB), "table_caption", "0.98", f"'Table ' || {x(TAB, 1)}")
    if "heading" in on:
        for p, label, c in ((H3, "heading_3", 0.96), (H2, "heading_2", 0.96), (H1, "heading_1", 0.95)):
            add(f"wc <= 20 and not ends_with(t, '.') and {m(p)}", label, f"case when bold_any then {up(c, 0.02)} else {c}::double end", x(p, 1))
    if "list" in on:
        add("kind = 'paragraph' and listed", "list_item", "0.99", "'numPr'")
        add(m(L_BUL), "list_item", "0.97", x(L_BUL, 1))
        add(m(L_NUM), "list_item", "0.96", f"{x(L_NUM, 1)} || {x(L_NUM, 2)} || '.'")
        add(m(L_LET), "list_item", "0.95", f"{x(L_LET, 1)} || {x(L_LET, 2)} || '.'")
    if "front_matter" in on:
        aff = f"({m(AFF)} or {m(AFF2)} or {m(AFF3)})"
        add(f"pos <= 0.20 and ({aff} or sl in ('author', 'subtitle'))", "author", "0.96", f"case when {m(AFF)} then {x(AFF, 1)} when {m(AFF2)} then {x(AFF2, 1)} when {m(AFF3)} then {x(AFF3, 1)} else 'Author' end")
        add("pos <= 0.20 and (sl = 'title' or (idx = 0 and wc <= 15 and not ends_with(t, '.')))", "title", "case when bold_any or coalesce(max_size, 11.0) >= 16.0 or sl = 'title' then 0.98::double else 0.95::double end", "'Title'")
        add("pos <= 0.20 and idx = 1 and wc <= 15 and not ends_with(t, '.') and not bold_any", "subtitle", "0.90", "'Subtitle'")
    for mark, label in (("heading 1", "heading_1"), ("heading 2", "heading_2"), ("heading 3", "heading_3"), ("caption", "caption")):
        add(f"contains(sl, '{mark}')", label, "0.92", "style")
    add("true", "body_paragraph", "0.88", "null::varchar")
    one = lambda i: "case " + " ".join(f"when {c[0]} then {('(' + c[i] + ')::double') if i == 2 else q(c[i]) if i == 1 else c[i]}" for c in b) + " end"
    return f"select doc_id, idx, {one(1)} as detected_type, {one(2)} as detected_confidence, {one(3)} as pattern_matched from p"


_feature_sql = {
    "char_length": "cast(length(t) as bigint)",
    "word_count": "cast(wc as bigint)",
    "avg_word_length": "length(t) / greatest(1, wc)",
    "uppercase_ratio": f"{_UP} / greatest(1, {_ALPHA})",
    "is_all_caps": f"{_ISUP} and length(t) > 3",
    "is_title_case": f"{_ISTITLE} and wc > 1",
    "digit_ratio": f"{count(r'[\p{Nd}²³¹⁰-⁹₀-₉]')} / greatest(1, length(t))",
    "ends_with_period": "ends_with(t, '.')",
    "ends_with_colon": "ends_with(t, ':')",
    "ends_with_question": "ends_with(t, '?')",
    "stopword_ratio": ratio(f"len(list_filter(lw, lambda x: list_contains({words(STOPWORDS)}, x)))", "len(lw)"),
    "sentence_count": f"cast({count(r'[.!?]+(?:\s+|$)')} as bigint)",
    "starts_with_number": m(r"^\d+"),
    "contains_roman_numeral": m(ROMAN),
    "citation_marker_count": f"cast({count(CITATION)} as bigint)",
    "year_mention_count": f"cast({count(r'\b(18|19|20)\d{2}\b')} as bigint)",
    "relative_doc_position": "pos",
    "is_front_matter": "pos < 0.10",
    "is_back_matter": "pos > 0.80",
    "prev_elem_word_count": "cast(prev_wc as bigint)",
    "next_elem_word_count": "cast(next_wc as bigint)",
    "distance_from_doc_start": "cast(idx as bigint)",
    "distance_to_doc_end": "cast(n - 1 - idx as bigint)",
    "is_isolated": "wc < 20 and (prev_wc > 25 or next_wc > 25)",
    "is_bold": "bold_any",
    "is_italic": _italic,
    "all_runs_bold": "len(list_filter(runs, lambda r: trim(r.text) <> '')) > 0 and coalesce(list_bool_and(list_transform(list_filter(runs, lambda r: trim(r.text) <> ''), lambda r: coalesce(r.bold, false))), false)",
    "font_size_pt": "coalesce(max_size, 0.0::double)",
    "relative_font_size": "case when max_size > 0 then max_size - median_size else 0.0::double end",
    "has_drawing": "kind = 'figure' or (kind = 'paragraph' and contains_drawing)",
    "is_table": "kind = 'table'",
    "is_list_marker": f"(kind = 'paragraph' and listed) or {m(BULLET)}",
}
_tw = "regexp_extract_all(t, '[A-Za-z][A-Za-z''-]*')"
_nlp_sql = {
    "text_length": "cast(length(t) as bigint)",
    "word_count": "cast(nw as bigint)",
    "is_all_caps": f"{_ISUP} and nw >= 1",
    "starts_with_number": m(r"^\d+"),
    "contains_chapter_keyword": m(KW["chapter"]),
    "paragraph_position": "pos",
    "sentence_count": f"cast(case when t = '' then 0 else 1 + {count(r'[.!?]\s+')} end as bigint)",
    "avg_sentence_length": ratio("nw", f"case when t = '' then 0 else 1 + {count(r'[.!?]\s+')} end"),
    "avg_word_length": ratio("coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0)", "nw"),
    "is_title_case": f"len({_tw}) > 1 and coalesce(list_bool_and(list_transform({_tw}, lambda x, i: regexp_matches(x, '^[A-Z]') or (i > 1 and list_contains({words(MINOR_WORDS)}, lower(x))))), false) and coalesce(list_bool_or(list_transform({_tw}, lambda x: regexp_matches(x, '^[A-Z]'))), false)",
    "uppercase_ratio": ratio(_UP, _ALPHA),
    "ends_with_period": "ends_with(t, '.')",
    "ends_with_colon": "ends_with(t, ':')",
    "ends_with_question": "ends_with(t, '?')",
    "punctuation_count": f"cast({count('[[:punct:]]')} as bigint)",
    "punctuation_ratio": ratio(count("[[:punct:]]"), "length(t)"),
    "prev_paragraph_word_count": "cast(prev_nw as bigint)",
    "next_paragraph_word_count": "cast(next_nw as bigint)",
    "is_isolated": "nw < 20 and (prev_nw > 10 or next_nw > 10) and (prev_nw > nw * 2 or next_nw > nw * 2)",
    "contains_author_keyword": m(KW["author"]),
    "contains_reference_keyword": m(KW["reference"]),
    "contains_abstract_keyword": m(KW["abstract"]),
    "contains_acknowledgement_keyword": m(KW["acknowledgement"]),
    "contains_conclusion_keyword": m(KW["conclusion"]),
    "stopword_ratio": ratio(f"len(list_filter(lw, lambda x: list_contains({words(STOPWORDS)}, x)))", "nw"),
    "lexical_diversity": ratio("len(list_distinct(lw))", "nw"),
    "original_style": "style",
    "is_default_style": "sl in ('normal', 'body text', '')",
    "font_size_pt": "max_size",
    "is_bold": "bold_any",
    "is_italic": _italic,
    "is_larger_than_surroundings": "coalesce(max_size > 0 and max_size >= median_size + 1.5, false)",
    "has_numbering_marker": m(r"^(?:\d+[.)]|[*\-•–—◦▪▫►⁃]|\([0-9a-zA-Z]\))\s+") + " or listed",
    "contains_roman_numeral": m(ROMAN),
}
_strong, _cased = "(is_bold or is_larger_than_surroundings)", "(is_title_case or is_all_caps)"
_nlp_rules = [
    ("text_length = 0", "body_paragraph", "1.0::double", ["'empty_text_block'"]),
    (f"paragraph_position < 0.08 and word_count <= 15 and not ends_with_period and {_cased}", "title", f"case when {_strong} then least(0.98::double, 0.90::double + 0.06::double) else 0.90::double end", ["'front_matter_position'", "'title_capitalization'", f"case when {_strong} then 'typographic_prominence' end", "case when stopword_ratio < 0.30 then 'low_stopword_density' end"]),
    ("paragraph_position < 0.15 and contains_author_keyword", "author", "0.95::double", ["'contains_affiliation_lexicon'", "'front_matter_position'"]),
    ("paragraph_position < 0.20 and contains_abstract_keyword and word_count <= 8", "abstract", "0.97::double", ["'abstract_keyword_in_front_matter'", "'concise_heading_length'"]),
    ("contains_reference_keyword and paragraph_position > 0.40 and word_count <= 5", "references", "0.98::double", ["'reference_keyword_in_back_matter'", "'concise_heading_length'"]),
    ("paragraph_position > 0.50 and word_count >= 6 and (starts_with_number or has_numbering_marker) and lexical_diversity > 0.70", "reference_entry", "0.94::double", ["'high_lexical_diversity_citation'", "'back_matter_numbered_item'"]),
    ("contains_chapter_keyword and word_count <= 20", "chapter_heading", "case when is_bold or is_all_caps then least(0.99::double, 0.95::double + 0.03::double) else 0.95::double end", ["'contains_chapter_keyword'", "case when is_bold or is_all_caps then 'prominent_styling' end"]),
    (f"word_count <= 12 and not ends_with_period and not ends_with_question and ({_cased} or {_strong}) and is_isolated", "heading", f"case when {_strong} then least(0.96::double, 0.88::double + 0.05::double) else 0.88::double end", ["'short_isolated_block'", "'unpunctuated_terminal'", f"case when {_strong} then 'bold_or_large_font' end", "case when stopword_ratio < 0.25 then 'low_stopword_ratio' end", "case when starts_with_number then 'numbered_section_prefix' end"]),
    ("has_numbering_marker and word_count < 60", "list_item", "0.96::double", ["'numbering_or_bullet_marker'"]),
    ("contains_conclusion_keyword and word_count <= 6", "conclusion", "0.95::double", ["'conclusion_keyword'", "'concise_heading'"]),
    ("true", "body_paragraph", "0.90::double", ["'standard_narrative_characteristics'", "case when ends_with_period then 'terminal_period_punctuation' end", "case when stopword_ratio >= 0.35 then 'high_natural_stopword_frequency' end", "case when sentence_count >= 1 then 'multi_sentence_flow(' || sentence_count || '_sentences)' end"]),
]
_nlp_case = lambda f: "case " + " ".join(f"when {r[0]} then {f(r)}" for r in _nlp_rules) + " end"

_cue = f"(t <> '' and ({starts(CUE_PREFIXES)} or (wc < 35 and {has(CUES)})) and label <> 'caption' and not starts_with(low, 'chapter'))"
_bare = "(label = 'figure' and t <> '' and not contains_drawing and kind <> 'figure')"
_w, _run, _before = "partition by doc_id order by idx", "partition by doc_id order by idx rows between unbounded preceding and current row", "partition by doc_id order by idx rows between unbounded preceding and 1 preceding"
_smooth = [
    ("refs and pos > 0.60 and label = 'paragraph' and (starts_with(t, '[') or contains(t, '19') or contains(t, '20'))", "reference", "0.92", "smoothed_back_matter_paragraph_promoted_to_reference"),
    ("label = 'subheading' and not seen", "heading", "0.88", "smoothed_initial_subheading_promoted_to_heading"),
    ("after_anchor and cue", "caption", "0.95", "smoothed_post_figure_table_promoted_to_caption"),
    ("bare", "paragraph", "0.85", "smoothed_text_element_demoted_from_figure"),
    (f"label = 'caption' and not {starts(CAPTION_PREFIXES)} and not after_anchor", "paragraph", "0.90", "smoothed_unanchored_caption_demoted_to_paragraph"),
    ("label = 'author' and pos >= 0.15", "paragraph", "0.85", "smoothed_author_in_body_demoted_to_paragraph"),
    ("label = 'title' and pos >= 0.15 and wc < 15", "heading", "0.85", "smoothed_title_in_body_demoted_to_heading"),
    ("label = 'title' and pos >= 0.15", "paragraph", "0.90", "smoothed_title_in_body_demoted_to_paragraph"),
]
_smooth_case = lambda i, other: "case " + " ".join(f"when {c[0]} then {q(c[i]) if i != 2 else c[i] + '::double'}" for c in _smooth) + f" else {other} end"

CTES: dict[str, str] = {
    "lines": _LINES,
    "o": f"select doc_id, idx, {_overlay} from lines",
    "man": f"select doc_id, idx, kind, text, style, listed, contains_drawing, rows_count, cols_count, case when kind = 'paragraph' and text <> '' then [{{'text': substring(text, 1, {RUN_SPLIT}), 'bold': bold, 'italic': italic, 'size': cast(size as double)}}, {{'text': substring(text, {RUN_SPLIT + 1}), 'bold': case when doc_id % 2 = 1 then null else bold end, 'italic': null::boolean, 'size': cast(size as double) - 1}}] else [] end as runs from o",
    "t0": f"select *, trim(text) as t, lower(trim(text)) as low, lower(coalesce(style, '')) as sl, regexp_extract_all(lower(trim(text)), '[{W}]+') as lw, {_bold} as bold_any, {_max} as max_size from man",
    "t1": r"select *, case when t = '' then 0 else len(regexp_split_to_array(t, '\s+')) end as wc, len(lw) as nw from t0",
    "med": "select doc_id as m_doc, median(s) as md from (select doc_id, unnest(list_transform(runs, lambda r: r.size)) as s from man) where s > 0 group by doc_id",
    "p": f"select t1.*, coalesce(md, 11.0::double) as median_size, count(*) over (partition by doc_id) as n, case when count(*) over (partition by doc_id) > 1 then idx / (count(*) over (partition by doc_id) - 1) else 0.0::double end as pos, lag(wc, 1, 0) over ({_w}) as prev_wc, lead(wc, 1, 0) over ({_w}) as next_wc, lag(nw, 1, 0) over ({_w}) as prev_nw, lead(nw, 1, 0) over ({_w}) as next_nw from t1 left join med on t1.doc_id = med.m_doc",
    "f": "select doc_id, idx, " + ", ".join(f"{v} as {k}" for k, v in _feature_sql.items()) + " from p",
    "nlp": "select doc_id, idx, " + ", ".join(f"{v} as {k}" for k, v in _nlp_sql.items()) + " from p",
    "nlpc": f"select doc_id, idx, {_nlp_case(lambda r: q(r[1]))} as nlp_type, {_nlp_case(lambda r: r[2])} as nlp_confidence, {_nlp_case(lambda r: 'list_filter([' + ', '.join(r[3]) + '], lambda x: x is not null)')} as nlp_cues from nlp",
    "r0": f"select *, {_rule} as rule_id from p",
    "r": f"select *, {_names}[rule_id] as rule_name, case when rule_id = 11 and contains(regexp_extract(t, {q(NUMBERED)}, 1), '.') then 'subheading' else {_types}[rule_id] end as rule_type, {_confs}[rule_id] as rule_confidence, t = '' and kind not in ('table', 'figure') and not contains_drawing as blank from r0",
    "a": "select *, case when blank then 'paragraph' else coalesce(rule_type, 'paragraph') end as label, case when blank then 1.0::double else coalesce(rule_confidence, 0.5::double) end as conf, case when blank or rule_id > 0 then 'rule' else 'ml' end as tier, case when blank then 'rule_empty_paragraph' else rule_name end as matched_rule from r",
    "s0": f"select *, label = 'table' or (label = 'figure' and not {_bare}) as base, {_cue} as cue, {_bare} as bare, coalesce(bool_or(label in ('chapter', 'heading', 'subheading')) over ({_before}), false) as seen, bool_or(label = 'heading' and (contains(low, 'reference') or contains(low, 'bibliography')) and pos > 0.50) over ({_run}) as refs from a",
    "s1": "select *, idx > 0 and base and cue as link from s0",
    "s2": f"select *, max(case when not link then idx end) over ({_run}) as brk, last_value(case when not link then base end ignore nulls) over ({_run}) as base_brk from s1",
    "s3": "select *, case when (idx - brk) % 2 = 0 then base_brk else not base_brk end as anchor from s2",
    "s4": f"select *, coalesce(lag(anchor) over ({_w}), false) as after_anchor from s3",
    "s": f"select *, {_smooth_case(1, 'label')} as final_label, {_smooth_case(2, 'conf')} as final_conf, {_smooth_case(3, q('initial_prediction'))} as smooth_reason from s4",
    "det": detector(),
    "tok": r"select doc_id, idx, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x0B\f]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as token from man",
    # DuckDB keeps a sharp s in capitals, where Unicode's full mapping has SS
    "out": "select doc_id, idx, case when idx % 10 = 0 then upper(replace(token, 'ß', 'SS')) else token end as token from (select *, max(idx) over (partition by doc_id) as last from tok) where not (doc_id % 3 = 0 and idx = last) union all select doc_id, max(idx) + 1, 'added' from tok where doc_id % 7 = 1 group by doc_id",
}


def sql(body: str, **changed: str) -> str:
    """`body` with the whole chain before it, some of its tables changed; what it doesn't use is not run."""
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in (CTES | changed).items()) + "\n" + body


FEATURE_COLUMNS, NLP_COLUMNS = list(_feature_sql), list(_nlp_sql)
