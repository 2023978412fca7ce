"""The registered queries of the library's operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import features as FT
from ..functions import linguistic as LG
from ..functions import text as X
from ..operators import detector, formatter, hybrid, jobs, models, nlp_classifier, preservation, report, rules, smoother
from ..schema import LABELS
from ..sources import tables
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, chain: bool = True):
    """Registers a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = oracle.sql(sql) if chain else sql
        return fn

    return add


def _man(spark, sf_dir):
    return tables.manuscript(spark, sf_dir)


def _placed(spark, sf_dir):
    return FT.with_position(FT.with_text(_man(spark, sf_dir)))


def _ruled(spark, sf_dir):
    return rules.arbitrated(rules.with_rules(_placed(spark, sf_dir)))


def _smooth(spark, sf_dir):
    return smoother.smoothed(_ruled(spark, sf_dir))


# sources


@query("select doc_id, idx, line from lines")
def doc_elements(spark, sf_dir):
    return tables.doc_elements(spark, sf_dir)


@query("select doc_id, idx, kind, text, style, listed, contains_drawing, cast(rows_count as int) as rows_count, cast(cols_count as int) as cols_count, list_transform(runs, lambda r: r.text) as run_texts from man")
def manuscript_elements(spark, sf_dir):
    return _man(spark, sf_dir).select("doc_id", "idx", "kind", "text", "style", F.col("list_info").isNotNull().alias("listed"), "contains_drawing", "rows_count", "cols_count", F.transform("runs", lambda r: r["text"]).alias("run_texts"))


@query(
    r"""
with h as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') as x from pages),
s as (select page_id, string_split(regexp_replace(x, '(?i)<(title|h1|p|li|footer)(\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) as ps from h),
u as (select page_id, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as idx from s),
v as (select *, lower(split_part(piece, chr(2), 1)) as tag from u where idx > 0)
select page_id, cast(idx as int) as idx, tag, case tag when 'title' then 'Title' when 'h1' then 'Heading 1' when 'li' then 'List Bullet' else 'Normal' end as style,
  trim(regexp_replace(regexp_replace(substring(piece, length(tag) + 2), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as text, contains(piece, '<b>') as bold from v""",
    chain=False,
)
def page_elements(spark, sf_dir):
    return tables.page_elements(spark, sf_dir)


@query(
    "select l_orderkey as o_orderkey, count(*) as rows_count, cast(3 as bigint) as cols_count, string_agg(l_linenumber || chr(9) || l_partkey || chr(9) || trim(l_returnflag), chr(10) order by l_linenumber, l_partkey, l_returnflag) as text from lineitem group by 1",
    chain=False,
)
def table_rows_text(spark, sf_dir):
    return tables.order_tables(spark, sf_dir)


@query("select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as prev_role, lead(role) over (partition by conv_id order by turn) as next_role, cast(length(text) as bigint) as chars from conversations", chain=False)
def conv_sequence(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    return tables.conv_elements(spark, sf_dir).select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"), F.lead("role").over(w).alias("next_role"), F.length("text").cast("long").alias("chars"))


@query("select doc_id, idx, cast(i - 1 as int) as run_no, r.text as run_text, r.bold as bold, r.italic as italic, r.size as font_size_pt from (select doc_id, idx, unnest(runs) as r, generate_subscripts(runs, 1) as i from man)")
def run_metadata_extract(spark, sf_dir):
    return _man(spark, sf_dir).select("doc_id", "idx", F.posexplode("runs").alias("run_no", "r")).select("doc_id", "idx", "run_no", F.col("r.text").alias("run_text"), "r.bold", "r.italic", "r.font_size_pt")


@query(
    """select doc_id, idx, case when listed then 1 end as num_id, case when listed or contains(sl, 'bullet') or contains(sl, 'number') or contains(sl, 'list') then 0 end as ilvl,
  case when listed then false when contains(sl, 'bullet') then true when contains(sl, 'number') or contains(sl, 'list') then false end as is_bullet,
  case when listed then true when contains(sl, 'bullet') then false when contains(sl, 'number') or contains(sl, 'list') then true end as is_numbered
from t0"""
)
def list_info_extract(spark, sf_dir):
    rows = _man(spark, sf_dir).withColumn("li", tables.list_info(F.col("list_info.num_id"), F.lit(None).cast("int"), F.col("style")))
    return rows.select("doc_id", "idx", "li.num_id", "li.ilvl", "li.is_bullet", "li.is_numbered")


@query(
    """select doc_id, idx, case when kind = 'table' then 'table' when kind = 'figure' then 'figure' when listed then 'list' when sl = 'title' then 'title' when sl in ('subtitle', 'author') then 'author'
  when contains(sl, 'heading') then 'heading' when contains(sl, 'caption') then 'caption' when contains(sl, 'reference') or contains(sl, 'bibliography') then 'reference'
  when contains(sl, 'list') or contains(sl, 'bullet') then 'list' else 'paragraph' end as initial_type from t0"""
)
def initial_style_type(spark, sf_dir):
    return _man(spark, sf_dir).select("doc_id", "idx", tables.initial_type().alias("initial_type"))


@query()
def file_fingerprint(spark, sf_dir):
    """The documents table's own files; SQL has no file digests."""
    return jobs.fingerprints(spark, f"{sf_dir}/documents.parquet").select(F.substring_index("path", "/", -1).alias("name"), "size", "sha256")


@query("select doc_id, idx, 'elem_' || printf('%05d', idx) || '_' || substring(sha256(doc_id || ':' || idx || ':' || text), 1, 8) as element_id from man")
def element_ids(spark, sf_dir):
    return _man(spark, sf_dir).select("doc_id", "idx", F.format_string("elem_%05d_%s", "idx", F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string"), "text"), 256), 1, 8)).alias("element_id"))


# projections and lookups


@query("select doc_id, idx, text from man where doc_id = 5 and idx = 2")
def element_by_id(spark, sf_dir):
    return _man(spark, sf_dir).filter("doc_id = 5 and idx = 2").select("doc_id", "idx", "text")


@query("select doc_id, idx, text from man where kind = 'table'")
def elements_by_type(spark, sf_dir):
    return _man(spark, sf_dir).filter("kind = 'table'").select("doc_id", "idx", "text")


@query("select doc_id, string_agg(text, chr(30) order by idx) as sequence from man group by doc_id")
def text_sequence(spark, sf_dir):
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\x1e")
    return _man(spark, sf_dir).groupBy("doc_id").agg(seq.alias("sequence"))


# structural features


def _features(names: list[str]):
    def run(spark, sf_dir):
        return FT.all_features(_man(spark, sf_dir)).select("doc_id", "idx", *names)

    return run


for _name, _cols in {
    "surface_features": ["char_length", "word_count", "avg_word_length", "digit_ratio"],
    "capitalization_features": ["uppercase_ratio", "is_all_caps", "is_title_case"],
    "punctuation_features": ["ends_with_period", "ends_with_colon", "ends_with_question", "sentence_count"],
    "stopword_ratio": ["stopword_ratio"],
    "regex_feature_flags": ["starts_with_number", "contains_roman_numeral", "is_list_marker"],
    "citation_year_counts": ["citation_marker_count", "year_mention_count"],
    "position_features": ["relative_doc_position", "is_front_matter", "is_back_matter", "distance_from_doc_start", "distance_to_doc_end"],
    "neighbour_features": ["prev_elem_word_count", "next_elem_word_count", "is_isolated"],
    "run_typography": ["is_bold", "is_italic", "all_runs_bold", "font_size_pt", "relative_font_size", "has_drawing", "is_table"],
}.items():
    QUERIES[_name] = _features(_cols)
    SQL[_name] = oracle.sql(f"select doc_id, idx, {', '.join(_cols)} from f")


@query("select doc_id, idx, " + ", ".join(f"cast({c} as double) as {c}" for c in FT.NAMES) + " from f")
def full_feature_matrix(spark, sf_dir):
    return FT.all_features(_man(spark, sf_dir)).select("doc_id", "idx", *[F.col(c).cast("double").alias(c) for c in FT.NAMES])


@query("select d.doc_id, coalesce(md, 11.0::double) as median_size from (select distinct doc_id from man) d left join med on d.doc_id = m_doc")
def doc_median_font(spark, sf_dir):
    return FT.with_median(_man(spark, sf_dir)).select("doc_id", "median_size").distinct()


# linguistic features


def _linguistic(names: list[str]):
    def run(spark, sf_dir):
        return LG.linguistic(_man(spark, sf_dir)).select("doc_id", "idx", *[f"nlp.{c}" for c in names])

    return run


for _name, _cols in {
    "linguistic_features": LG.NAMES,
    "lexical_diversity": ["lexical_diversity", "stopword_ratio"],
    "sentence_stats": ["sentence_count", "avg_sentence_length", "avg_word_length"],
    "isolation_flags": ["is_isolated", "prev_paragraph_word_count", "next_paragraph_word_count"],
    "keyword_flags": [c for c in LG.NAMES if c.endswith("_keyword")],
}.items():
    QUERIES[_name] = _linguistic(_cols)
    SQL[_name] = oracle.sql(f"select doc_id, idx, {', '.join(_cols)} from nlp")


@query("select doc_id, idx, text_length, word_count, is_all_caps, starts_with_number, contains_chapter_keyword, round(paragraph_position * 100) / 100 as paragraph_position from nlp")
def core_feature_dict(spark, sf_dir):
    rows = LG.linguistic(_man(spark, sf_dir)).select("doc_id", "idx", *[f"nlp.{c}" for c in LG.CORE])
    return rows.withColumn("paragraph_position", F.round(F.col("paragraph_position") * 100) / 100)


# classification


@query("select doc_id, idx, rule_id, rule_name, rule_type, rule_confidence from r")
def rule_engine_labels(spark, sf_dir):
    return rules.with_rules(_placed(spark, sf_dir)).select("doc_id", "idx", "rule_id", "rule_name", "rule_type", "rule_confidence")


@query("select coalesce(rule_name, 'none') as rule_name, count(*) as n, sum(cast(round(coalesce(rule_confidence, 0.5::double) * 100) as bigint)) as confidence_hundredths from r group by 1")
def rule_label_counts(spark, sf_dir):
    rows = rules.with_rules(_placed(spark, sf_dir))
    return rows.groupBy(F.coalesce("rule_name", F.lit("none")).alias("rule_name")).agg(F.count("*").alias("n"), F.sum(F.round(F.coalesce("rule_confidence", F.lit(0.5)) * 100).cast("long")).alias("confidence_hundredths"))


@query("select doc_id, idx, label, conf, tier, tier || ':' || coalesce(matched_rule, 'none') as detection_method from a")
def arbitration(spark, sf_dir):
    return _ruled(spark, sf_dir).select("doc_id", "idx", "label", "conf", "tier", "detection_method")


@query("select doc_id, idx, case when blank or rule_confidence >= 0.97 then 'rule' else 'ml' end as tier from r")
def arbitration_threshold(spark, sf_dir):
    return rules.arbitrated(rules.with_rules(_placed(spark, sf_dir)), threshold=0.97).select("doc_id", "idx", "tier")


@query("select doc_id, idx, detected_type, detected_confidence from det")
def detector_labels(spark, sf_dir):
    return detector.detected(_placed(spark, sf_dir)).select("doc_id", "idx", "detected_type", "detected_confidence")


@query("select doc_id, idx, pattern_matched from det")
def detector_captures(spark, sf_dir):
    return detector.detected(_placed(spark, sf_dir)).select("doc_id", "idx", "pattern_matched")


@query(oracle.detector(r"^(?:MACHINE|CHAPTER\s+XIV)[^.]*", {"chapter"}, "0.999"))
def detector_custom_config(spark, sf_dir):
    cfg = detector.DetectorConfig(enabled=frozenset({"chapter"}), custom_patterns={"custom_module": [r"^(?:MACHINE|CHAPTER\s+XIV)[^.]*"]}, confidence={"chapter_digit": 0.999})
    return detector.detected(_placed(spark, sf_dir), cfg).select("doc_id", "idx", "detected_type", "detected_confidence", "pattern_matched")


@query("select doc_id, idx, nlp_type, nlp_confidence from nlpc")
def nlp_labels(spark, sf_dir):
    return nlp_classifier.classified(LG.linguistic(_man(spark, sf_dir))).select("doc_id", "idx", "nlp_type", "nlp_confidence")


@query("select doc_id, idx, array_to_string(nlp_cues, ',') as cues, cast(len(nlp_cues) as bigint) as n_cues from nlpc")
def nlp_cues(spark, sf_dir):
    rows = nlp_classifier.classified(LG.linguistic(_man(spark, sf_dir)))
    return rows.select("doc_id", "idx", F.array_join("nlp_cues", ",").alias("cues"), F.size("nlp_cues").cast("long").alias("n_cues"))


# smoothing


@query("select doc_id, idx, final_label, final_conf, smooth_reason from s")
def smoothed_sequence(spark, sf_dir):
    return _smooth(spark, sf_dir).select("doc_id", "idx", "final_label", "final_conf", "smooth_reason")


@query("select doc_id, idx, anchor as is_anchor from s")
def anchor_parity(spark, sf_dir):
    return _smooth(spark, sf_dir).select("doc_id", "idx", "is_anchor")


def _smoothed_by(reason: str):
    def run(spark, sf_dir):
        return _smooth(spark, sf_dir).filter(F.col("smooth_reason").contains(reason)).select("doc_id", "idx", "label", "final_label", "smooth_reason")

    return run


for _name, _reason in {"caption_promotion": "promoted_to_caption", "unanchored_captions": "unanchored_caption", "first_subheading": "initial_subheading", "back_matter_refs": "promoted_to_reference"}.items():
    QUERIES[_name] = _smoothed_by(_reason)
    SQL[_name] = oracle.sql(f"select doc_id, idx, label, final_label, smooth_reason from s where contains(smooth_reason, '{_reason}')")


_INITIAL = "case when kind = 'table' then 'table' when kind = 'figure' then 'figure' when listed then 'list' when sl = 'title' then 'title' when sl in ('subtitle', 'author') then 'author' when contains(sl, 'heading') then 'heading' when contains(sl, 'caption') then 'caption' when contains(sl, 'reference') or contains(sl, 'bibliography') then 'reference' when contains(sl, 'list') or contains(sl, 'bullet') then 'list' else 'paragraph' end"


@query()
def title_author_demotion(spark, sf_dir):
    """Titles and authors by style, which occur in the body, too."""
    rows = smoother.smoothed(_placed(spark, sf_dir).withColumns({"label": tables.initial_type(), "conf": F.lit(0.9)}))
    return rows.filter(F.col("smooth_reason").contains("in_body_demoted")).select("doc_id", "idx", "label", "final_label", "final_conf", "smooth_reason")


SQL["title_author_demotion"] = oracle.sql("select doc_id, idx, label, final_label, final_conf, smooth_reason from s where contains(smooth_reason, 'in_body_demoted')", a=f"select *, {_INITIAL} as label, 0.9::double as conf from p")

# reports


@query("select doc_id, final_label as label, count(*) as n from s group by 1, 2")
def type_counts(spark, sf_dir):
    return _smooth(spark, sf_dir).groupBy("doc_id", F.col("final_label").alias("label")).agg(F.count("*").alias("n"))


@query("select doc_id, '{' || string_agg(label || '=' || n, ', ' order by label) || '}' as type_counts from (select doc_id, final_label as label, count(*) as n from s group by 1, 2) group by doc_id")
def type_count_map(spark, sf_dir):
    rows = report.type_counts(_smooth(spark, sf_dir), "final_label")
    text = F.array_join(F.transform(F.map_entries("type_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    return rows.select("doc_id", F.concat(F.lit("{"), text, F.lit("}")).alias("type_counts"))


@query("select doc_id, " + ", ".join(f"count(*) filter (where final_label = '{y}') as {y}_count" for y in LABELS) + " from s group by doc_id")
def type_pivot(spark, sf_dir):
    return report.type_pivot(_smooth(spark, sf_dir), "final_label")


@query("select doc_id, count(*) filter (where tier = 'rule') as rule_count, count(*) filter (where tier = 'ml') as ml_count, count(*) filter (where final_label <> label) as smoothed_count, count(*) as total from s group by doc_id")
def tier_counts(spark, sf_dir):
    return report.tiers(_smooth(spark, sf_dir))


@query("select d.doc_id, coalesce(m, 1.0::double) as avg_confidence from documents d left join (select doc_id, sum(cast(round(final_conf * 100) as bigint)) / count(*) / 100 as m from s group by doc_id) x using (doc_id)")
def avg_confidence(spark, sf_dir):
    return report.average_confidence(tables.read(spark, sf_dir, "documents"), _smooth(spark, sf_dir))


@query("select doc_id, count(*) as elements, cast(sum(wc) as bigint) as words, cast(sum(length(text)) as bigint) as chars from t1 group by doc_id")
def doc_totals(spark, sf_dir):
    return report.totals(FT.with_text(_man(spark, sf_dir)))


@query("select doc_id, idx, case when text <> '' then substring(text, 1, 160) end as preview from man")
def preview_text(spark, sf_dir):
    return report.preview(_man(spark, sf_dir)).select("doc_id", "idx", "preview")


@query("select doc_id, idx, case when kind = 'table' then substring(replace(text, chr(10), ' | '), 1, 60) else substring(replace(text, chr(10), ' '), 1, 65) end as line from man where idx < 15")
def preview_topk(spark, sf_dir):
    return report.summary_lines(_man(spark, sf_dir)).select("doc_id", "idx", "line")


@query("select doc_id, greatest(0, count(*) - 15) as omitted from man group by doc_id")
def summary_omitted(spark, sf_dir):
    return report.omitted(_man(spark, sf_dir))


@query("select final_label as label, count(*) as n, list_position([" + ", ".join(f"'{y}'" for y in LABELS) + "], final_label) as position from s group by 1")
def summary_lines(spark, sf_dir):
    order = F.array(*[F.lit(y) for y in LABELS])
    return _smooth(spark, sf_dir).groupBy(F.col("final_label").alias("label")).agg(F.count("*").alias("n")).withColumn("position", F.array_position(order, F.col("label")).cast("int"))


@query("select case when final_conf >= 0.9 then 'high' when final_conf >= 0.75 then 'medium' else 'low' end as band, count(*) as n from s group by 1")
def confidence_bands(spark, sf_dir):
    return report.bands(_smooth(spark, sf_dir), "final_conf")


@query("select doc_id, idx, final_label as element_type, final_conf as confidence, tier as detection_method, coalesce(matched_rule, '') as reason, case when text <> '' then substring(text, 1, 160) end as preview from s")
def element_response(spark, sf_dir):
    return report.element_response(_smooth(spark, sf_dir)).drop("formatting")


# preservation


def _tokens(spark, sf_dir):
    return preservation.with_token(_man(spark, sf_dir).select("doc_id", "idx", "text"))


def _mutated(tokens: DataFrame) -> DataFrame:
    """A deterministic change: every tenth token in capitals, the last dropped in some documents, one added in others."""
    last = F.max("idx").over(W.partitionBy("doc_id"))
    rows = tokens.withColumn("last", last)
    kept = rows.filter(~((F.col("doc_id") % 3 == 0) & (F.col("idx") == F.col("last")))).select("doc_id", "idx", F.when(F.col("idx") % 10 == 0, F.upper("token")).otherwise(F.col("token")).alias("token"))
    added = tokens.filter("doc_id % 7 = 1").groupBy("doc_id").agg((F.max("idx") + 1).alias("idx")).withColumn("token", F.lit("added"))
    return kept.unionByName(added)


@query("select doc_id, idx, token from tok")
def normalize_text(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", "idx", "token")


@query("select doc_id, string_agg(token, chr(30) order by idx) as tokens from tok group by doc_id")
def token_sequence(spark, sf_dir):
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]), "\x1e")
    return _tokens(spark, sf_dir).groupBy("doc_id").agg(seq.alias("tokens"))


_BODY = "select doc_id, count(*) as element_count, coalesce(string_agg(case when token <> '' then token end, chr(10) || chr(10) order by idx), '') as body from {} group by doc_id"


@query(r"select doc_id, sha256(body) as sha256, element_count, cast(case when body = '' then 0 else len(regexp_split_to_array(trim(body), '\s+')) end as bigint) as word_count, cast(length(body) as bigint) as char_count from (" + _BODY.format("tok") + ")")
def doc_fingerprint(spark, sf_dir):
    return preservation.fingerprint(_tokens(spark, sf_dir))


_DIFF = "select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.idx, b.idx) as idx, case when b.token is null then 'missing' when a.token is null then 'added' when a.token <> b.token then 'changed' else 'same' end as state from tok a full outer join out b on a.doc_id = b.doc_id and a.idx = b.idx"


@query(_DIFF)
def positional_diff(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return preservation.differences(tokens, _mutated(tokens))


@query(f"select doc_id, coalesce(string_agg(case when state = 'changed' then idx end, ',' order by idx), '') as changed, coalesce(string_agg(case when state = 'missing' then idx end, ',' order by idx), '') as missing, coalesce(string_agg(case when state = 'added' then idx end, ',' order by idx), '') as added from ({_DIFF}) group by doc_id")
def changed_missing_added(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    rows = preservation.report(tokens, _mutated(tokens))
    return rows.select("doc_id", *[F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c) for c in ("changed", "missing", "added")])


@query(f"select doc_id, (select sha256(body) from ({_BODY.format('tok')}) x where x.doc_id = d.doc_id) = (select sha256(body) from ({_BODY.format('out')}) x where x.doc_id = d.doc_id) and n = 0 as is_identical from (select doc_id, count(*) filter (where state <> 'same') as n from ({_DIFF}) group by doc_id) d")
def identity_flag(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return preservation.report(tokens, _mutated(tokens)).select("doc_id", "is_identical")


_PRINT = "select doc_id, sha256(body) as h, length(body) as c, case when body = '' then 0 else len(regexp_split_to_array(trim(body), '\\s+')) end as w from ({})"


@query(
    f"""select doc_id, a.h = b.h as is_identical, case when a.h = b.h then '100% textual content preservation verified.'
  else 'Content mismatch! Hash A (' || a.h[1:12] || '...) != Hash B (' || b.h[1:12] || '...). Chars: ' || a.c || ' vs ' || b.c || ', Words: ' || a.w || ' vs ' || b.w || '.' end as message
from ({_PRINT.format(_BODY.format('tok'))}) a join ({_PRINT.format(_BODY.format('out'))}) b using (doc_id)"""
)
def identity_message(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return preservation.identity(tokens, _mutated(tokens))


# formatting

_PROFILES = "(values ('hackathon_default', 12.0::double, 1.27::double, 16.0::double, 18.0::double, 1.52::double, 1.97::double), ('trade', 10.5, 0.635, 14.0, 26.0, 1.905, 1.588), ('academic', 11.0, 0.635, 14.0, 18.0, 2.54, 2.54), ('fiction', 11.0, 0.635, 15.0, 24.0, 2.0, 2.0)) as pr(profile, body, indent, h1, title, top, lft)"
_REFINED = "case when label = 'heading' and contains(sl, 'heading 1') and (starts_with(low, 'chapter ') or starts_with(low, 'part ')) then 'chapter' when label = 'heading' and not contains(sl, 'heading 1') and (contains(sl, 'heading 2') or contains(sl, 'heading 3')) then 'subheading' else label end"
_STYLED = f"""select doc_id, idx, profile, y as element_type, case y when 'title' then title when 'chapter' then h1 when 'heading' then h1 when 'subheading' then 12.0 when 'author' then 12.0 when 'list' then 12.0 when 'caption' then 10.0 when 'reference' then 10.0 when 'table' then 10.0 else body end as font_size_pt,
  case when y in ('title', 'author', 'caption', 'figure') then 'center' when y in ('chapter', 'heading', 'subheading', 'reference', 'list', 'table') then 'left' else 'justified' end as alignment, case when y = 'table' then 1.0::double else 1.5::double end as line_spacing,
  case when y in ('title', 'author', 'chapter', 'heading', 'subheading', 'caption', 'table', 'figure') then 0.0::double when y = 'reference' then -0.762 when y = 'list' then -0.635 else indent end as first_line_indent_cm,
  case when y = 'reference' then 0.762::double when y = 'list' then 0.635::double else 0.0::double end as left_indent_cm, y in ('title', 'chapter', 'heading', 'subheading') as bold, y = 'caption' as italic, y = 'chapter' as page_break_before, y in ('chapter', 'heading', 'subheading') as keep_with_next
from (select *, {_REFINED} as y from a) cross join {_PROFILES}"""
_STYLE_COLS = ["doc_id", "idx", "profile", "element_type", "font_size_pt", "alignment", "line_spacing", "first_line_indent_cm", "left_indent_cm", "bold", "italic", "page_break_before", "keep_with_next"]


@query(f"select profile as name, 'Times New Roman' as body_font, body as body_size_pt, 'justified' as body_alignment, 1.5::double as body_line_spacing, indent as body_first_indent_cm, h1 as heading_1_size_pt, title as title_size_pt from {_PROFILES}", chain=False)
def preset_dim(spark, sf_dir):
    return formatter.presets(spark).select("name", "body_font", "body_size_pt", "body_alignment", "body_line_spacing", "body_first_indent_cm", "heading_1_size_pt", "title_size_pt")


@query(f"select profile as name, top as top_margin_cm, top as bottom_margin_cm, lft as left_margin_cm from {_PROFILES}", chain=False)
def page_geometry(spark, sf_dir):
    return formatter.page_geometry(formatter.profiles(spark)).select("name", "top_margin_cm", "bottom_margin_cm", "left_margin_cm")


@query(f"select doc_id, idx, {_REFINED} as refined from (select *, {_INITIAL} as label from t1)")
def style_refinement(spark, sf_dir):
    rows = FT.with_text(_man(spark, sf_dir)).withColumn("label", tables.initial_type())
    return rows.select("doc_id", "idx", formatter.refined_type(F.col("label"), F.col("style_lc"), F.col("low")).alias("refined"))


@query(_STYLED)
def applied_formatting(spark, sf_dir):
    return formatter.formatted(_ruled(spark, sf_dir), formatter.profiles(spark)).select(*_STYLE_COLS)


@query(f"select s.doc_id, s.idx, cast(i - 1 as int) as run_no, r.text as run_text, case when s.element_type = 'paragraph' then r.bold else s.bold end as bold, case when s.element_type = 'paragraph' then r.italic else s.italic end as italic, s.font_size_pt from ({_STYLED}) s join (select doc_id, idx, unnest(runs) as r, generate_subscripts(runs, 1) as i from man) x on s.doc_id = x.doc_id and s.idx = x.idx where profile = 'trade'")
def run_overrides(spark, sf_dir):
    rows = _ruled(spark, sf_dir)
    styles = formatter.formatted(rows, formatter.profiles(spark), profile="trade")
    out = formatter.run_overrides(rows, styles)
    return out.select("doc_id", "idx", F.posexplode("runs").alias("run_no", "r")).select("doc_id", "idx", "run_no", F.col("r.text").alias("run_text"), "r.bold", "r.italic", "r.font_size_pt")


@query("select doc_id, idx, cast(i - 1 as int) as row_idx, cell, i = 1 as bold from (select doc_id, idx, i, unnest(string_split(line, chr(9))) as cell from (select doc_id, idx, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from man where kind = 'table'))")
def header_bold_cells(spark, sf_dir):
    rows = _man(spark, sf_dir).filter("kind = 'table'").select("doc_id", "idx", F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))
    return rows.select("doc_id", "idx", "row_idx", F.explode(F.split("line", "\t")).alias("cell"), (F.col("row_idx") == 0).alias("bold"))


@query("select doc_id, idx, cast(floor((idx + 1) / greatest(1, n) * 90) as bigint) as progress from p")
def progress(spark, sf_dir):
    return formatter.progress(_placed(spark, sf_dir))


# models


@query("select quality as label, count(*) as n, sum(count(*)) over () / (count(*) over () * count(*)) as weight from labels group by quality", chain=False)
def class_weights(spark, sf_dir):
    return models.balanced_weights(tables.read(spark, sf_dir, "labels"), "quality")


@query("select doc_id, quality, row_number() over (partition by quality order by md5(cast(doc_id as varchar)), doc_id) <= floor(count(*) over (partition by quality) * 0.8) as in_train from labels", chain=False)
def stratified_split(spark, sf_dir):
    return models.stratified(tables.read(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "in_train")


@query("select 'word_count' as feature, round(avg(word_count), 6) as mean, round(stddev_pop(word_count), 6) as scale from f union all select 'char_length', round(avg(char_length), 6), round(stddev_pop(char_length), 6) from f")
def scaler_stats(spark, sf_dir):
    rows = models.scaler_stats(FT.text_features(FT.with_text(_man(spark, sf_dir))), ["word_count", "char_length"])
    return rows.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


_WEIGHTS = [[((7 * i + 3 * j) % 11 - 5) / 8 for j in range(64)] for i in range(4)]
_DOTS = "[" + ", ".join("list_sum(list_transform(list_zip(embedding, " + str(w) + "), lambda z: cast(z[1] as double) * cast(z[2] as double)))" for w in _WEIGHTS) + "]"


@query(f"select vec_id, cast(list_position(l, list_max(l)) - 1 as int) as predicted, round(1 / list_sum(list_transform(l, lambda z: exp(z - list_max(l)))), 6) as confidence from (select vec_id, {_DOTS} as l from embeddings)", chain=False)
def linear_softmax_inference(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "embeddings").withColumn("l", models.linear_logits(F.col("embedding"), _WEIGHTS, [0.0] * 4))
    rows = rows.withColumn("p", models.softmax(F.col("l")))
    return rows.select("vec_id", models.argmax(F.col("l")).alias("predicted"), F.round(F.array_max("p"), 6).alias("confidence"))


@query("select label, count(*) as n, avg(case when vec_id % 2 = 0 then 1.0::double else 0.0::double end) as share from embeddings group by label", chain=False)
def label_distribution(spark, sf_dir):
    return tables.read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.when(F.col("vec_id") % 2 == 0, 1.0).otherwise(0.0)).alias("share"))


@query()
def synthetic_corpus(spark, sf_dir):
    from ..sources.corpus import synthetic_corpus as make

    return make(spark, 50, 42).select("doc_id", "idx", "label", "kind", "text", "style")


@query()
def lr_train(spark, sf_dir):
    _, accuracy = models.train(spark, "logistic_regression")
    return spark.createDataFrame([("logistic_regression", float(accuracy))], "model string, accuracy double")


@query()
def tree_train(spark, sf_dir):
    _, accuracy = models.train(spark, "decision_tree")
    return spark.createDataFrame([("decision_tree", float(accuracy))], "model string, accuracy double")


@query()
def hybrid_pipeline(spark, sf_dir):
    model, _ = models.train(spark, "logistic_regression")
    return hybrid.classified(_man(spark, sf_dir), model).select("doc_id", "idx", "label", "conf", "tier", "final_label", "final_conf", "smooth_reason")


# jobs


@query("select user_id as job, arg_max(event_type, (ts, event_id)) as status, max(ts) as updated, count(*) as events from events group by user_id", chain=False)
def latest_status(spark, sf_dir):
    return jobs.latest_status(tables.read(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query("select user_id, sum(n) / 4 as elapsed from (select user_id, event_type, count(*) as n from events group by 1, 2) group by user_id", chain=False)
def elapsed_total(spark, sf_dir):
    n = tables.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.count("*") / 4).alias("s"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "s"))).alias("timings"))
    return maps.select("user_id", jobs.elapsed(F.col("timings")).alias("elapsed"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')", chain=False)
def orphan_anti_join(spark, sf_dir):
    """Customers without an urgent order; every customer has some order."""
    return jobs.orphans(tables.read(spark, sf_dir, "customer").select("c_custkey"), tables.read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(r"select page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'document.docx') as name from pages", chain=False)
def filename_sanitize(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", jobs.safe_filename(F.col("url")).alias("name"))


@query("select o_custkey as archive, count(*) as entries, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as bytes, bool_or(o_orderkey % 97 = 0) as unsafe, count(*) <= 10000 and sum(cast(floor(o_totalprice) as bigint)) <= 524288000 and not bool_or(o_orderkey % 97 = 0) as accepted from orders group by 1", chain=False)
def archive_guard(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 97 == 0, "../evil.xml").otherwise(F.concat(F.lit("word/"), F.col("o_orderkey").cast("string")))
    return jobs.archive_guard(o.select(F.col("o_custkey").alias("archive"), name.alias("name"), F.floor("o_totalprice").cast("long").alias("size")), "archive")


@query("select list_sort(list_distinct(list_concat(['http://localhost:3000', 'http://localhost:5173'], list(distinct regexp_extract(url, '^(https?://[^/]+)', 1))))) as origins from pages", chain=False)
def origin_union(spark, sf_dir):
    own = F.array(F.lit("http://localhost:3000"), F.lit("http://localhost:5173"))
    return tables.read(spark, sf_dir, "pages").agg(F.array_sort(F.array_union(own, F.collect_set(F.regexp_extract("url", r"^(https?://[^/]+)", 1)))).alias("origins"))


@query(f"select w, count(*) as n from (select unnest(regexp_extract_all(lower(line), '{X.WORD}')) as w from lines) group by w")
def word_counts(spark, sf_dir):
    return tables.doc_elements(spark, sf_dir).select(F.explode(X.words(F.lower("line"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
