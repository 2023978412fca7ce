"""Sequence repair as window functions: the anchor recurrence has a closed form, so no row-by-row state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Caption prefixes and cues.
CUE_PREFIXES = ("fig", "table", "tbl", "illustration", "source:", "note:")
CUES = ("figure", "fig", "table", "tbl", "shown", "diagram", "chart", "state transition")
CAPTION_PREFIXES = ("figure", "fig.", "fig ", "table", "tbl.", "tbl ", "illustration", "plate", "chart")


def _starts(prefixes):
    return F.col("low").rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")


def smoothed(df: DataFrame, label: str = "label", conf: str = "conf") -> DataFrame:
    """Adds final_label, final_conf, smooth_reason; needs with_text and with_position. One shuffle by document for all windows."""
    w = W.partitionBy("doc_id").orderBy("idx")
    running = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    y, pos, low, wc, t = F.col(label), F.col("pos"), F.col("low"), F.col("wc"), F.col("t")
    bare_figure = (y == "figure") & (t != "") & ~F.col("contains_drawing") & (F.col("kind") != "figure")
    cue = (t != "") & (_starts(CUE_PREFIXES) | (wc < 35) & low.rlike("|".join(CUES))) & (y != "caption") & ~low.startswith("chapter")
    header = (y == "heading") & (low.contains("reference") | low.contains("bibliography")) & (pos > 0.50)
    rows = df.withColumns({
        "__base": (y == "table") | (y == "figure") & ~bare_figure,
        "__cue": cue,
        "__bare": bare_figure,
        "__seen": F.coalesce(F.max(y.isin("chapter", "heading", "subheading")).over(before), F.lit(False)),
        "__refs": F.max(header).over(running),
    })
    # an anchor whose predecessor is one becomes a caption and so no anchor: along a chain of such rows the state alternates
    rows = rows.withColumn("__link", (F.col("idx") > 0) & F.col("__base") & F.col("__cue"))
    rows = rows.withColumns({"__m": F.max(F.when(~F.col("__link"), F.col("idx"))).over(running), "__bm": F.last(F.when(~F.col("__link"), F.col("__base")), ignorenulls=True).over(running)})
    rows = rows.withColumn("__anchor", F.when((F.col("idx") - F.col("__m")) % 2 == 0, F.col("__bm")).otherwise(~F.col("__bm")))
    rows = rows.withColumn("__after", F.coalesce(F.lag("__anchor").over(w), F.lit(False)))
    promoted = F.col("__after") & F.col("__cue")
    to_ref = F.col("__refs") & (pos > 0.60) & (y == "paragraph") & (t.startswith("[") | t.contains("19") | t.contains("20"))
    first_sub = (y == "subheading") & ~F.col("__seen")
    lone = (y == "caption") & ~_starts(CAPTION_PREFIXES) & ~F.col("__after")
    late = pos >= 0.15
    cases = [
        (to_ref, "reference", 0.92, "smoothed_back_matter_paragraph_promoted_to_reference"),
        (first_sub, "heading", 0.88, "smoothed_initial_subheading_promoted_to_heading"),
        (promoted, "caption", 0.95, "smoothed_post_figure_table_promoted_to_caption"),
        (F.col("__bare"), "paragraph", 0.85, "smoothed_text_element_demoted_from_figure"),
        (lone, "paragraph", 0.90, "smoothed_unanchored_caption_demoted_to_paragraph"),
        ((y == "author") & late, "paragraph", 0.85, "smoothed_author_in_body_demoted_to_paragraph"),
        ((y == "title") & late & (wc < 15), "heading", 0.85, "smoothed_title_in_body_demoted_to_heading"),
        ((y == "title") & late, "paragraph", 0.90, "smoothed_title_in_body_demoted_to_paragraph"),
    ]
    case = F.lit(0)
    for k in range(len(cases), 0, -1):
        case = F.when(cases[k - 1][0], F.lit(k)).otherwise(case)
    rows = rows.withColumn("__case", case)
    table = lambda f: F.create_map(*[x for k, c in enumerate(cases, 1) for x in (F.lit(k), F.lit(c[f]))])[F.col("__case")]
    rows = rows.withColumns({"final_label": F.coalesce(table(1), y), "final_conf": F.coalesce(table(2), F.col(conf)), "smooth_reason": F.coalesce(table(3), F.lit("initial_prediction")), "is_anchor": F.col("__anchor")})
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])
