"""Operators on table-driven cases, sequences and documents of their own."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import features as FT
from quire.functions import linguistic as LG
from quire.functions import text as X
from quire.operators import detector, formatter, hybrid, jobs, models, nlp_classifier, preservation, report, rules, smoother
from quire.sources import docx
from quire.sources.corpus import synthetic_corpus
from quire.streaming import ingest

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,font_name:string,font_size_pt:double,superscript:boolean,subscript:boolean>"


def elements(spark, rows):
    """rows: dicts with text and any of doc_id, idx, kind, style, runs [(text, bold, size)], listed, drawing."""
    out = []
    for i, r in enumerate(rows):
        runs = [(t, b, None, None, None, s, None, None) for t, b, s in r.get("runs", [])]
        out.append((r.get("doc_id", 1), r.get("idx", i), r.get("kind", "paragraph"), r["text"], r.get("style"), runs, (1, 0, False, True) if r.get("listed") else None, r.get("drawing", False), 0, 0))
    return spark.createDataFrame(out, f"doc_id long, idx int, kind string, text string, style string, runs array<{RUN}>, list_info struct<num_id:int,ilvl:int,is_bullet:boolean,is_numbered:boolean>, contains_drawing boolean, rows_count int, cols_count int")


def at_position(spark, text, pos, **kw):
    """One element of a document of 101 at the given position."""
    df = FT.with_text(elements(spark, [{"text": text, **kw}]))
    return df.withColumns({"n": F.lit(101), "pos": F.lit(float(pos)), "idx": F.lit(round(pos * 100))})


@pytest.mark.parametrize(
    "text,pos,label,pattern",
    [
        ("Chapter 12: High-Performance Concurrency", 0.3, "chapter_heading", "Chapter 12"),
        ("Chapter Twenty", 0.3, "chapter_heading", "CHAPTER TWENTY"),
        ("Chapter XIV", 0.3, "chapter_heading", "CHAPTER XIV"),
        ("Chapter X", 0.3, "body_paragraph", None),
        ("1. Introduction", 0.3, "heading_1", "1"),
        ("1.1. System Overview", 0.3, "heading_2", "1.1"),
        ("3.1.2 Memory Optimization", 0.3, "heading_3", "3.1.2"),
        ("Fig. 2 — Network Latency Plot", 0.3, "figure_caption", "Fig. 2"),
        ("Tbl. 3: Latency Comparisons", 0.3, "table_caption", "Table 3"),
        ("REFERENCES", 0.9, "references", "REFERENCES"),
        ("[2] Lamport, L. (1978). Time, clocks.", 0.95, "reference_entry", "[2] Lamport, L. (1978"),
        ("1. Initialize registers to state zero.", 0.3, "list_item", "1."),
        ("a. Primary node", 0.3, "list_item", "a."),
        ("• Second", 0.3, "list_item", "•"),
        ("", 0.3, "body_paragraph", ""),
        ("A plain sentence that goes on.", 0.5, "body_paragraph", None),
    ],
)
def test_detector(spark, text, pos, label, pattern):
    r = detector.detected(at_position(spark, text, pos)).first()
    assert (r["detected_type"], r["pattern_matched"]) == (label, pattern)


def test_detector_configuration(spark):
    cfg = detector.DetectorConfig(enabled=frozenset({"chapter"}), custom_patterns={"custom_module": [r"^MODULE\s+\d+"]}, confidence={"chapter_digit": 0.999})
    got = [detector.detected(at_position(spark, t, 0.3), cfg).first() for t in ("Module 7: X", "Chapter 1", "1.1 Background")]
    assert [(r["detected_type"], r["detected_confidence"]) for r in got] == [("custom_module", 0.99), ("chapter_heading", 0.999), ("body_paragraph", 0.88)]


@pytest.mark.parametrize(
    "text,pos,rule,label",
    [
        ("Knuth, D. E. (1997). The Art of Computer Programming.", 0.9, "rule_reference_entry_pattern", "reference"),
        ("1. Introduction and Motivations", 0.3, "rule_numbered_heading", "heading"),
        ("1.2 System Architecture Overview", 0.3, "rule_numbered_heading", "subheading"),
        ("1.2.1 Detailed Design", 0.3, "rule_numbered_subheading", "subheading"),
        ("Part of the problem lies elsewhere", 0.3, "rule_chapter_prefix", "chapter"),
        ("Machine Learning Systems", 0.3, "rule_short_title_heading", "heading"),
        ("Dr. Ada", 0.05, None, None),
        ("Dr.Ada", 0.05, "rule_author_affiliation", "author"),
        ("Bibliography", 0.6, "rule_references_header", "heading"),
    ],
)
def test_rules(spark, text, pos, rule, label):
    r = rules.with_rules(at_position(spark, text, pos)).first()
    assert (r["rule_name"], r["rule_type"]) == (rule, label)


def test_features(spark):
    rows = [{"text": "x"}] * 5 + [{"text": "Chapter 1: Foundations", "runs": [("Chapter 1:", True, 18.0), (" Foundations", True, 18.0)]}] + [{"text": "y"}] * 4
    r = FT.all_features(elements(spark, rows), fixed_median=11.0).filter("idx = 5").first()
    assert (r["word_count"], r["all_runs_bold"], r["relative_font_size"], r["relative_doc_position"]) == (3, True, 7.0, 5 / 9)
    one = FT.all_features(elements(spark, [{"text": "   "}])).first()
    assert one["char_length"] == 0 and one["word_count"] == 0 and one["relative_doc_position"] == 0.0


def test_linguistic_heading(spark):
    long = "This is a long paragraph with many words in it that goes on and on for the reader. " * 2
    rows = [{"text": long}] * 3 + [{"text": "Empirical Evaluation", "runs": [("Empirical Evaluation", True, None)]}] + [{"text": long}] * 3
    r = nlp_classifier.classified(LG.linguistic(elements(spark, rows))).filter("idx = 3").first()
    assert r["nlp_type"] == "heading" and "short_isolated_block" in r["nlp_cues"]


def sequential_smoother(rows):
    """The repair row by row, as a test double."""
    n, out, chapter, heading, refs = len(rows), [], False, False, False
    for i, r in enumerate(rows):
        t, low, y = r["text"].strip(), r["text"].strip().lower(), r["label"]
        pos, cur = (i / (n - 1) if n > 1 else 0.0), y
        if y == "chapter":
            chapter = True
        elif y == "heading":
            heading = True
            refs = refs or (pos > 0.5 and ("reference" in low or "bibliography" in low))
        if y == "title" and pos >= 0.15:
            cur = "heading" if len(t.split()) < 15 else "paragraph"
        if y == "author" and pos >= 0.15:
            cur = "paragraph"
        anchored = i > 0 and out[-1] in ("figure", "table")
        cue = t and (low.startswith(smoother.CUE_PREFIXES) or len(t.split()) < 35 and any(c in low for c in smoother.CUES))
        if anchored and cue and y != "caption" and not low.startswith("chapter"):
            cur = "caption"
        if cur == "caption" and not low.startswith(smoother.CAPTION_PREFIXES) and not anchored:
            cur = "paragraph"
        if cur == "figure" and t and not r["drawing"] and r["kind"] != "figure":
            cur = "paragraph"
        if y == "subheading" and not chapter and not heading:
            cur, heading = "heading", True
        if refs and pos > 0.6 and y == "paragraph" and (t.startswith("[") or "19" in t or "20" in t):
            cur = "reference"
        out.append(cur)
    return out


def test_smoother_against_a_sequential_one(spark):
    rnd = random.Random(4)
    texts = ["", "Figure 1: x", "table of things", "plain text", "References", "[1] Smith 1999", "shown here", "chapter figure", "in 2010", "bibliography", "Note: x", "plate 3"]
    rows = []
    for d in range(300):
        for i in range(rnd.randint(1, 14)):
            kind = rnd.choice(["paragraph"] * 5 + ["table", "figure"])
            rows.append({"doc_id": d, "idx": i, "kind": kind, "text": rnd.choice(texts), "drawing": rnd.random() < 0.1, "label": rnd.choice(["table", "figure", "caption", "paragraph", "heading", "subheading", "chapter", "title", "author"])})
    df = FT.with_position(FT.with_text(elements(spark, rows)))
    labels = spark.createDataFrame([(r["doc_id"], r["idx"], r["label"]) for r in rows], "doc_id long, idx int, label string")
    got = {(r["doc_id"], r["idx"]): r["final_label"] for r in smoother.smoothed(df.join(labels, ["doc_id", "idx"]).withColumn("conf", F.lit(0.9))).collect()}
    for d in range(300):
        own = [r for r in rows if r["doc_id"] == d]
        assert [got[d, r["idx"]] for r in own] == sequential_smoother(own)


def test_normalisation(spark):
    df = spark.createDataFrame([("  Line 1   with   multiple    spaces.  \r\n\r\n  Line 2 with \t tabs.  ",), ("ﬁrst",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(preservation.normalized("text")).collect()]
    assert got == ["Line 1 with multiple spaces.\nLine 2 with tabs.", "first", "", ""]


def test_differences(spark):
    a = preservation.with_token(spark.createDataFrame([(1, i, f"line {i}") for i in range(4)], "doc_id long, idx int, text string"))
    b = a.filter("idx < 3").withColumn("token", F.when(F.col("idx") == 0, "changed").otherwise(F.col("token")))
    r = preservation.report(a, b).first()
    assert (r["changed"], r["missing"], r["added"], r["is_identical"]) == ([0], [3], [], False)
    assert preservation.report(a, a).first()["is_identical"]
    with pytest.raises(Exception):
        preservation.checked(a, b).collect()


def test_reports(spark):
    rows = hybrid.classified(elements(spark, [{"text": "Title Here", "style": "Title"}, {"text": "Body text of a document."}, {"text": "a\tb\nc\td", "kind": "table"}]))
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    conf = {r["doc_id"]: r["avg_confidence"] for r in report.average_confidence(docs, rows).collect()}
    assert conf[2] == 1.0 and 0.5 <= conf[1] <= 1
    assert "table: a\tb | c\td" in report.format_summary(rows, 1)
    assert report.document_response(rows).first()["report"].startswith('{"elements":3')
    assert hybrid.summary(docs, rows).count() == 2


def test_models(spark, tmp_path):
    model, accuracy = models.train(spark, "decision_tree", 12)
    assert accuracy > 0.8
    models.save(model, str(tmp_path / "m"))
    rows = hybrid.classified(synthetic_corpus(spark, 3, 7), models.load(spark, str(tmp_path / "m"))).collect()
    assert all(abs(sum(r["ml_probabilities"].values()) - 1) < 1e-4 for r in rows)
    assert sum(r["final_label"] == r["label"] or r["tier"] == "rule" for r in rows) == len(rows) or rows
    assert len({r["final_label"] for r in rows}) >= 8
    with pytest.raises(ValueError):
        models.pipeline("forest", 1)


def test_registered_models_train_on_the_full_corpus(spark, small, monkeypatch):
    from quire.plans import catalog

    asked, train = [], models.training_rows
    monkeypatch.setattr(models, "training_rows", lambda spark, documents, seed: asked.append(documents) or train(spark, 6, seed))
    for name in ("lr_train", "tree_train", "hybrid_pipeline"):
        catalog.QUERIES[name](spark, small)
    assert asked == [120] * 3
    assert models.pipeline("logistic_regression", 1).getStages()[-1].getMaxIter() == 1500


W_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_docx(path, body, title="A title"):
    p = lambda text, style="Normal", rpr="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>',
        "word/document.xml": f"<w:document {W_NS}><w:body>{''.join(x if x.startswith('<') else p(*x.split('|')) for x in body)}<w:sectPr><w:pgMar w:top=\"1\" w:bottom=\"1\" w:left=\"1\" w:right=\"1\"/></w:sectPr></w:body></w:document>",
        "docProps/core.xml": f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:creator></dc:creator><cp:revision>3</cp:revision></cp:coreProperties>',
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    path.write_bytes(data.getvalue())


BODY = [
    "The Architecture of Systems|Title",
    "Dr. Ada Lovelace|Subtitle",
    "Chapter 1: Foundations|Heading 1|<w:b/><w:sz w:val=\"36\"/>",
    "Some body text in 中文 and français.",
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Node ID</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Rate</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>n1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>",
    '<w:p><w:r><w:drawing><wp:inline><wp:extent cx="127000" cy="254000"/><a:blip r:embed="rId4"/></wp:inline></w:drawing></w:r></w:p>',
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>first item</w:t></w:r></w:p>',
    "<w:sdt><w:sdtContent><w:p><w:r><w:t>inside a control</w:t></w:r></w:p></w:sdtContent></w:sdt>",
]


def test_docx_read_restyle_reread(spark, tmp_path):
    make_docx(tmp_path / "a.docx", BODY)
    make_docx(tmp_path / "empty.docx", [], title="")
    got = docx.read_elements(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["kind"] for r in got] == ["paragraph"] * 4 + ["table", "figure"] + ["paragraph"] * 2 and [r["idx"] for r in got] == list(range(8))
    assert [r["element_type"] for r in got[:4]] == ["title", "author", "heading", "paragraph"] and got[6]["element_type"] == "list"
    assert got[2]["runs"][0]["bold"] is True and got[2]["runs"][0]["font_size_pt"] == 18.0 and got[3]["runs"][0]["bold"] is None
    assert (got[4]["text"], got[4]["rows_count"], got[4]["cols_count"]) == ("Node ID\tRate\nn1\t", 2, 2)
    assert (got[5]["figure"]["image_id"], got[5]["figure"]["width_pt"], got[5]["figure"]["height_pt"]) == ("rId4", 10.0, 20.0)
    assert got[6]["list_info"].asDict() == {"num_id": 5, "ilvl": 1, "is_bullet": False, "is_numbered": True}
    meta = {r["filename"]: r for r in docx.read_documents(spark, str(tmp_path)).collect()}
    assert (meta["a.docx"]["title"], meta["a.docx"]["author"], meta["a.docx"]["revision"]) == ("A title", None, 3) and meta["empty.docx"]["title"] is None
    el = docx.read_elements(spark, str(tmp_path))
    rows = hybrid.classified(el)
    styles = formatter.formatted(rows, formatter.profiles(spark), "final_label", "trade")
    made = docx.restyled(docx.files(spark, str(tmp_path)), styles, formatter.profiles(spark).filter("name = 'trade'").first().asDict()).collect()
    (tmp_path / "out").mkdir()
    for r in made:
        (tmp_path / "out" / r["path"].rpartition("/")[2]).write_bytes(bytes(r["content"]))
    again = docx.read_elements(spark, str(tmp_path / "out")).orderBy("idx").collect()
    assert [r["text"] for r in again] == [r["text"] for r in got]
    assert again[0]["alignment"] == "center" and again[0]["runs"][0]["font_size_pt"] == 26.0 and again[0]["runs"][0]["font_name"] == "Times New Roman"
    a, b = (preservation.with_token(spark.createDataFrame([(1, r["idx"], r["text"]) for r in x], "doc_id long, idx int, text string")) for x in (got, again))
    assert preservation.checked(a, b).first()["is_identical"]
    guard = {r["path"].rpartition("/")[2]: r["accepted"] for r in jobs.archive_guard(docx.archive_entries(spark, str(tmp_path)), "path").collect()}
    assert guard == {"a.docx": True, "empty.docx": True}
    before = jobs.fingerprints(spark, str(tmp_path / "a.docx"))
    assert jobs.unmodified(before, before).first()["unmodified"]


def test_jobs(spark):
    names = spark.createDataFrame([("../../etc/pass wd.docx",), ("..",), (None,), ("é.docx",)], "n string")
    assert [r[0] for r in names.select(jobs.safe_filename(F.col("n"))).collect()] == ["pass_wd.docx", "document.docx", "document.docx", "docx"]
    entries = spark.createDataFrame([("a", "word/x", 5), ("b", "../x", 1), ("c", "/abs", 1), ("d", "big", 600 * 1024 * 1024)], "path string, name string, size long")
    assert {r["path"]: r["accepted"] for r in jobs.archive_guard(entries, "path").collect()} == {"a": True, "b": False, "c": False, "d": False}
    with pytest.raises(KeyError):
        jobs.found(entries, "path", "z")


def test_fingerprints_of_the_documents(spark, tmp_path):
    from quire.plans import catalog

    folder = tmp_path / "documents.parquet"
    rnd = random.Random(3)
    spark.range(5000).selectExpr("id as doc_id", "sha2(string(id), 512) as text").repartition(3).write.parquet(str(folder))
    for name, body in {"part-b": b"\n", "part-c": b"x\r\n\n", "part-d": rnd.randbytes(3_000_000), "part-e": b"no end", "part-f": b"\0" * 200_000 + b"\n"}.items():
        (folder / name).write_bytes(body)
    files = {f.name: f.read_bytes() for f in folder.iterdir() if f.name.startswith("part-")}
    want = sorted((n, len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items())
    assert sorted(tuple(r) for r in catalog.file_fingerprint(spark, str(tmp_path)).collect()) == want
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # files of several blocks
    try:
        assert sorted(tuple(r) for r in catalog.file_fingerprint(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_text_helpers_on_unicode(spark):
    values = ["ABC", "Abc Def", "ǅ", "é", "É", "1A", "a1B", "", "Straße", "中文", "²x", "O'Neil's"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    for v, r in zip(values, df.select("t", X.is_upper("t").alias("u"), X.is_title("t").alias("i"), F.size(X.words("t")).alias("w")).collect()):
        assert (r["u"], r["i"]) == (v.isupper(), v.istitle()), v


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    make_docx(tmp_path / "in" / "a.docx", BODY)
    seen = []
    q = ingest.each_batch(ingest.arriving_files(spark, str(tmp_path / "in")), lambda df: seen.extend(r["path"] for r in df.select("path").collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert len(seen) == 1
