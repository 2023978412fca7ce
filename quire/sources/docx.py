"""Office Open XML documents: reader, metadata, archive guard and a writer that changes formatting alone. Only zipfile and ElementTree."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ELEMENT

W_ = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R_ = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A_ = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP_ = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
DC_, CP_, DCT_ = "{http://purl.org/dc/elements/1.1/}", "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}", "{http://purl.org/dc/terms/}"
EMU_PER_POINT = 12700.0


def blocks(body: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs and tables in order; a content control stands for all paragraphs and tables in it."""
    for child in body:
        if child.tag in (W_ + "p", W_ + "tbl"):
            yield child
        elif child.tag == W_ + "sdt":
            yield from (x for x in child.iter() if x.tag in (W_ + "p", W_ + "tbl"))


def _text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == W_ + "t":
            out.append(x.text or "")
        elif x.tag == W_ + "tab":
            out.append("\t")
        elif x.tag in (W_ + "br", W_ + "cr"):
            out.append("\n")
    return "".join(out)


def _flag(props: ET.Element | None, name: str) -> bool | None:
    node = props.find(W_ + name) if props is not None else None
    if node is None:
        return None
    return node.get(W_ + "val", "true").lower() not in ("0", "false", "off", "none")


def run_record(r: ET.Element) -> dict:
    props = r.find(W_ + "rPr")
    get = lambda tag, attr: props.find(W_ + tag).get(W_ + attr) if props is not None and props.find(W_ + tag) is not None else None
    size, vert = get("sz", "val"), get("vertAlign", "val")
    return {"text": _text(r), "bold": _flag(props, "b"), "italic": _flag(props, "i"), "underline": _flag(props, "u"), "font_name": get("rFonts", "ascii"), "font_size_pt": float(size) / 2 if size else None, "superscript": None if vert is None else vert == "superscript", "subscript": None if vert is None else vert == "subscript"}


def list_record(p: ET.Element, style: str | None) -> dict | None:
    """Native numbering is numbered; else the style's name tells."""
    num = p.find(f"{W_}pPr/{W_}numPr")
    low = (style or "").lower()
    if num is not None:
        val = lambda tag: num.find(W_ + tag).get(W_ + "val") if num.find(W_ + tag) is not None else None
        return {"num_id": int(val("numId")) if val("numId") else None, "ilvl": int(val("ilvl") or 0), "is_bullet": False, "is_numbered": True}
    if "bullet" in low:
        return {"num_id": None, "ilvl": 0, "is_bullet": True, "is_numbered": False}
    if "number" in low or "list" in low:
        return {"num_id": None, "ilvl": 0, "is_bullet": False, "is_numbered": True}
    return None


def drawings(p: ET.Element) -> list[dict]:
    out = []
    for d in p.iter():
        if d.tag in (W_ + "drawing", W_ + "pict"):
            blip = next(d.iter(A_ + "blip"), None)
            extent = next(d.iter(WP_ + "extent"), None)
            image = (blip.get(R_ + "embed") or blip.get(R_ + "link")) if blip is not None else None
            size = [float(extent.get(k)) / EMU_PER_POINT if extent is not None and extent.get(k) else None for k in ("cx", "cy")]
            out.append({"image_id": image, "image_filename": None, "content_type": None, "width_pt": size[0], "height_pt": size[1], "caption_text": None})
    return out


def initial_type(style: str | None, listed: bool) -> str:
    low = (style or "").lower()
    if listed:
        return "list"
    for label, hit in (("title", low == "title"), ("author", low in ("subtitle", "author")), ("heading", "heading" in low), ("caption", "caption" in low), ("reference", "reference" in low or "bibliography" in low), ("list", "list" in low or "bullet" in low)):
        if hit:
            return label
    return "paragraph"


def parse(content: bytes, doc_id: int) -> list[dict]:
    """Element rows of one document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names: dict[str, str] = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(W_ + "style"):
                n = s.find(W_ + "name")
                names[s.get(W_ + "styleId")] = n.get(W_ + "val") if n is not None else s.get(W_ + "styleId")
        body = ET.fromstring(z.read("word/document.xml")).find(W_ + "body")
    out = []
    for idx, b in enumerate(blocks(body) if body is not None else ()):
        row = {f.name: None for f in ELEMENT.fields} | {"doc_id": doc_id, "idx": idx, "confidence": 1.0, "detection_method": "native_parser", "contains_drawing": False, "rows_count": 0, "cols_count": 0, "cells": [], "runs": []}
        if b.tag == W_ + "tbl":
            cells = [[{"row_idx": i, "col_idx": j, "text": "\n".join(ps), "paragraphs": ps} for j, ps in enumerate([[_text(p) for p in c.findall(W_ + "p")] for c in r.findall(W_ + "tc")])] for i, r in enumerate(b.findall(W_ + "tr"))]
            row |= {"kind": "table", "element_type": "table", "cells": cells, "rows_count": len(cells), "cols_count": len(cells[0]) if cells else 0, "text": "\n".join("\t".join(c["text"].strip() for c in r) for r in cells)}
        else:
            style_node, align = b.find(f"{W_}pPr/{W_}pStyle"), b.find(f"{W_}pPr/{W_}jc")
            style = names.get(style_node.get(W_ + "val"), style_node.get(W_ + "val")) if style_node is not None else "Normal"
            text, found, listed = _text(b), drawings(b), list_record(b, style)
            row |= {"text": text, "style": style, "runs": [run_record(r) for r in b.iter(W_ + "r")], "alignment": align.get(W_ + "val") if align is not None else None}
            if found and not text.strip():
                row |= {"kind": "figure", "element_type": "figure", "figure": found[0]}
            else:
                row |= {"kind": "paragraph", "element_type": initial_type(style, listed is not None), "list_info": listed, "contains_drawing": bool(found)}
        out.append(row)
    return out


def metadata(content: bytes) -> dict:
    """Core properties; empty ones are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    get = lambda tag: ((core.findtext(tag) or "").strip() or None) if core is not None else None
    rev = get(CP_ + "revision")
    return {"title": get(DC_ + "title"), "author": get(DC_ + "creator"), "created": get(DCT_ + "created"), "modified": get(DCT_ + "modified"), "revision": int(rev) if rev and rev.isdecimal() else None}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id (hash of the path), length, modificationTime, content of .docx files; a missing path fails."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return rows.withColumn("doc_id", F.xxhash64("path"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Element rows of all documents under a path; a file is parsed whole in one task."""

    def run(batches):
        for pdf in batches:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                rows = parse(bytes(content), int(doc_id))
                if rows:
                    yield pd.DataFrame(rows, columns=[f.name for f in ELEMENT.fields])

    out = files(spark, path).select("doc_id", "content").mapInPandas(run, ELEMENT)
    return out.withColumn("element_id", F.format_string("elem_%05d_%s", "idx", F.substring(F.sha2(F.concat_ws(":", "doc_id", "idx", "text"), 256), 1, 8)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One metadata row per file."""
    kind = T.StructType([T.StructField(n, T.IntegerType() if n == "revision" else T.StringType()) for n in ("title", "author", "created", "modified", "revision")])

    @F.pandas_udf(kind)
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(bytes(c)) for c in content], columns=["title", "author", "created", "modified", "revision"])

    rows = files(spark, path).withColumn("m", run("content"))
    return rows.select("path", "doc_id", F.substring_index("path", "/", -1).alias("filename"), "m.*", F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("source_file_mtime"), F.sha2("content", 256).alias("source_file_sha256"))


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size of every entry; a file that is no archive has one entry without a name."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        out += [(p, i.filename, i.file_size) for i in z.infolist()]
                except zipfile.BadZipFile:
                    out.append((p, None, None))
            yield pd.DataFrame(out, columns=["path", "name", "size"])

    return files(spark, path).select("path", "content").mapInPandas(run, "path string, name string, size long")


def _child(parent: ET.Element, tag: str, first: bool = False) -> ET.Element:
    node = parent.find(W_ + tag)
    if node is None:
        node = ET.Element(W_ + tag)
        parent.insert(0, node) if first else parent.append(node)
    return node


def restyle(content: bytes, styles: dict[int, dict], geometry: dict[str, float] | None = None) -> bytes:
    """The document with the styles of its elements by position; texts stay as they are."""
    cm = lambda x: str(round(x / 2.54 * 1440))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    for event, (prefix, uri) in ET.iterparse(io.BytesIO(parts["word/document.xml"]), events=["start-ns"]):
        ET.register_namespace(prefix, uri)
    root = ET.fromstring(parts["word/document.xml"])
    body = root.find(W_ + "body")
    for idx, b in enumerate(blocks(body)):
        style = styles.get(idx)
        if style is None:
            continue
        for k, row in enumerate(b.findall(W_ + "tr") if b.tag == W_ + "tbl" else [b]):
            for p in [row] if row is b else row.iter(W_ + "p"):
                props = _child(p, "pPr", first=True)
                jc = {"justified": "both"}.get(style["alignment"], style["alignment"])
                _child(props, "spacing").attrib.update({W_ + "line": str(round(style["line_spacing"] * 240)), W_ + "lineRule": "auto", W_ + "before": "0", W_ + "after": "0"})
                ind = _child(props, "ind")
                ind.attrib.clear()
                ind.set(W_ + "left", cm(style["left_indent_cm"]))
                first = style["first_line_indent_cm"]
                ind.set(W_ + ("hanging" if first < 0 else "firstLine"), cm(abs(first)))
                _child(props, "jc").set(W_ + "val", jc)
                for flag, tag in (("page_break_before", "pageBreakBefore"), ("keep_with_next", "keepNext")):
                    if style[flag]:
                        _child(props, tag)
                for r in p.iter(W_ + "r"):
                    rp = _child(r, "rPr", first=True)
                    _child(rp, "rFonts").attrib.update({W_ + "ascii": style["font"], W_ + "hAnsi": style["font"]})
                    _child(rp, "sz").set(W_ + "val", str(round(style["font_size_pt"] * 2)))
                    if style["element_type"] != "paragraph":
                        _child(rp, "b").set(W_ + "val", "1" if (k == 0 if b.tag == W_ + "tbl" else style["bold"]) else "0")
                        _child(rp, "i").set(W_ + "val", "1" if style["italic"] else "0")
    if geometry:
        for mar in root.iter(W_ + "pgMar"):
            for side in ("top", "bottom", "left", "right"):
                mar.set(W_ + side, cm(geometry[f"{side}_margin_cm"]))
    parts["word/document.xml"] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in parts.items():
            z.writestr(n, data)
    return out.getvalue()


def restyled(documents: DataFrame, styles: DataFrame, geometry: dict[str, float] | None = None) -> DataFrame:
    """doc_id, path, content of the restyled documents. documents: doc_id, path, content; styles: as the formatter gives them."""
    style = F.struct("idx", "element_type", "font", "font_size_pt", "alignment", "line_spacing", "first_line_indent_cm", "left_indent_cm", "bold", "italic", "page_break_before", "keep_with_next")
    rows = documents.join(styles.groupBy("doc_id").agg(F.collect_list(style).alias("styles")), "doc_id", "left")  # bounded by a document

    def run(batches):
        for pdf in batches:
            made = [restyle(bytes(c), {s["idx"]: (s if isinstance(s, dict) else s.asDict()) for s in (x if x is not None else [])}, geometry) for c, x in zip(pdf["content"], pdf["styles"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "path": pdf["path"], "content": made})

    return rows.select("doc_id", "path", "content", "styles").mapInPandas(run, "doc_id long, path string, content binary")
