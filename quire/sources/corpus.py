"""Synthetic training corpus: seeded documents of labelled elements, made by expressions over spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = "Distributed Systems,Network Consensus,Query Planning,Storage Engines,Language Models,Graph Analytics,Stream Processing,Data Provenance,Signal Recovery,Type Theory,Fluid Dynamics,Market Design".split(",")
PEOPLE = "Ada Lovelace,Alan Turing,Grace Hopper,Edgar Codd,Barbara Liskov,Leslie Lamport,Donald Knuth,Frances Allen".split(",")
SCHOOLS = "University of Paris,Institute of Technology,Faculty of Sciences,Department of Computing".split(",")
SENTENCES = [
    "The results that we obtained in the first series of runs were confirmed by a second group of observers.",
    "It was clear that the proposed method would be of use to those who work with larger collections.",
    "In this section we describe how each of the parts interacts with the others over the course of a day.",
    "There are several reasons for this, and most of them have been discussed by the authors before.",
    "When the load is higher than expected, the system moves some of its work to the nodes that are idle.",
    "We then compare both approaches and show that neither is better in all of the cases that matter.",
]
HEADINGS = "Background,Related Work,Problem Statement,Evaluation Method,Experimental Results,Open Questions".split(",")
SUBHEADINGS = "Assumptions and Scope,Data Collection,Error Analysis,Threats to Validity,Parameter Choice".split(",")
WORDS = "One Two Three Four Five Six Seven".split()


def _pick(options: list[str], *salt: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), F.pmod(F.xxhash64(*salt), F.lit(len(options))).cast("int"))


def synthetic_corpus(spark: SparkSession, documents: int = 50, seed: int = 42) -> DataFrame:
    """Elements with `label`: title, author, 3 to 7 chapters of bodies, headings, tables, figures, captions and lists, references."""
    doc, s = F.col("doc_id"), F.lit(seed)
    dice = lambda *salt: F.pmod(F.xxhash64(s, doc, *salt), F.lit(100))
    el = lambda label, kind, text, style, bold, size, listed=False: F.struct(F.lit(label).alias("label"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(style).cast("string").alias("style"), F.lit(bold).alias("bold"), F.lit(float(size)).alias("size"), F.lit(listed).alias("listed"))
    body = lambda *salt: F.concat_ws(" ", *[_pick(SENTENCES, s, doc, F.lit(j), *salt) for j in range(3)])

    def when(cond: Column, *items: Column) -> Column:
        return F.when(cond, F.array(*items)).otherwise(F.slice(F.array(*items), 1, 0))

    def chapter(c: Column) -> Column:
        number = c.cast("string")
        styled = F.when(dice(c, F.lit("st")) < 50, F.concat(F.lit("Chapter "), number, F.lit(": "), _pick(TOPICS, s, doc, c))).otherwise(F.concat(F.lit("CHAPTER "), F.upper(F.get(F.array(*[F.lit(w) for w in WORDS]), c - 1))))
        n_body = 2 + F.pmod(F.xxhash64(s, doc, c, F.lit("nb")), F.lit(3))
        n_list = 2 + F.pmod(F.xxhash64(s, doc, c, F.lit("nl")), F.lit(3))
        bodies = F.transform(F.sequence(F.lit(1), n_body.cast("int")), lambda i: el("paragraph", "paragraph", body(c, i), "Normal", False, 11))
        items = F.transform(F.sequence(F.lit(1), n_list.cast("int")), lambda i: el("list", "paragraph", F.concat(F.lit("• "), _pick(SUBHEADINGS, s, doc, c, i, F.lit("li")), F.lit(" of the "), F.lower(_pick(TOPICS, s, doc, c, i))), "List Bullet", False, 11, True))
        return F.concat(
            F.array(el("chapter", "paragraph", styled, "Heading 1", True, 18)),
            bodies,
            F.array(el("heading", "paragraph", F.concat(number, F.lit(". "), _pick(HEADINGS, s, doc, c)), "Heading 2", True, 14), el("paragraph", "paragraph", body(c, F.lit("b1")), "Normal", False, 11)),
            F.array(el("subheading", "paragraph", F.concat(number, F.lit(".1 "), _pick(SUBHEADINGS, s, doc, c)), "Heading 3", True, 12), el("paragraph", "paragraph", body(c, F.lit("b2")), "Normal", False, 11)),
            when(dice(c, F.lit("tb")) < 60, el("table", "table", F.concat(F.lit("Node\tRate\nn1\t"), number), None, False, 10), el("caption", "paragraph", F.concat(F.lit("Table "), number, F.lit(".1: "), _pick(HEADINGS, s, doc, c, F.lit("tc"))), "Caption", False, 10)),
            when(dice(c, F.lit("fg")) < 60, el("figure", "figure", F.lit(""), None, False, 11), el("caption", "paragraph", F.concat(F.lit("Figure "), number, F.lit(".1: "), _pick(HEADINGS, s, doc, c, F.lit("fc"))), "Caption", False, 10)),
            F.when(dice(c, F.lit("ls")) < 70, items).otherwise(F.slice(items, 1, 0)),
        )

    n_chapters = (3 + F.pmod(F.xxhash64(s, doc, F.lit("nc")), F.lit(5))).cast("int")
    n_refs = (3 + F.pmod(F.xxhash64(s, doc, F.lit("nr")), F.lit(4))).cast("int")
    year = lambda i: (1950 + F.pmod(F.xxhash64(s, doc, i, F.lit("yr")), F.lit(70))).cast("string")
    front = F.array(
        el("title", "paragraph", F.concat(F.lit("The Architecture of "), _pick(TOPICS, s, doc)), "Title", True, 20),
        el("author", "paragraph", F.concat(F.lit("Dr. "), _pick(PEOPLE, s, doc), F.lit(", "), _pick(SCHOOLS, s, doc)), "Subtitle", False, 12),
    )
    back = F.concat(
        F.array(el("heading", "paragraph", F.lit("References"), "Heading 2", True, 14)),
        F.transform(F.sequence(F.lit(1), n_refs), lambda i: el("reference", "paragraph", F.concat(F.lit("["), i.cast("string"), F.lit("] "), _pick(PEOPLE, s, doc, i), F.lit(" ("), year(i), F.lit("). "), _pick(TOPICS, s, doc, i, F.lit("rt")), F.lit(".")), "Normal", False, 10)),
    )
    rows = spark.range(documents).withColumnRenamed("id", "doc_id").withColumn("chapters", F.flatten(F.transform(F.sequence(F.lit(1), n_chapters), chapter)))
    rows = rows.select("doc_id", F.posexplode(F.concat(front, F.col("chapters"), back)).alias("idx", "e"))
    none = F.lit(None)
    run = F.struct(F.col("e.text").alias("text"), F.col("e.bold").alias("bold"), none.cast("boolean").alias("italic"), none.cast("boolean").alias("underline"), none.cast("string").alias("font_name"), F.col("e.size").alias("font_size_pt"), none.cast("boolean").alias("superscript"), none.cast("boolean").alias("subscript"))
    listed = F.when(F.col("e.listed"), F.struct(F.lit(1).alias("num_id"), F.lit(0).alias("ilvl"), F.lit(True).alias("is_bullet"), F.lit(False).alias("is_numbered")))
    return rows.select("doc_id", "idx", F.col("e.label").alias("label"), F.col("e.kind").alias("kind"), F.col("e.text").alias("text"), F.col("e.style").alias("style"), F.array(run).alias("runs"), listed.alias("list_info"), F.lit(False).alias("contains_drawing"), F.lit(0).alias("rows_count"), F.lit(0).alias("cols_count"))
