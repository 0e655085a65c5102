from pyspark.sql import functions as F

from pagespark.functions import notes
from pagespark.sources import layouts


def rows(df):
    return [(r.ord, r.category, r.text, tuple(r.bbox) if r.bbox else None) for r in df.orderBy("k", "ord").collect()]


def frame(spark, *raws):
    return spark.createDataFrame([(i, r, 1000, 500) for i, r in enumerate(raws)], "k long, raw string, width int, height int")


def test_json_cells(spark):
    full = '[{"bbox": [0, 0, 20, 10], "category": "Title", "text": "A"}, {"bbox": [5, 5, 5, 9], "category": "Odd", "text": null}]'
    assert rows(layouts.json_cells(frame(spark, full), ["k"], 2.0, 3.0)) == [(0, "Title", "A", (0, 0, 40, 30)), (1, "Text", "", None)]
    assert rows(layouts.json_cells(frame(spark, '{"bbox": [1, 1, 2, 2], "category": "Text", "text": "x"}'), ["k"])) == [(0, "Text", "x", (1, 1, 2, 2))]
    assert rows(layouts.json_cells(frame(spark, '{"cells": [{"category": "Table", "text": "t"}]}'), ["k"])) == [(0, "Table", "t", None)]
    cut = '[{"bbox": [0, 0, 9, 9], "category": "Text", "text": "a"}, {"bbox": [0, 0'
    assert rows(layouts.json_cells(frame(spark, cut), ["k"])) == [(0, "Text", "a", (0, 0, 9, 9))]
    assert rows(layouts.json_cells(frame(spark, "no json at all", None), ["k"])) == [(0, "Text", "no json at all", None)]


def test_grounded(spark):
    raw = "<|ref|>title<|/ref|><|det|>[[0, 0, 999, 99]]<|/det|>\nHead\n<|ref|>image<|/ref|><|det|>broken<|/det|>zz<|ref|>new<|/ref|><|det|>[[1,2,3]]<|/det|> body <|end|>"
    assert rows(layouts.grounded(frame(spark, raw), ["k"])) == [(0, "Title", "Head", (0, 0, 1000, 50)), (1, "Picture", "", None), (2, "Text", "body", None)]
    assert rows(layouts.grounded(frame(spark, "plain <|end|>", " "), ["k"])) == [(0, "Text", "plain", None)]


def test_labelled_html(spark):
    raw = '<div data-label="Section-Header" data-bbox="0 0 500 100"><h2>A &amp; B</h2></div>\n<div data-label="Table" data-bbox="x"><div><table><tr><td>1</td></tr></table></div></div><div data-label="Image" data-bbox="0 0 10 10"><img alt="q"></div><div data-label="Blank-Page"></div>'
    assert rows(layouts.labelled_html(frame(spark, raw), ["k"])) == [(0, "Section-header", "A & B", (0, 0, 500, 50)), (1, "Table", "<table><tr><td>1</td></tr></table>", None), (2, "Picture", "", (0, 0, 10, 5))]
    assert rows(layouts.labelled_html(frame(spark, "<p>only text</p>", None), ["k"])) == [(0, "Text", "only text", None)]


def test_label_list(spark):
    df = spark.createDataFrame([(0, 0, "doc_title", [1.0, 2.0, 30.0, 40.0], "T", 100, 100), (0, 1, "chart", [1.0], "c", 100, 100), (0, 2, None, None, None, 100, 100)], "k long, ord int, label string, bbox array<double>, content string, width int, height int")
    assert rows(layouts.label_list(df, ["k"])) == [(0, "Title", "T", (1, 2, 30, 40)), (1, "Picture", "", None), (2, "Text", "", None)]


def test_notes(spark):
    md = "# One [x]\n<!-- page: 12 scan: 0006 -->\n## Two, two\n```\n# not\n```\n<!-- page: ? scan: 0007 -->\n## Three\n### deep"
    t = notes.toc(spark.createDataFrame([("b", md)], "book string, md string"))
    assert [(r.level, r.title, r.slug, r.printed) for r in t.orderBy("line_no").collect()] == [(1, "One [x]", "one-x", None), (2, "Two, two", "two-two", "12"), (2, "Three", "three", None)]
    assert notes.contents_note(t).first().note == "## Contents\n\n- [One \\[x\\]](book.md#one-x)\n- [Two, two](book.md#two-two) — p. 12\n- [Three](book.md#three)\n"
    df = spark.createDataFrame([('say "a"', None, 1956, ["ru"], 10, "d", ["k", " "])], "t string, a string, y int, l array<string>, p int, d string, k array<string>")
    fm = df.select(notes.front_matter(*[F.col(c) for c in ("t", "a", "y", "l", "p", "d", "k")]).alias("x")).first().x
    assert fm == '---\ntitle: "say \\"a\\""\nauthor:\nyear: 1956\nlang: [ru]\npages: 10\ntags: []\ntype: book-source\ndescription: "d"\nkeywords: ["k"]\n---\n\n'
    s = spark.createDataFrame([('{"description": " D ", "keywords": ["a", ""]}',), ('Sure: {"description": "E"} ok',), ("plain words",)], "r string")
    got = [(r.x.description, list(r.x.keywords), r.x.parsed) for r in s.select(notes.summary(F.col("r")).alias("x")).collect()]
    assert got == [("D", ["a"], True), ("E", [], True), ("plain words", [], False)]
