"""Passes over answers, footnotes, images and figures, on literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagespark.functions import notes, pixels, sketches
from pagespark.operators import books, consensus, evaluate, geometry, pages, tablediff, vocabulary

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def test_sanitized_answers(spark):
    fix = "array<struct<was:string,now:string>>"
    rows = [
        (1, "C + 1/3 Si, сталь", "C + 1/3 Si, сталь", "C + 1/8 Si, стали", [("1/3", "1/8"), ("сталь", "стали")]), (2, "t 1/3", None, "t 1/8 and 1/8", [("1/3", "1/8")]), (3, "a 0,15", None, "a ,15", [("0,15", ",15")]),
        (4, "x", "y", "1/8", [("1/3", "1/8")]), (5, None, None, None, [("a", "b")]), (6, "a", None, "a", []),
    ]
    df = spark.createDataFrame(rows, f"id long, text_a string, text_b string, answer string, fixes {fix}")
    got = {r.id: (r.text, [f.now for f in r.kept], [f.reason for f in r.rejected]) for r in consensus.sanitized(df).collect()}
    assert got == {
        1: ("C + 1/3 Si, стали", ["стали"], ["changes digits"]), 2: ("t 1/8 and 1/8", [], ["changes digits"]),  # two places, one correction: which one is meant is unknown
        4: ("1/8", [], ["changes digits"]),
    }
    one = spark.createDataFrame([([("a", "b"), ("c", "c"), ("5–6", "5-6"), ("q", "b")], ["x a 5–6"], "b 5-6", "arbiter")], f"f {fix}, d array<string>, t string, s string")
    assert [f.was for f in one.select(consensus.worth_reporting(F.col("f"), F.col("d"), F.col("t"), F.col("s")).alias("x")).first().x] == ["a"]


@pytest.mark.parametrize(
    "text, mark, at",
    [
        ("слово* и", "*", 5), ("слово ** и", "*", None), ("слово *, и", "*", 6), ("слово * и", "*", None), ("конец *", "*", 6), ("* первое", "*", None), ("объём, м² и плёнка²", "²", 18), ("10² раз", "²", None), ("сталь ¹", "¹", 5),
        ("слово1) и", "1)", 5), ("11) и", "1)", None), ("", "*", None),
    ],
)
def test_reference(text, mark, at):
    assert pages.reference(text, mark) == at


def test_linked_footnotes(spark):
    rows = [
        ("b", "p0", 0, 0, 1, "Text", "Сталь* мягкая и чугун**"), ("b", "p0", 0, 1, 2, "Footnote", "* первая"), ("b", "p0", 0, 2, 3, "Footnote", "** вторая"), ("b", "p0", 0, 3, 4, "Footnote", "*** без ссылки"),
        ("b", "p1", 1, 0, 5, "Text", "Вал¹."), ("b", "p1", 1, 1, 6, "Footnote", "¹ третья"), ("c", "p0", 0, 0, 7, "Text", None),
    ]
    df = spark.createDataFrame(rows, "book string, page string, idx int, ord int, id long, category string, txt string")
    got = {r.id: (r.number, r.text) for r in pages.linked_footnotes(df).collect()}
    assert got == {1: (None, "Сталь[^1] мягкая и чугун[^2]"), 2: (1, "[^1]: первая"), 3: (2, "[^2]: вторая"), 5: (None, "Вал[^3]."), 6: (3, "[^3]: третья")}


def test_spelling(spark):
    b = spark.createDataFrame([(1, "b", "p0", 0, "стaль сталь ГОСТ ab $zzz$ <q>"), (2, "b", "p1", 0, "шов шов стaль"), (3, "b", "p1", 1, None)], "id long, book string, page string, ord int, txt string")
    ps = spark.createDataFrame([("b", "p0", 1), ("b", "p1", 0)], "book string, name string, idx int")
    got = [(r.word, r.n, r.pages, r["rank"]) for r in vocabulary.spelling(b, ps, spark.createDataFrame([("сталь",), ("стaль",)], "word string")).orderBy("rank").collect()]
    assert got == [("шов", 2, "p1", 1), ("стaль", 2, "p1, p0", 2)]


def test_images():
    img = np.full((200, 300), 255, np.uint8)
    for y in range(20, 180, 20):
        img[y : y + 8, 30:270] = 0
    tilted = pixels.turned(img, 2.0)
    level, angle = pixels.deskewed(tilted)
    assert abs(abs(angle) - 2.0) <= 0.2 and abs(pixels.skew(level)) <= 0.25  # half a pixel over the half of the width
    assert pixels.deskewed(img)[1] == 0.0 and (pixels.turned(img, 0.0) == img).all()
    assert pixels.padded((5, 5, 290, 190), 300, 200, 12) == (0, 0, 300, 200)
    crop = pixels.block_crop(img, (30, 20, 270, 68), pad=0, least_line=16, masks=((30, 40, 270, 68),))
    assert crop.shape == (96, 480) and (crop[40:] == 255).all() and crop[:16].max() == 0
    assert pixels.block_crop(img, None) is img and pixels.block_crop(img, (30, 20, 270, 68), pad=0, pixels=100).size <= 120


def test_figures(spark):
    box = lambda *b: dict(zip(("x1", "y1", "x2", "y2"), b))
    make = lambda rows: spark.createDataFrame([("b", "p", i, box(*b)) for i, b in rows], f"book string, page string, id long, bbox {BOX}")
    pred = make([(1, (0, 0, 100, 100)), (2, (200, 200, 300, 300)), (3, (500, 500, 510, 510))])
    r = geometry.figure_counts(pred, make([(11, (200, 200, 300, 310)), (12, (900, 900, 950, 950))]), make([(21, (0, 0, 100, 90))])).first()
    assert (r.inside_hit, r.inside_gold, r.hit, r.predicted, r.gold) == (1, 1, 1, 2, 2)
    tall = pred.withColumn("height", F.lit(1000))
    assert sorted(x.id for x in geometry.figures_only(tall).collect()) == [1, 2]
    grown = pred.select(geometry.pad(F.col("bbox"), 5, F.lit(505), F.lit(1000)).alias("b")).collect()
    assert tuple(grown[0].b) == (0, 0, 105, 105) and grown[2].b.x2 == 505


def test_reports(spark):
    s = spark.createDataFrame([("c", "m", 0.5, None), ("c", "n", 0.5, 0.25), ("c", "o", None, 0.0)], "category string, book string, up double, down double")
    assert evaluate.comparison_report(s, "category", "book", "up", "down").first().report.split("\n")[2:] == ["| n | 0.5000 | 0.2500 |", "| m | 0.5000 | — |", "| o | — | 0.0000 |"]


TABLE = "<table><tr><td>a<img></td><td>b<img/></td></tr></table>"


@pytest.mark.parametrize(
    "markup, paths, other, html, rest, note",
    [
        (TABLE, ["1.webp", "2.webp"], None, '<table><tr><td>a<img src="1.webp"/></td><td>b<img src="2.webp"/></td></tr></table>', [], None),
        ('<table><tr><td><img n="2"><img n=1></td><td><img n="2"></td></tr></table>', ["x", "y"], None, '<table><tr><td><img src="y"/><img src="x"/></td><td></td></tr></table>', [], None),
        ('<table><tr><td><img n="3"></td></tr></table>', ["x"], None, "<table><tr><td></td></tr></table>", ["x"], "1 sketches, 0 placed by arbiter: the rest appended after the table"),
        (TABLE, [], None, "<table><tr><td>a</td><td>b</td></tr></table>", [], "0 sketches, 2 <img> slots: empty <img> removed"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", ["p"], "<table><tr><td>q</td><td>r<img></td></tr></table>", '<table><tr><td>a</td><td>b<img src="p"/></td></tr></table>', [], None),
        ("<table><tr><td>Fig. 1</td><td>x<br>Fig. 2a</td></tr></table>", ["p", "q"], None, '<table><tr><td><img src="p"/><br/>Fig. 1</td><td>x<br><img src="q"/><br/>Fig. 2a</td></tr></table>', [], None),
        ("<table><tr><td><img></td></tr></table>t<table></table>", ["p", "q"], None, '<table><tr><td><img src="p"/></td></tr></table>t<table></table>', ["q"], "2 sketches, 1 <img> slots: extra sketches appended after tables"),
        ("no table <img>", ["p"], None, "no table ", ["p"], "table not parsed, sketches placed after it"),
        ('<table><tr><td><img src="kept.png"></td></tr></table>', [], None, '<table><tr><td><img src="kept.png"></td></tr></table>', [], None),
        ("<table><tr><td>a</td></tr></table>", ["p"], None, "<table><tr><td>a</td></tr></table>", ["p"], "1 sketches, 0 <img> slots: sketches placed after the table"),
    ],
)
def test_sketches(markup, paths, other, html, rest, note):
    assert sketches.place(markup, paths, other) == (html, rest, note)


def test_sketch_columns(spark):
    df = spark.createDataFrame([(TABLE, ["1", "2"], None), (None, ["1"], None), (TABLE, None, None)], "m string, s array<string>, o string")
    got = [(r.x.html is None, list(r.x.rest)) for r in df.select(sketches.placed("m", "s", "o").alias("x")).collect()]
    assert got == [(False, []), (True, ["1"]), (False, [])]


def test_book_texts(spark):
    md = "---\ntitle: x\n---\n\n# T\n<!-- page: 1 scan: 001 -->\nСталь 12 и сталь 45.\n<!-- page: ? scan: 002 -->\nЧугун 12 и дальше.\n<!-- page: 3 scan: 003 -->\nКонец."
    df = spark.createDataFrame([("b", md), ("c", "no anchors"), ("d", None)], "book string, md string")
    got = [(r.book, r.scan, md[r.start : r.start + len(r.text)] == r.text) for r in books.sections(df).orderBy("nth").collect()]
    assert got == [("b", "001", True), ("b", "002", True), ("b", "003", True)]
    rows = [("1", "b", "001", "сталь", None, None), ("2", "b", "001", "Чугун", None, None), ("3", "b", "001", "12", None, None), ("4", "b", "002", "сталь", None, None), ("5", "b", "001", "и", None, " сталь"), ("6", "z", "001", "и", None, None)]
    fixes = spark.createDataFrame(rows, "id string, book string, scan string, token string, before string, after string")
    at = {r.id: r for r in books.located_in_books(fixes, df).collect()}
    assert {i: r.status for i, r in at.items()} == {"1": "token", "2": "token", "3": "token", "4": "absent", "5": "exact", "6": "absent"}
    assert all(md[at[i].offset :].startswith(t) for i, t in (("1", "сталь"), ("2", "Чугун"), ("3", "12"), ("5", "и сталь"))) and at["2"].before == "\n" and at["1"].after == " 45.\n"
    one = df.where("book = 'b'").select(notes.without_front_matter(F.col("md")).alias("x")).first().x
    assert one.startswith("# T")


def test_small_texts(spark):
    df = spark.createDataFrame([("```markdown\n# A (1, 2), (3, 4)\ntext\n```", 45.4, "book"), ("  ", 3540.0, "x"), ("a", 7500.0, "quality"), ("b", 200000.0, None), ("c", None, "y")], "raw string, s double, b string")
    rows = df.select(notes.cleaned_markdown(F.col("raw")).alias("m"), notes.duration(F.col("s")).alias("d"), notes.contents_name(F.col("b")).alias("n"), notes.candidate_name(F.col("b"), F.lit("pdf"), F.lit(7)).alias("c")).collect()
    assert [r.m for r in rows] == ["# A\ntext\n", "", "a\n", "b\n", "c\n"] and [r.d for r in rows] == ["45s", "59m", "2h05m", "2d 7h", "—"]
    assert [r.n for r in rows] == ["book-contents", "x", "quality-contents", None, "y"] and rows[0].c == "book_pdf_0007.jpg"
    t = spark.createDataFrame([("<table><tr><td>a<sub>1</sub></td> <td>b<br>c</td></tr><tr><th>d</th></tr></table>",)], "t string")
    assert t.select(notes.readable_table(F.col("t")).alias("x")).first().x == "a<sub>1</sub> │ b c\nd\n"
    b = spark.createDataFrame([(1, "b", "p", 0, "Picture", None), (2, "b", "p", 1, "Caption", " Fig. [1]\nmore"), (3, "b", "p", 2, "Picture", None), (4, "b", "p", 3, "Text", "x"), (5, "b", "q", 0, "Picture", None)], "id long, book string, page string, ord int, category string, txt string")
    assert {r.id: r.alt for r in books.alt_texts(b).collect()} == {1: "Fig. 1", 3: "Fig. 1", 5: ""}
    assert df.select(notes.page_anchor(F.lit(None).cast("string"), F.lit("001")).alias("x")).first().x == "<!-- page: ? scan: 001 -->"


def test_row_sets(spark):
    a, b = (spark.createDataFrame(rows, "k string, v int") for rows in ([("x", 1), (None, 2), ("x", 3)], [("y", 4), ("x", 5)]))
    assert sorted(r.k or "" for r in tablediff.united([a, b], ["k"]).collect()) == ["", "x", "y"]
    assert tablediff.is_subset(b.where("k = 'x'"), a, ["k"]) and not tablediff.is_subset(b, a, ["k"]) and tablediff.is_subset(a.limit(0), b, ["k"])
    assert [(r.v, r.place) for r in tablediff.appended([a, b], ["v"]).orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
