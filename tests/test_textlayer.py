"""Pages with a text layer, as rows of spans, words, images and rules."""

import numpy as np
import pytest

from pagespark.operators import textlayer

SPAN = "book string, page string, block int, line int, ord int, text string, font string, size double, bold boolean, base double, x1 double, y1 double, x2 double, y2 double"
BOX = "x1 double, y1 double, x2 double, y2 double"


def span(block, line, ord, text, font="Times", size=10.0, bold=False, base=None, x=50.0, y=100.0, w=400.0, page="p"):
    return ("b", page, block, line, ord, text, font, float(size), bold, float(base if base is not None else y + size), float(x), float(y), float(x + w), float(y + size))


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), SPAN)


def boxes(spark, *rows, extra=""):
    return spark.createDataFrame(list(rows), f"book string, page string, {extra}{BOX}")


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([("b", "p", 0, 600.0, 800.0, 0), ("b", "q", 1, 600.0, 800.0, 90), ("b", "r", 2, 600.0, 800.0, 0), ("b", "s", 3, 600.0, 800.0, None)], "book string, page string, idx int, width double, height double, rotation int")


def test_layer_status(spark, pages):
    words = boxes(spark, ("b", "p", 1.0, 1.0, 2.0, 2.0), ("b", "q", 1.0, 1.0, 2.0, 2.0), ("b", "s", 1.0, 1.0, 2.0, 2.0))
    images = boxes(spark, ("b", "s", 0.0, 0.0, 600.0, 300.0), ("b", "s", 0.0, 300.0, 600.0, 420.0))
    got = {r.page: r.status for r in textlayer.layer_status(pages, words, images).collect()}
    assert got == {"p": "layer", "q": "vision", "r": "blank", "s": "vision"}
    assert textlayer.layer_status(pages.limit(0), words, images).count() == 0


def test_columns_and_verdict(spark, pages):
    two = [span(0, i, 0, "text", x=50, y=100 + 12 * i, w=200) for i in range(8)] + [span(1, i, 0, "text", x=320, y=100 + 12 * i, w=200) for i in range(8)]
    cells = [span(0, i, 0, "t", x=50, y=100 + 12 * i, w=200, page="r") for i in range(8)] + [span(1, i, 0, "5", x=320, y=100 + 12 * i, w=20, page="r") for i in range(8)]
    cols = textlayer.column_count(pages, spans(spark, *two, *cells), boxes(spark))
    assert {r.page: r.columns for r in cols.collect()} == {"p": 2, "q": 1, "r": 1, "s": 1}
    none = textlayer.column_count(pages, spans(spark, *two), boxes(spark, ("b", "p", 300.0, 90.0, 560.0, 300.0)))
    assert {r.columns for r in none.collect()} == {1}
    status = spark.createDataFrame([("b", p, s) for p, s in (("p", "layer"), ("q", "layer"), ("r", "layer"), ("s", "blank"))], "book string, page string, status string")
    assert textlayer.born_digital(pages, status, none, 4).first().digital is True
    assert textlayer.born_digital(pages, status, cols, 4).first().digital is False
    assert textlayer.born_digital(pages, status.where("page <> 'p'").unionByName(spark.createDataFrame([("b", "p", "vision")], status.schema)), none, 4).first().digital is False


def test_roles_and_blocks(spark, pages):
    rows = [
        span(0, 0, 0, "Heading of it", font="Bold", size=12, y=200), span(1, 0, 0, "Body text with H", y=230), span(1, 0, 1, "2", size=6, base=243.0, y=236), span(1, 0, 2, "O and x", y=230), span(1, 0, 3, "3", size=6, base=234.0, y=228),
        span(1, 1, 0, "goes on for long enough to be the body of the page.", y=242), span(2, 0, 0, "Great title", font="Bold", size=15, y=20), span(3, 0, 0, "* a note", size=7, y=700), span(4, 0, 0, "Table 5 of it", y=400), span(5, 0, 0, "in a table", y=500, w=100), span(6, 0, 0, " ", y=600),
    ]
    df = spans(spark, *rows)
    roles = textlayer.font_roles(df)
    assert {(r.font, r.size): r.role for r in roles.collect()} == {("Times", 10.0): "body", ("Bold", 12.0): "heading", ("Bold", 15.0): "heading", ("Times", 6.0): "small", ("Times", 7.0): "small"}
    got = textlayer.text_blocks(pages, df, roles, boxes(spark, ("b", "p", 40.0, 490.0, 300.0, 560.0)), 144).orderBy("place").collect()
    assert [(r.category, r.text) for r in got] == [
        ("Title", "Great title"), ("Section-header", "Heading of it"), ("Text", "Body text with H<sub>2</sub>O and x<sup>3</sup>\ngoes on for long enough to be the body of the page."), ("Caption", "Table 5 of it"), ("Footnote", "* a note"),
    ]
    assert tuple(got[0].bbox) == (100, 40, 900, 70)


def test_gaps(spark):
    words = boxes(spark, ("b", "p", 0.0, 0.0, 10.0, 10.0), ("b", "p", 12.0, 0.0, 20.0, 10.0), ("b", "p", 40.0, 0.0, 50.0, 10.0), ("b", "p", 0.0, 30.0, 10.0, 40.0))
    space = spark.createDataFrame([("b", 10.0)], "book string, body_size double")
    assert [(r.page, r.gaps) for r in textlayer.suspect_gaps(words, space).collect()] == [("p", 1)]


def test_ruled_table(spark):
    """Three columns and two rows; the last two cells of the second row are one."""
    x, y = [10.0, 110.0, 210.0, 310.0], [10.0, 40.0, 70.0]
    lines = [("b", "p", 1, a, y[0], a, y[2]) for a in (x[0], x[1], x[3])] + [("b", "p", 1, x[2], y[0], x[2], y[1])] + [("b", "p", 1, x[0], b, x[3], b) for b in y]
    rules = boxes(spark, *lines, extra="region long, ")
    cells = textlayer.rule_cells(rules)
    assert sorted((r.row, r.col, r.colspan) for r in cells.collect()) == [(0, 0, 1), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, 2)]
    text = spans(spark, span(0, 0, 0, "a", x=20, y=20, w=20), span(0, 1, 0, "b<c", x=120, y=20, w=20), span(1, 0, 0, "one", x=20, y=45, w=30), span(1, 1, 0, "two", x=20, y=57, w=30, bold=True), span(2, 0, 0, "wide", x=200, y=50, w=40, font="Times-Bold"))
    words = boxes(spark, ("b", "p", 20.0, 45.0, 50.0, 55.0), ("b", "p", 80.0, 45.0, 90.0, 55.0))
    r = textlayer.ruled_tables(cells, text, textlayer.font_roles(text), words, 72).first()
    assert r.html == '<table><tr><th>a</th><th>b&lt;c</th><th></th></tr><tr><td>one<br>two</td><th colspan="2">wide</th></tr></table>'
    assert r.confidence == pytest.approx(1 - 0.6 / 6 - 0.25) and tuple(r.bbox) == (10, 10, 310, 70)
    assert textlayer.grid_cells(np.array([[0.0, 0.0, 0.0, 50.0]])) == [] and textlayer.rule_cells(rules.limit(0)).count() == 0
