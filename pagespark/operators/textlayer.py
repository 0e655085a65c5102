"""Pages that carry their own text: verdict on the layer, font roles, blocks, tables from rules.

A decoder outside the engine gives rows: pages (book, page, width, height, rotation), spans (book, page, block, line,
ord, text, font, size, bold, base, box), words, images and rules (each with book, page and a box of x1, y1, x2, y2 in
points; rules with the region they were drawn in).  Everything else is relations on these rows; only the grid of one
ruled region is a grouped map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

PAGE = ["book", "page"]
# What makes a layer good, a second column, a heading, small print, a raised sign, a lost glyph (points and shares).
LAYER_SHARE, COLUMN_SHARE, IMAGE_COVER = 0.7, 0.3, 0.5
COLUMN_GAP, COLUMN_LINES, COLUMN_WIDTH = 100.0, 5, 60.0
HEADING, TITLE, SMALL = 1.0, 4.0, 1.5
RAISED, GAP_SPACES, SPACE = 0.75, 3.0, 0.27
CAPTION = r"^\s*(?:Fig\.|Table\s)\s*\S"


def meets(a: str, b: str) -> Column:
    """Do the boxes of two aliased sides share an area?"""
    c = lambda s, n: F.col(f"{s}.{n}")
    return (c(a, "x1") < c(b, "x2")) & (c(b, "x1") < c(a, "x2")) & (c(a, "y1") < c(b, "y2")) & (c(b, "y1") < c(a, "y2"))


def layer_status(pages: DataFrame, words: DataFrame, images: DataFrame) -> DataFrame:
    """(book, page, status): layer, vision (a turned page, or one covered by pictures) or blank."""
    n = words.groupBy(*PAGE).agg(F.count("*").alias("n"))
    cover = images.groupBy(*PAGE).agg(F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("cover"))
    rows = pages.join(n, PAGE, "left").join(cover, PAGE, "left")
    scanned = (F.coalesce("rotation", F.lit(0)) != 0) | (F.coalesce("cover", F.lit(0.0)) > IMAGE_COVER * F.col("width") * F.col("height"))
    return rows.select(*PAGE, F.when(scanned, "vision").when(F.col("n") > 0, "layer").otherwise("blank").alias("status"))


def text_lines(spans: DataFrame) -> DataFrame:
    """(book, page, block, line, box) of the lines that have text."""
    box = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    return spans.groupBy(*PAGE, "block", "line").agg(*box, F.count_if(F.trim("text") != "").alias("_n")).where("_n > 0").drop("_n")


def column_count(pages: DataFrame, spans: DataFrame, tables: DataFrame) -> DataFrame:
    """(book, page, columns): 2 if enough wide lines begin far right of the first quarter of line starts; tables don't count."""
    lines = text_lines(spans).alias("l")
    inside = lines.join(tables.alias("t"), (F.col("l.book") == F.col("t.book")) & (F.col("l.page") == F.col("t.page")) & meets("l", "t"), "left_anti")
    g = inside.groupBy(*PAGE).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("x1")).alias("starts"), F.collect_list(F.struct("x1", (F.col("x2") - F.col("x1")).alias("w"))).alias("all"))
    left = F.get("starts", F.floor(F.col("n") / 4).cast("int"))
    over = F.array_sort(F.transform(F.filter("all", lambda s: s["x1"] > left + COLUMN_GAP), lambda s: s["w"]))
    two = (F.col("n") >= 2 * COLUMN_LINES) & (F.size(over) >= COLUMN_LINES) & (F.get(over, F.floor(F.size(over) / 2).cast("int")) >= COLUMN_WIDTH)
    return pages.select(*PAGE).join(g.select(*PAGE, two.alias("_two")), PAGE, "left").select(*PAGE, F.when(F.col("_two"), 2).otherwise(1).alias("columns"))


def born_digital(pages: DataFrame, status: DataFrame, columns: DataFrame, n: int) -> DataFrame:
    """(book, digital): do enough of ``n`` pages spread over the book (by idx) have a layer, and few of those two columns?"""
    sample = files.even_sample(pages.select("book", F.col("page").alias("name"), "idx"), n).select("book", F.col("name").alias("page"))
    rows = sample.join(status, PAGE).join(columns, PAGE)
    layer = F.count_if(F.col("status") == "layer")
    multi = F.count_if((F.col("status") == "layer") & (F.col("columns") > 1))
    return rows.groupBy("book").agg(((layer >= LAYER_SHARE * F.count("*")) & (multi <= COLUMN_SHARE * F.greatest(layer, F.lit(1)))).alias("digital"))


def font_roles(spans: DataFrame) -> DataFrame:
    """(book, font, size, role): the font with most text is the body; larger ones of another face head, smaller ones are small print."""
    size = F.bround("size", 0)
    volume = spans.groupBy("book", "font", size.alias("size")).agg(F.sum(F.length("text")).alias("n"))
    body = volume.groupBy("book").agg(F.max_by(F.struct("font", "size"), F.struct("n", "font", "size")).alias("body"))
    role = F.when((F.col("font") == F.col("body.font")) & (F.col("size") == F.col("body.size")), "body")
    role = role.when((F.col("size") >= F.col("body.size") + HEADING) & (F.col("font") != F.col("body.font")), "heading").when(F.col("size") < F.col("body.size") - SMALL, "small")
    return volume.join(body, "book").select("book", "font", "size", role.otherwise("other").alias("role"), F.col("body.size").alias("body_size"))


def _marked(rows: DataFrame, keys: list[str], escape: bool) -> DataFrame:
    """(keys, line, top, text): lines put together, spans much smaller than the line's main size as sub- or superscripts."""
    kept = rows.where(F.trim("text") != "").withColumn("s", F.bround("size", 0))
    w = Window.partitionBy(*keys, "block", "line")
    sizes = kept.groupBy(*keys, "block", "line", "s").agg(F.count("*").alias("n"), F.mode(F.round("base", 1)).alias("main_base"), F.min("ord").alias("first"))
    main = sizes.groupBy(*keys, "block", "line").agg(F.max_by(F.struct(F.col("s").alias("main"), "main_base"), F.struct("n", -F.col("first"))).alias("m")).select(*keys, "block", "line", "m.*")
    plain = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) if escape else ():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    tag = F.when(F.col("base") > F.col("main_base"), "sub").otherwise("sup")
    part = F.when(F.col("size") < RAISED * F.col("main"), F.concat(F.lit("<"), tag, F.lit(">"), plain, F.lit("</"), tag, F.lit(">"))).otherwise(plain)
    lines = kept.join(main, [*keys, "block", "line"]).withColumn("top", F.min("y1").over(w))
    return lines.groupBy(*keys, "block", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), "").alias("text"), F.min("top").alias("top"))


def text_blocks(pages: DataFrame, spans: DataFrame, roles: DataFrame, tables: DataFrame, dpi: int = 300) -> DataFrame:
    """(book, page, place, category, text, box in pixels): the text blocks of every page outside its tables, in reading order."""
    box = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    boxes = spans.groupBy(*PAGE, "block").agg(*box).alias("b")
    w = F.least("b.x2", "t.x2") - F.greatest("b.x1", "t.x1")
    h = F.least("b.y2", "t.y2") - F.greatest("b.y1", "t.y1")
    most = w * h > 0.5 * (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))
    own = boxes.join(tables.alias("t"), (F.col("b.book") == F.col("t.book")) & (F.col("b.page") == F.col("t.page")) & meets("b", "t") & most, "left_anti")
    lines = _marked(spans, PAGE, False).groupBy(*PAGE, "block").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("text"))
    said = spans.where(F.trim("text") != "").withColumn("s", F.bround("size", 0))
    volume = said.groupBy(*PAGE, "block", "font", "s").agg(F.sum(F.length("text")).alias("n"))
    face = volume.groupBy(*PAGE, "block").agg(F.max_by(F.struct("font", F.col("s").alias("size")), F.struct("n", "font", "s")).alias("f")).select(*PAGE, "block", "f.*")
    first = said.groupBy(*PAGE, "block").agg(F.ltrim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "ord", "text"))), lambda x: x["text"]), " ")).alias("plain"))
    rows = own.join(lines, [*PAGE, "block"]).join(face, [*PAGE, "block"]).join(first, [*PAGE, "block"]).join(roles, ["book", "font", "size"], "left").join(pages.select(*PAGE, "height"), PAGE)
    large = (F.col("size") >= F.col("body_size") + TITLE) | (F.col("y1") < 0.1 * F.col("height"))
    category = F.when(F.col("plain").rlike(CAPTION), "Caption").when((F.col("role") == "heading") & large, "Title").when(F.col("role") == "heading", "Section-header")
    category = category.when((F.col("role") == "small") & (F.col("y1") > 0.8 * F.col("height")), "Footnote").otherwise("Text")
    px = lambda c: F.bround(F.col(c) * dpi / 72, 0).cast("int")
    out = rows.where("text <> ''").select(*PAGE, category.alias("category"), "text", F.struct(*[px(c).alias(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), "block")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("bbox.y1", "bbox.x1", "block"))).drop("block")


def suspect_gaps(words: DataFrame, space: DataFrame) -> DataFrame:
    """(book, page, gaps): lines with a gap of more than three spaces between words; ``space`` is (book, body_size)."""
    line = F.bround((F.col("y1") + F.col("y2")) / 6, 0)
    w = Window.partitionBy(*PAGE, "line").orderBy("x1", "x2")
    rows = words.withColumn("line", line).withColumn("gap", F.lead("x1").over(w) - F.col("x2")).join(space, "book")
    wide = rows.where((F.col("gap") > GAP_SPACES * SPACE * F.col("body_size")) & (F.col("body_size") > 0)).select(*PAGE, "line").distinct()
    return wide.groupBy(*PAGE).agg(F.count("*").alias("gaps"))


def grid_lines(at: np.ndarray, tol: float) -> np.ndarray:
    """Positions of the drawn lines: neighbours at most ``tol`` apart are one, halfway between."""
    out: list[float] = []
    for v in np.sort(at):
        if out and v - out[-1] <= tol:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(float(v))
    return np.array(out)


def grid_cells(lines: np.ndarray, tol: float = 3.0) -> list[tuple[int, int, int, float, float, float, float]]:
    """(row, first column, last column, box) of the cells that rules enclose.

    ``lines`` are thin boxes (x1, y1, x2, y2).  Which stretch of which grid line is drawn is two boolean tables; a cell
    runs along its row to the next drawn upright and needs a rule above and below.
    """
    w, h = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
    up, flat = lines[(w <= 2) & (h > 3)], lines[(h <= 2) & (w > 3)]
    xs, ys = grid_lines((up[:, 0] + up[:, 2]) / 2, tol), grid_lines((flat[:, 1] + flat[:, 3]) / 2, tol)
    if len(xs) < 2 or len(ys) < 2:
        return []
    near = np.abs((up[:, 0] + up[:, 2])[:, None] / 2 - xs) <= tol
    tall = (up[:, 1][:, None] <= ys[:-1] + 2 * tol) & (up[:, 3][:, None] >= ys[1:] - 2 * tol)
    upright = (near[:, :, None] & tall[:, None, :]).any(0)  # grid line x row
    out = []
    for j in range(len(ys) - 1):
        stops = [i for i in range(1, len(xs)) if upright[i, j] or i == len(xs) - 1]
        for a, b in zip([0, *stops[:-1]], stops):
            ruled = [((np.abs((flat[:, 1] + flat[:, 3]) / 2 - y) <= tol) & (flat[:, 0] <= xs[a] + tol) & (flat[:, 2] >= xs[b] - tol)).any() for y in ys[j : j + 2]]
            if all(ruled):
                out.append((j, a, b - 1, xs[a], ys[j], xs[b], ys[j + 1]))
    return out


def rule_cells(rules: DataFrame, tol: float = 3.0, least: int = 4) -> DataFrame:
    """(book, page, region, row, col, colspan, box) of the tables that rules draw; regions with fewer than ``least`` cells are none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = grid_cells(pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), tol)
        head = tuple(pdf[c].iloc[0] for c in ("book", "page", "region"))
        rows = [(*head, j, a, b - a + 1, *box) for j, a, b, *box in cells] if len(cells) >= least else []
        return pd.DataFrame(rows, columns=["book", "page", "region", "row", "col", "colspan", "x1", "y1", "x2", "y2"])

    return rules.groupBy("book", "page", "region").applyInPandas(run, "book string, page string, region long, row int, col int, colspan int, x1 double, y1 double, x2 double, y2 double")


def ruled_tables(cells: DataFrame, spans: DataFrame, roles: DataFrame, words: DataFrame, dpi: int = 300) -> DataFrame:
    """(book, page, region, html, confidence, box in pixels): tables of ruled cells filled from the layer.

    Confidence falls with empty cells and with gaps that look like lost glyphs.  A head cell is one of the first row or in bold.
    """
    keys = ["book", "page", "region", "row", "col"]
    c, s = cells.alias("c"), spans.alias("s")
    on = (F.col("c.book") == F.col("s.book")) & (F.col("c.page") == F.col("s.page")) & meets("c", "s")
    held = c.join(s, on).select("c.book", "c.page", "region", "row", "col", *[f"s.{x}" for x in ("block", "line", "ord", "text", "font", "size", "bold", "base", "y1")])
    texts = _marked(held, keys, True).groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "block", "line", "text"))), lambda x: x["text"]), "<br>")).alias("text"))
    bold = held.where(F.trim("text") != "").groupBy(*keys).agg(F.min_by(F.coalesce("bold", F.lit(False)) | F.lower("font").contains("bold"), F.struct("block", "line", "ord")).alias("bold"))
    small = roles.groupBy("book").agg(F.coalesce(F.min(F.when(F.col("role") == "small", F.col("size"))), F.max("body_size"), F.lit(9.0)).alias("cell_size"))
    wd = words.alias("w")
    inside = c.join(wd, (F.col("c.book") == F.col("w.book")) & (F.col("c.page") == F.col("w.page")) & meets("c", "w")).select("c.book", "c.page", "region", "row", "col", F.col("w.x1").alias("wx"), F.col("w.x2").alias("wz"))
    gap = F.lead("wx").over(Window.partitionBy(*keys).orderBy("wx", "wz")) - F.col("wz")
    gaps = inside.withColumn("gap", gap).join(small, "book").where(F.col("gap") > GAP_SPACES * SPACE * F.col("cell_size")).select(*keys).distinct().withColumn("gappy", F.lit(1))
    rows = cells.join(texts, keys, "left").join(bold, keys, "left").join(gaps, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))
    tag = F.when((F.col("row") == 0) | F.coalesce("bold", F.lit(False)), "th").otherwise("td")
    span = F.when(F.col("colspan") > 1, F.concat(F.lit(' colspan="'), F.col("colspan").cast("string"), F.lit('"'))).otherwise("")
    one = F.concat(F.lit("<"), tag, span, F.lit(">"), F.col("text"), F.lit("</"), tag, F.lit(">"))
    lines = rows.groupBy("book", "page", "region", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", one.alias("h")))), lambda x: x["h"]), "").alias("h"), F.sum("colspan").alias("slots"),
        F.sum(F.when(F.col("text") != "", F.col("colspan")).otherwise(F.col("colspan") - 1)).alias("filled"), F.coalesce(F.sum("gappy"), F.lit(0)).alias("gaps"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )
    t = lines.groupBy("book", "page", "region").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "h"))), lambda x: F.concat(F.lit("<tr>"), x["h"], F.lit("</tr>"))), "").alias("h"),
        *[F.sum(n).alias(n) for n in ("slots", "filled", "gaps")], F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )
    confidence = F.greatest(F.lit(0.0), F.round(1 - 0.6 * (1 - F.col("filled") / F.col("slots")) - 0.25 * F.least("gaps", F.lit(2)), 2))
    px = lambda n: F.bround(F.col(n) * dpi / 72, 0).cast("int")
    return t.select("book", "page", "region", F.concat(F.lit("<table>"), "h", F.lit("</table>")).alias("html"), confidence.alias("confidence"), F.struct(*[px(n).alias(n) for n in ("x1", "y1", "x2", "y2")]).alias("bbox"))
