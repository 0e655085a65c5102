"""Raw page answers of layout models as block rows: JSON cells, grounding marks, labelled HTML, label lists.

All readers give (key columns..., ord, category, text, bbox) with the box in page pixels, clamped to the page; what
can't be read degrades (no box, category Text), and a row is never lost.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators.geometry import clamp

CELL = "struct<bbox:array<double>,category:string,text:string>"
# Labels of the grounding format and of the label-list format, and the labelled HTML's.
GROUNDING = {
    "title": "Title", "sub_title": "Section-header", "text": "Text", "table": "Table", "image": "Picture", "figure": "Picture", "image_caption": "Caption", "table_caption": "Caption",
    "equation": "Formula", "formula": "Formula", "list": "List-item", "header": "Page-header", "footer": "Page-footer", "page_footnote": "Footnote", "footnote": "Footnote", "table_footnote": "Footnote",
}
LABEL_LIST = {
    "doc_title": "Title", "paragraph_title": "Section-header", "text": "Text", "content": "Text", "abstract": "Text", "reference": "Text", "reference_content": "Text", "aside_text": "Text", "table": "Table",
    "display_formula": "Formula", "formula": "Formula", "inline_formula": "Formula", "image": "Picture", "chart": "Picture", "figure": "Picture", "seal": "Picture", "figure_title": "Caption", "table_title": "Caption",
    "chart_title": "Caption", "vision_footnote": "Footnote", "footnote": "Footnote", "header": "Page-header", "header_image": "Page-header", "footer": "Page-footer", "footer_image": "Page-footer", "number": "Page-footer",
    "formula_number": "Text", "algorithm": "Text",
}
HTML_LABELS = {
    "Caption": "Caption", "Footnote": "Footnote", "Equation-Block": "Formula", "List-Group": "List-item",
    "Page-Header": "Page-header", "Page-Footer": "Page-footer", "Image": "Picture", "Figure": "Picture",
    "Diagram": "Picture", "Section-Header": "Section-header", "Table": "Table", "Text": "Text",
    "Complex-Block": "Text", "Code-Block": "Text", "Form": "Text", "Table-Of-Contents": "Text",
    "Chemical-Block": "Formula", "Bibliography": "Text",
}


def _map(labels: dict[str, str], c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(m[c], F.lit("Text"))


def _box(b: Column, width: Column, height: Column, sx: Column | float = 1.0, sy: Column | float = 1.0) -> Column:
    v = lambda i, s: F.get(b, F.lit(i)) * s
    return F.when(F.size(b) >= 4, clamp(v(0, sx), v(1, sy), v(2, sx), v(3, sy), width, height))


def json_cells(pages: DataFrame, keys: list[str], sx: Column | float = 1.0, sy: Column | float = 1.0) -> DataFrame:
    """Cells from a JSON list, one cell, an object that holds a list, or a truncated list (whole cells are salvaged).

    Needs raw, width, height; ``sx`` and ``sy`` take model pixels to page pixels.
    """
    raw = F.trim("raw")
    as_list = F.from_json(raw, f"array<{CELL}>")
    one = F.from_json(raw, CELL)
    inner = F.from_json(F.regexp_extract(raw, r"(?s)\A\{\s*\"[^\"]+\"\s*:\s*(\[.*\])\s*\}\z", 1), f"array<{CELL}>")
    salvage = F.transform(F.regexp_extract_all(raw, F.lit(r"(\{[^{}]*\})"), F.lit(1)), lambda s: F.from_json(s, CELL))
    real = lambda a: F.filter(a, lambda c: c.isNotNull() & (c["bbox"].isNotNull() | c["category"].isNotNull() | c["text"].isNotNull()))
    cand = F.array(real(as_list), real(F.array(one)), real(inner), real(salvage))
    cells = F.get(F.filter(cand, lambda a: a.isNotNull() & (F.size(a) > 0)), F.lit(0))
    whole = F.array(F.struct(F.lit(None).cast("array<double>").alias("bbox"), F.lit("Text").alias("category"), raw.alias("text")))
    rows = pages.where("raw is not null").select(*keys, "width", "height", F.posexplode(F.coalesce(cells, whole)).alias("ord", "c"))
    category = F.when(F.col("c.category").isin(*schemas.CATEGORIES), F.col("c.category")).otherwise("Text")
    return rows.select(*keys, "ord", category.alias("category"), F.coalesce("c.text", F.lit("")).alias("text"), _box(F.col("c.bbox"), F.col("width"), F.col("height"), sx, sy).alias("bbox"))


def grounded(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of ``<|ref|>label<|/ref|><|det|>[[x1, y1, x2, y2]]<|/det|>text`` runs; coordinates are of 999."""
    mark = r"<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
    raw = F.col("raw")
    labels = F.regexp_extract_all(raw, F.lit(f"(?s){mark}"), F.lit(1))
    boxes = F.regexp_extract_all(raw, F.lit(f"(?s){mark}"), F.lit(2))
    texts = F.slice(F.split(raw, f"(?s){mark}", -1), 2, 1_000_000)
    clean = lambda c: F.trim(F.regexp_replace(c, r"<｜[^｜]*｜>|<\|[^|]*\|>", ""), F.lit(" \n\t\r"))
    found = F.transform(labels, lambda lab, i: F.struct(F.lower(F.trim(lab)).alias("label"), F.get(boxes, i).alias("b"), clean(F.get(texts, i)).alias("text")))
    none = F.filter(F.array(F.struct(F.lit("text").alias("label"), F.lit("").alias("b"), clean(raw).alias("text"))), lambda s: s["text"] != "")
    rows = pages.where("raw is not null").select(*keys, "width", "height", F.posexplode(F.when(F.size(labels) > 0, found).otherwise(none)).alias("ord", "s"))
    b = F.transform(F.regexp_extract_all(F.regexp_extract("s.b", r"\[\s*\[?([^\[\]]*)\]", 1), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    category = _map(GROUNDING, F.col("s.label"))
    return rows.select(*keys, "ord", category.alias("category"), F.when(category == "Picture", "").otherwise(F.col("s.text")).alias("text"), _box(b, F.col("width"), F.col("height"), F.col("width") / 999, F.col("height") / 999).alias("bbox"))


def label_list(items: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of rows (label, bbox, content, ord) of a detector that reads: labels mapped, pictures without text."""
    category = _map(LABEL_LIST, F.col("label"))
    return items.select(*keys, "ord", category.alias("category"), F.when(category == "Picture", "").otherwise(F.coalesce(F.col("content"), F.lit(""))).alias("text"), _box(F.col("bbox").cast("array<double>"), F.col("width"), F.col("height")).alias("bbox"))


class _Divs(HTMLParser):
    """Top-level elements with their label, box and inner markup."""

    def __init__(self, raw: str):
        super().__init__(convert_charrefs=False)
        self.raw, self.out, self.depth, self.start = raw, [], 0, 0
        self.attrs: dict = {}
        lines = raw.split("\n")
        self.offsets = [0]
        for ln in lines:
            self.offsets.append(self.offsets[-1] + len(ln) + 1)
        self.feed(raw)
        self.close()

    def _at(self) -> int:
        line, col = self.getpos()
        return self.offsets[line - 1] + col

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            if self.depth == 0:
                self.attrs, self.start = dict(attrs), self._at() + len(self.get_starttag_text())
            self.depth += 1

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            self.depth -= 1
            if self.depth == 0 and self.attrs.get("data-label") is not None:
                self.out.append((self.attrs["data-label"], self.attrs.get("data-bbox") or "", self.raw[self.start : self._at()]))


def _divs(raw: str) -> list[tuple[str, list[float] | None, str]]:
    out = []
    for label, box, inner in _Divs(raw).out:
        nums = re.findall(r"-?\d+(?:\.\d+)?", box)[:4]
        out.append((label, [float(x) for x in nums] if len(nums) == 4 else None, inner))
    return out


def labelled_html(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of ``<div data-label data-bbox>`` elements, coordinates of 1000; tables stay HTML, the rest becomes text."""
    types = dict(pages.dtypes)
    cols = [*keys, "width", "height"]

    def run(it):
        for pdf in it:
            rows = []
            for *head, raw in zip(*[pdf[c] for c in cols], pdf["raw"]):
                found = _divs(raw) or ([("Text", None, raw)] if raw.strip() and "data-label" not in raw else [])
                rows += [(*head, i, lab, b, inner) for i, (lab, b, inner) in enumerate(found) if lab != "Blank-Page"]
            yield pd.DataFrame(rows, columns=[*cols, "ord", "label", "b", "inner"])

    head = ", ".join(f"{c} {types[c]}" for c in cols)
    rows = pages.where("raw is not null").select(*cols, "raw").mapInPandas(run, f"{head}, ord int, label string, b array<double>, inner string")
    category = _map(HTML_LABELS, F.col("label"))
    table = F.regexp_extract("inner", r"(?is)(<table.*</table>)", 1)
    body = F.when(category == "Picture", "").when((category == "Table") & (table != ""), table).otherwise(F.trim(text.plain_from_html(F.col("inner")), F.lit(" \n")))
    return rows.select(*keys, "ord", category.alias("category"), body.alias("text"), _box(F.col("b"), F.col("width"), F.col("height"), F.col("width") / 1000, F.col("height") / 1000).alias("bbox"))
