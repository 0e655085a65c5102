"""Boxes on pages: clamping, overlap, containment, matching, suppression, reading order."""

from __future__ import annotations



import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def clamp(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Box rounded (half to even) and cut to the page; NULL if not finite, empty or inverted."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e9))
    cut = lambda c, hi: F.least(F.greatest(F.bround(c.cast("double"), 0), F.lit(0.0)), hi.cast("double")).cast("int")
    a, b, c, d = cut(x1, width), cut(y1, height), cut(x2, width), cut(y2, height)
    fine = ok(x1.cast("double")) & ok(y1.cast("double")) & ok(x2.cast("double")) & ok(y2.cast("double")) & (c > a) & (d > b)
    return F.when(fine, F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def area(b: Column) -> Column:
    return ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).cast("double")


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), (w * h).cast("double")).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def page_pairs(left: DataFrame, right: DataFrame, cell: int = 256) -> DataFrame:
    """Pairs of boxes of one page that share a grid cell: (book, page, l, r), each pair once.

    The grid keeps far boxes of a crowded page apart; ``l`` and ``r`` are structs of id and bbox.
    """
    def gridded(df: DataFrame, name: str) -> DataFrame:
        xs = F.sequence(F.floor(F.col("bbox.x1") / cell), F.floor(F.col("bbox.x2") / cell))
        ys = F.sequence(F.floor(F.col("bbox.y1") / cell), F.floor(F.col("bbox.y2") / cell))
        rows = df.where("bbox is not null and bbox.x2 >= bbox.x1 and bbox.y2 >= bbox.y1").select("book", "page", F.struct("id", "bbox").alias(name), F.explode(xs).alias("gx"), ys.alias("_ys"))
        return rows.select("book", "page", name, "gx", F.explode("_ys").alias("gy"))

    pairs = gridded(left, "l").join(gridded(right, "r"), ["book", "page", "gx", "gy"])
    # the pair is kept in the first cell both boxes reach
    fx = F.greatest(F.floor(F.col("l.bbox.x1") / cell), F.floor(F.col("r.bbox.x1") / cell))
    fy = F.greatest(F.floor(F.col("l.bbox.y1") / cell), F.floor(F.col("r.bbox.y1") / cell))
    return pairs.where((F.col("gx") == fx) & (F.col("gy") == fy)).select("book", "page", "l", "r")


# Kinds of blocks whose frame may hold tables and pictures that are not theirs.
MASKED_KINDS = ("text", "title", "caption", "footnote", "list", "formula")


def masked(blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """(id, other, share): tables and pictures that lie to at least ``share`` inside a block of text or formula of their page.

    Blocks inside another one mask nothing.  Needs id, book, page, category, kind, parent, bbox.
    """
    texts = blocks.where(F.col("kind").isin(*MASKED_KINDS))
    others = blocks.where("category in ('Table','Picture') and parent is null")
    both = intersection(F.col("l.bbox"), F.col("r.bbox"))
    p = page_pairs(texts, others).where(F.col("l.id") != F.col("r.id")).withColumn("share", F.when(area(F.col("r.bbox")) > 0, both / area(F.col("r.bbox"))))
    return p.where(F.col("share") >= share).select(F.col("l.id").alias("id"), F.col("r.id").alias("other"), F.round("share", 4).alias("share"))


def centres_inside(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """(id, inside): pairs whose first box has its centre in the second, borders included."""
    p = page_pairs(boxes, tables)
    cx, cy = (F.col("l.bbox.x1") + F.col("l.bbox.x2")) / 2, (F.col("l.bbox.y1") + F.col("l.bbox.y2")) / 2
    t = F.col("r.bbox")
    return p.where((F.col("l.id") != F.col("r.id")) & cx.between(t["x1"], t["x2"]) & cy.between(t["y1"], t["y2"])).select(F.col("l.id").alias("id"), F.col("r.id").alias("inside"))


def greedy(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """One-to-one matching by falling score of the pairs (keys, l, r, score): keys, l, r, score.

    Sequential within one page, so it is a grouped map over the page's pairs that reach the threshold.
    """
    rows = pairs.where(F.col("score") >= threshold).select(*keys, "l", "r", "score")
    types = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "l", "r"], ascending=False, kind="stable")
        seen_l, seen_r, keep = set(), set(), []
        for a, b in zip(pdf["l"], pdf["r"]):
            fresh = a not in seen_l and b not in seen_r
            keep.append(fresh)
            if fresh:
                seen_l.add(a)
                seen_r.add(b)
        return pdf[keep]

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*keys, "l", "r", "score"]))


def suppress(boxes: list[tuple[float, Box]], threshold: float = 0.5) -> list[int]:
    """Numbers of the boxes that stay: by falling score, each one unless it overlaps a kept one above the threshold."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda k: (-boxes[k][0], k)):
        if all(overlap(boxes[i][1], boxes[j][1]) <= threshold for j in kept):
            kept.append(i)
    return kept


def pad(b: Column, by: int, width: Column, height: Column) -> Column:
    """The box grown by ``by`` on all sides, inside the page."""
    return F.struct(
        F.greatest(F.lit(0), b["x1"] - by).alias("x1"), F.greatest(F.lit(0), b["y1"] - by).alias("y1"), F.least(width, b["x2"] + by).alias("x2"), F.least(height, b["y2"] + by).alias("y2"),
    )


def figures_only(boxes: DataFrame, least: float = 0.025) -> DataFrame:
    """Boxes at least ``least`` of the page high: lower ones are text.  Needs bbox and height."""
    return boxes.where(F.col("bbox.y2") - F.col("bbox.y1") >= least * F.col("height"))


def figure_counts(pred: DataFrame, outside: DataFrame, inside: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(book, page, inside_hit, inside_gold, hit, predicted, gold): predicted figures against gold ones inside tables, the rest against those outside."""
    keys = ["book", "page"]

    def matched(a: DataFrame, b: DataFrame) -> DataFrame:
        p = page_pairs(a, b)
        scored = p.select(*keys, F.col("l.id").alias("l"), F.col("r.id").alias("r"), iou(F.col("l.bbox"), F.col("r.bbox")).alias("score"))
        return greedy(scored, keys, threshold)

    first = matched(pred, inside)
    rest = pred.join(first.select(*keys, F.col("l").alias("id")), [*keys, "id"], "left_anti")
    second = matched(rest, outside)
    parts = [first.select(*keys, F.lit(0).alias("k")), inside.select(*keys, F.lit(1).alias("k")), second.select(*keys, F.lit(2).alias("k")), rest.select(*keys, F.lit(3).alias("k")), outside.select(*keys, F.lit(4).alias("k"))]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    names = ("inside_hit", "inside_gold", "hit", "predicted", "gold")
    return every.groupBy(*keys).agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in enumerate(names)])


def overlap(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def rows_of(boxes: list[Box]) -> list[int]:
    """Reading order: boxes into rows (a centre above the bottom of the row joins it), rows down, boxes to the right."""
    order = sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0]))
    rows: list[tuple[float, list[int]]] = []
    for i in order:
        x1, y1, x2, y2 = boxes[i]
        if rows and (y1 + y2) / 2 < rows[-1][0]:
            rows[-1] = (max(rows[-1][0], y2), rows[-1][1] + [i])
        else:
            rows.append((y2, [i]))
    return [i for _, r in rows for i in sorted(r, key=lambda k: boxes[k][0])]


def reading_order(blocks: DataFrame) -> DataFrame:
    """(book, page, id, place) of the boxes of every page."""
    rows = blocks.where("bbox is not null").select("book", "page", "id", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        order = rows_of(list(zip(pdf.x1, pdf.y1, pdf.x2, pdf.y2)))
        return pd.DataFrame({"book": pdf["book"], "page": pdf["page"], "id": pdf["id"].iloc[order].to_numpy(), "place": range(1, len(order) + 1)})

    return rows.groupBy("book", "page").applyInPandas(run, "book string, page string, id long, place long")




def counts(matched: Column, predicted: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) with the empty cases: nothing to find and nothing found is perfect."""
    p = F.when((predicted == 0) & (gold == 0), 1.0).when(predicted == 0, 0.0).otherwise(matched / predicted)
    r = F.when(gold == 0, 1.0).otherwise(matched / gold)
    f = F.when((predicted == 0) & (gold == 0), 1.0).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))
