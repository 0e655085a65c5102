"""Books as one Markdown text: their pages, the places of corrections in them, texts of pictures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.notes import ANCHOR_PATTERN
from .pages import place_in


def sections(books: DataFrame) -> DataFrame:
    """(book, nth, scan, start, text): the pages of every book's text, from behind each anchor to the next one."""
    text, anchors = F.split("md", ANCHOR_PATTERN, -1), F.regexp_extract_all("md", F.lit(f"({ANCHOR_PATTERN})"), F.lit(1))
    pieces = F.arrays_zip(F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(1))).alias("text"), anchors.alias("anchor"))
    rows = books.select("book", F.length(F.get(text, F.lit(0))).alias("_head"), F.posexplode(F.filter(pieces, lambda p: p["anchor"].isNotNull())).alias("nth", "p"))
    before = Window.partitionBy("book").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_head") + F.coalesce(F.sum(F.length("p.anchor") + F.length("p.text")).over(before), F.lit(0)) + F.length("p.anchor")
    return rows.select("book", "nth", F.regexp_extract("p.anchor", r"scan: (\S+)", 1).alias("scan"), start.alias("start"), F.col("p.text").alias("text"))


def located_in_books(fixes: DataFrame, books: DataFrame, around: int = 40) -> DataFrame:
    """(id, status, offset, before, after): where in the text of its book each correction stands, with its surroundings.

    The page of its scan comes first, then the one behind it (paragraphs go on over pages); the surroundings end at the
    anchors of the page.  Needs id, book, scan, token, before, after.
    """
    pages_ = sections(books)
    w = Window.partitionBy("book").orderBy("nth")
    paired = pages_.select("book", "scan", F.struct("start", "text").alias("own"), F.lead(F.struct("start", "text")).over(w).alias("next"))
    first = paired.groupBy("book", "scan").agg(F.first("own").alias("own"), F.first("next").alias("next"))
    rows = fixes.where("token is not null").join(first, ["book", "scan"], "left")

    def run(it):
        for pdf in it:
            out = []
            for i, token, before, after, own, nxt in zip(pdf["id"], pdf["token"], pdf["before"], pdf["after"], pdf["own"], pdf["next"]):
                row = (i, "absent", None, None, None)
                for page in (own, nxt):
                    if page is None:
                        continue
                    status, at = place_in(page["text"], before, token, after)
                    if status == "ambiguous":
                        row = (i, status, None, None, None)
                    elif at is not None:
                        end = at + len(token)
                        row = (i, status, page["start"] + at, page["text"][max(0, at - around) : at], page["text"][end : end + around])
                    if status != "absent":
                        break
                out.append(row)
            yield pd.DataFrame(out, columns=["id", "status", "offset", "before", "after"]).astype({"offset": "Int64"})

    return rows.select("id", "token", "before", "after", "own", "next").mapInPandas(run, "id string, status string, offset long, before string, after string")


def alt_texts(blocks: DataFrame) -> DataFrame:
    """(id, alt): what a picture shows, by the caption right behind it, else the one right before it: its first line."""
    w = Window.partitionBy("book", "page").orderBy("ord", "id")
    caption = F.when((F.col("category") == "Caption") & (F.trim("txt") != ""), F.col("txt"))
    rows = blocks.withColumn("_c", caption).withColumn("_alt", F.coalesce(F.lead("_c").over(w), F.lag("_c").over(w), F.lit("")))
    line = F.substring_index(F.regexp_replace("_alt", r"\A\s+|\s+\z", ""), "\n", 1)
    return rows.where("category = 'Picture'").select("id", F.left(F.regexp_replace(line, r"[\[\]]", ""), F.lit(200)).alias("alt"))
