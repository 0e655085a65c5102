"""Front matter, contents notes and summaries of assembled books, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import slug


def quoted(c: Column) -> Column:
    """A YAML string in double quotes."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(c, F.lit("\n"), F.lit(" ")), F.lit('"'))


def _field(name: str, c: Column) -> Column:
    v = c.cast("string")
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit(f"{name}:")).otherwise(F.concat(F.lit(f"{name}: "), v))


def front_matter(title: Column, author: Column, year: Column, langs: Column, pages: Column, description: Column, keywords: Column) -> Column:
    """YAML block; description and keywords only where there are any."""
    words = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != "")
    lines = F.array(
        F.lit("---"), F.concat(F.lit("title: "), quoted(F.coalesce(title, F.lit("")))), _field("author", author), _field("year", year),
        F.concat(F.lit("lang: ["), F.array_join(F.coalesce(langs, F.array().cast("array<string>")), ", "), F.lit("]")), _field("pages", pages), F.lit("tags: []"), F.lit("type: book-source"),
        F.when(F.trim(description) != "", F.concat(F.lit("description: "), quoted(F.trim(description)))),
        F.when(F.size(words) > 0, F.concat(F.lit("keywords: ["), F.array_join(F.transform(words, quoted), ", "), F.lit("]"))),
        F.lit("---"), F.lit(""),
    )
    return F.concat(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit("\n"))


def toc(books: DataFrame) -> DataFrame:
    """(book, line_no, level, title, slug, printed): headings outside code fences with the page of the last anchor.

    Needs book and md; anchors and headings inside a fence don't count.
    """
    rows = books.select("book", F.posexplode(F.split("md", r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("book").orderBy("line_no")
    fence = F.trim("line").startswith("```")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(w)).where((F.col("fences") % 2 == 0) & ~fence)
    page = F.regexp_extract("line", r"<!-- page: ([^>]*?) scan: \S+ -->", 1)
    is_anchor = page != ""
    rows = rows.withColumn("anchor", F.last(F.when(is_anchor, page), True).over(w))
    head = F.regexp_extract("line", r"^(#{1,2})\s+(.*?)\s*$", 1)
    title = F.regexp_extract("line", r"^(#{1,2})\s+(.*?)\s*$", 2)
    out = rows.where((head != "") & ~is_anchor)
    return out.select("book", "line_no", F.length(head).alias("level"), title.alias("title"), slug(title).alias("slug"), F.nullif("anchor", F.lit("?")).alias("printed"))


def contents_note(entries: DataFrame) -> DataFrame:
    """(book, note): links to the headings of a book, in order, with printed pages."""
    name = F.replace(F.replace("title", F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    line = F.concat(F.lit("- ["), name, F.lit("](book.md#"), F.col("slug"), F.lit(")"), F.coalesce(F.concat(F.lit(" — p. "), F.col("printed")), F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda s: s["l"])
    return entries.groupBy("book").agg(F.concat(F.lit("## Contents\n\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("note"))


def summary(reply: Column) -> Column:
    """struct(description, keywords, parsed) of a model's reply: JSON, the first {...}, or the text as it is."""
    schema = "struct<description:string,keywords:array<string>>"
    whole = F.from_json(F.trim(reply), schema)
    part = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema)
    got = F.when(F.trim(F.coalesce(whole["description"], F.lit(""))) != "", whole).otherwise(part)
    words = F.filter(F.transform(F.coalesce(got["keywords"], F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != "")
    good = F.trim(F.coalesce(got["description"], F.lit(""))) != ""
    return F.struct(F.when(good, F.trim(got["description"])).otherwise(F.trim(reply)).alias("description"), words.alias("keywords"), good.alias("parsed"))


# --- books as one Markdown text with page anchors ----------------------------------------------------------------

ANCHOR_PATTERN = r"<!-- page: [^>]*? scan: \S+ -->"


def page_anchor(printed: Column, scan: Column) -> Column:
    """Comment that begins a page of a book."""
    return F.concat(F.lit("<!-- page: "), F.coalesce(printed, F.lit("?")), F.lit(" scan: "), scan, F.lit(" -->"))


def without_front_matter(md: Column) -> Column:
    return F.regexp_replace(md, r"(?s)\A---\n.*?\n---\n+", "")


def cleaned_markdown(raw: Column) -> Column:
    """A model's page without the fence round it and the coordinates behind its lines; ends in one line break."""
    body = F.regexp_replace(F.regexp_replace(raw, r"\A\s+|\s+\z", ""), r"(?s)\A```(?:markdown|md)?\s*\n(.*?)\n?```\s*\z", "$1")
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)\s*\(\d+,\s*\d+\),\s*\(\d+,\s*\d+\)[ \t]*$", ""), r"\A\s+|\s+\z", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def contents_name(book: Column, taken: tuple[str, ...] = ("book", "quality")) -> Column:
    """File name of a book's contents note; names of other files of the folder get an ending."""
    return F.when(book.isin(*taken), F.concat(book, F.lit("-contents"))).otherwise(book)


def candidate_name(stem: Column, suffix: Column, scan: Column) -> Column:
    return F.format_string("%s_%s_%04d.jpg", stem, suffix, scan)


def duration(seconds: Column) -> Column:
    """Seconds as 45s, 12m, 3h05m or 2d 4h; a dash where there are none."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5))
    m = F.floor(s / 60 + 0.5)
    h = F.floor(m / 60)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    shown = F.when(s < 60, text(s, "s")).when(m < 60, text(m, "m")).when(h < 24, text(h, "h", F.lpad((m % 60).cast("string"), 2, "0"), "m"))
    return F.when(seconds.isNull() | F.isnan(seconds), "—").otherwise(shown.otherwise(text(F.floor(h / 24), "d ", h % 24, "h")))


def readable_table(markup: Column) -> Column:
    """A table's markup for display: cells told apart by a bar, rows by lines; sub- and superscripts stay."""
    for pattern, by in ((r"</t[dh]>\s*<t[dh][^>]*>", " │ "), (r"</tr>\s*", "\n"), (r"<br\s*/?>", " "), (r"<(?!/?(?:sub|sup)>)[^>]*>", "")):
        markup = F.regexp_replace(markup, pattern, by)
    return markup
