"""Order on pages: running lines, page-number chains, paragraphs over page ends, continued tables, contents, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

BAND = 0.08
# How a caption begins.
CAPTION = r"(?iu)^\s*(?:Таблица|Табл\.|Продолжение|Окончание|Рис\.|Table|Tabelle|Fig\.)"
BARE_NUMBER = r"^\s*[-—–]?\s*(\d{1,4})\s*[-—–]?\s*$"
EDGE_NUMBER = r"^(\d{1,4})\s+\S|\S\s+(\d{1,4})$"
BODY = ("Text", "Section-header", "Title")


def with_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with idx and height of their page."""
    return blocks.join(pages.select("book", F.col("name").alias("page"), "idx", "height"), ["book", "page"])


def in_band(height: Column) -> Column:
    return F.col("bbox").isNotNull() & ((F.col("bbox.y2") <= BAND * height) | (F.col("bbox.y1") >= (1 - BAND) * height))


def repeated_signatures(blocks: DataFrame, min_pages: int = 3, tolerance: float = 0.03) -> DataFrame:
    """(book, sig, pages) of body lines in the edge bands that stand at one height on several pages.

    One occurrence away from the mean height cancels the signature.  Needs book, page, category, bbox, height, sig.
    """
    mid = F.floor((F.col("bbox.y1") + F.col("bbox.y2")) / 2)
    rows = blocks.where(F.col("category").isin(*BODY) & in_band(F.col("height")) & F.length("sig").between(4, 80)).select("book", "page", "sig", mid.alias("mid"), "height")
    g = rows.groupBy("book", "sig").agg(F.countDistinct("page").alias("pages"), F.avg("mid").alias("mean"), F.min("mid").alias("lo"), F.max("mid").alias("hi"), F.max("height").alias("top"))
    near = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) <= tolerance * F.col("top")
    return g.where((F.col("pages") >= min_pages) & near).select("book", "sig", "pages")


def header_blocks(blocks: DataFrame, sigs: DataFrame) -> DataFrame:
    """(id, action): drop for running lines and numbers, caption for captions taken for headers."""
    edge = F.col("category").isin("Page-header", "Page-footer")
    cap = F.col("txt").rlike(CAPTION)
    hit = blocks.join(sigs.select("book", "sig", F.lit(True).alias("_rep")), ["book", "sig"], "left")
    body = F.col("category").isin(*BODY) & in_band(F.col("height")) & (F.coalesce("_rep", F.lit(False)) | F.col("txt").rlike(BARE_NUMBER))
    act = F.when(cap & edge, "caption").when(~cap & (edge | body), "drop")
    return hit.select("id", act.alias("action")).where("action is not null")


def number_candidates(blocks: DataFrame) -> DataFrame:
    """(book, page, num): the best printed-number candidate; a bare number beats one at an edge, then the smaller."""
    bare = F.regexp_extract("txt", BARE_NUMBER, 1)
    edge = F.concat(F.regexp_extract(F.trim("txt"), EDGE_NUMBER, 1), F.regexp_extract(F.trim("txt"), EDGE_NUMBER, 2))
    cand = F.when(bare != "", F.struct(F.lit(0).alias("rank"), bare.cast("int").alias("num"))).when(edge != "", F.struct(F.lit(1).alias("rank"), edge.cast("int").alias("num")))
    rows = blocks.where(~F.col("txt").rlike(CAPTION)).select("book", "page", cand.alias("c")).where("c is not null")
    return rows.groupBy("book", "page").agg(F.min("c").alias("c")).select("book", "page", F.col("c.num").alias("num"))


def number_chain(pages: DataFrame, window: int = 3) -> DataFrame:
    """(book, name, idx, num, printed) from pages with a candidate ``num``.

    A candidate holds if a neighbouring candidate at most ``window`` pages off differs by the page distance; a number
    accepted twice stays on its first page; pages between two agreeing numbers are filled in.
    """
    order = Window.partitionBy("book").orderBy("idx", "name")
    pos = pages.withColumn("pos", F.row_number().over(order))
    cand = pos.where("num is not null")
    o = Window.partitionBy("book").orderBy("pos")
    agrees = lambda f: (F.abs(f("pos", 1).over(o) - F.col("pos")) <= window) & (f("num", 1).over(o) - F.col("num") == f("pos", 1).over(o) - F.col("pos"))
    ok = cand.withColumn("ok", F.coalesce(agrees(F.lag), F.lit(False)) | F.coalesce(agrees(F.lead), F.lit(False))).where("ok")
    first = ok.withColumn("rn", F.row_number().over(Window.partitionBy("book", "num").orderBy("pos"))).where("rn = 1")
    back = pos.join(first.select("book", "pos", F.col("num").alias("kept")), ["book", "pos"], "left")
    before = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("book").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    fix = F.when(F.col("kept").isNotNull(), F.struct("pos", F.col("kept").alias("num")))
    both = back.withColumn("p", F.last(fix, True).over(before)).withColumn("n", F.first(fix, True).over(after))
    filled = F.when(F.col("n.num") - F.col("p.num") == F.col("n.pos") - F.col("p.pos"), F.col("p.num") + F.col("pos") - F.col("p.pos"))
    return both.select("book", "name", "idx", "num", F.coalesce("kept", filled).cast("string").alias("printed"))


SENTENCE_END = r"[.!?…:;][)»”\"']* *$"


def stitches(blocks: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """(book, page, id, join_to, hyphen): first Text of a page that continues the last Text of the page just before.

    ``hyphen`` is the word at the joint put together where the book has it whole (``words``: book, word), else NULL: a
    compound keeps its hyphen.  Footnotes end no page.  Needs book, page, ord, id, category, txt of top-level blocks.
    """
    pos = pages.select("book", F.col("name").alias("page"), F.row_number().over(Window.partitionBy("book").orderBy("idx", "name")).alias("pos"))
    row = F.struct("ord", "id", "category", "txt")
    ends = blocks.groupBy("book", "page").agg(F.min_by(row, F.struct("ord", "id")).alias("first"), F.max_by(F.when(F.col("category") != "Footnote", row), F.when(F.col("category") != "Footnote", F.struct("ord", "id"))).alias("last"))
    placed = ends.join(pos, ["book", "page"])
    o = Window.partitionBy("book").orderBy("pos")
    pairs = placed.withColumn("prev", F.lag("last").over(o)).withColumn("gap", F.col("pos") - F.lag("pos").over(o))
    nxt = F.ltrim("first.txt")
    rule = (
        (F.col("gap") == 1) & (F.col("prev.category") == "Text") & (F.col("first.category") == "Text")
        & nxt.rlike(r"^\p{Ll}") & ~F.col("prev.txt").rlike(SENTENCE_END) & ~nxt.rlike(r"^[а-яa-z]\)")
    )
    left, right = F.regexp_extract("prev.txt", r"(\p{L}+)-\s*$", 1), F.regexp_extract(nxt, r"^(\p{Ll}+)", 1)
    joined = pairs.where(rule).select("book", "page", F.col("first.id").alias("id"), F.col("prev.id").alias("join_to"), F.when(left != "", F.concat(left, right)).alias("hyphen"))
    known = words.select(F.col("book").alias("_b"), F.col("word").alias("_w")).distinct()
    asked = joined.join(known, (F.col("book") == F.col("_b")) & (F.lower("hyphen") == F.col("_w")), "left")
    return asked.select("book", "page", "id", "join_to", F.when(F.col("_w").isNotNull(), F.col("hyphen")).alias("hyphen"))


def chains(blocks: DataFrame, joins: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, id, blocks, text): every paragraph that goes on over page ends, from its first block.

    A block has at most one continuation and continues at most one block, on the next page; a chain is an island of the
    ordered joined blocks, begun by a block that continues nothing.  A word broken at the joint is put together.
    """
    both = joins.select("book", F.explode(F.array("id", "join_to")).alias("id")).distinct()
    rows = both.join(joins.select("id", "join_to", "hyphen"), "id", "left").join(blocks.select("id", "page", "ord", "txt"), "id")
    rows = rows.join(pages.select("book", F.col("name").alias("page"), "idx"), ["book", "page"])
    w = Window.partitionBy("book").orderBy("idx", "ord", "id")
    island = F.sum(F.col("join_to").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    piece = F.struct("idx", "ord", "id", "hyphen", F.trim("txt").alias("txt"))
    parts = rows.withColumn("island", island).groupBy("book", "island").agg(F.array_sort(F.collect_list(piece)).alias("p"))

    def add(acc: Column, x: Column) -> Column:
        glue = F.when(x["hyphen"].isNotNull(), F.concat(F.regexp_replace(acc, r"-\s*$", ""), x["txt"])).otherwise(F.concat(acc, F.lit(" "), x["txt"]))
        return F.when(acc == "", x["txt"]).otherwise(glue)

    return parts.select("book", F.get("p", F.lit(0))["id"].alias("id"), F.size("p").alias("blocks"), F.aggregate("p", F.lit(""), add).alias("text"))


CONTINUED = r"(?iu)^\s*(?:Продолжение|Окончание|Continuation of|Fortsetzung)\s+(?:табл(?:\.|ицы)?|Table|der Tafel|Tafel)?\s*([IVXLC]+\s*\.\s*\d+|\d+(?:\.\d+)?)"


def continuations(blocks: DataFrame, reach: int = 3) -> DataFrame:
    """(id, continues): tables that a continuation line within ``reach`` blocks before them on the page announces.

    The line marks the first table after it; of two lines before one table the nearer counts.
    """
    o = Window.partitionBy("book", "page").orderBy("ord", "id")
    ref = F.when(F.col("category").isin("Caption", "Text", "Section-header"), F.nullif(F.regexp_replace(F.regexp_extract("txt", CONTINUED, 1), r"\s+", ""), F.lit("")))
    rows = blocks.select("id", "book", "page", "ord", "category", ref.alias("ref"))
    is_table = F.col("category") == "Table"
    last_table = F.last(F.when(is_table, F.col("_n")), True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    line = F.last(F.when(F.col("ref").isNotNull(), F.struct("_n", "ref")), True).over(o.rowsBetween(-reach, -1))
    rows = rows.withColumn("_n", F.row_number().over(o)).withColumn("_t", last_table).withColumn("_l", line)
    return rows.where(is_table & F.col("_l").isNotNull() & (F.coalesce("_t", F.lit(0)) < F.col("_l._n"))).select("id", F.col("_l.ref").alias("continues"))


def page_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with the place of their page in the book; blocks of unknown pages come last, by the name of the page."""
    return blocks.join(pages.select("book", F.col("name").alias("page"), F.col("idx").alias("_idx")), ["book", "page"], "left")


def in_order() -> list[Column]:
    return [F.asc_nulls_last("_idx"), F.asc("page"), F.asc("ord"), F.asc("id")]


def contents(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, page, ord, id, title, slug, nth): headings in order with an anchor name; equal names are numbered."""
    heads = page_order(blocks.where(F.col("category").isin("Title", "Section-header") & (F.trim("txt") != "")), pages)
    rows = heads.select("book", "page", "_idx", "ord", "id", F.regexp_replace(F.trim("txt"), r"\s+", " ").alias("title")).withColumn("slug", text.slug(F.col("title")))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("book", "slug").orderBy(*in_order()))).drop("_idx")


def assemble(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, page, idx, markdown): every page as Markdown in reading order; headers and footers are left out.

    A page is the unit of output: a book is the ordered sequence of its page rows, written partitioned by book, so no
    book has to fit in one task.
    """
    t = F.trim("txt")
    md = (
        F.when(F.col("category") == "Title", F.concat(F.lit("# "), t)).when(F.col("category") == "Section-header", F.concat(F.lit("## "), t))
        .when(F.col("category") == "List-item", F.concat(F.lit("- "), t)).when(F.col("category") == "Caption", F.concat(F.lit("*"), t, F.lit("*")))
        .when((F.col("category") == "Formula") & ~t.startswith("$$"), F.concat(F.lit("$$"), t, F.lit("$$"))).otherwise(t)
    )
    body = blocks.where(~F.col("category").isin("Page-header", "Page-footer", "Picture") & F.col("txt").isNotNull() & (t != "") & F.col("parent").isNull())
    rows = with_pages(body, pages).select("book", "page", "idx", F.struct("ord", "id", md.alias("md")).alias("s"))
    parts = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["md"])
    return rows.groupBy("book", "page", "idx").agg(F.array_join(parts, "\n\n").alias("markdown"))


def footnotes(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, book, page, mark, number): footnotes with their mark and running number in the book."""
    mark = F.regexp_extract("txt", r"^\s*(\*{1,3}|[¹²³⁴⁵⁶⁷⁸⁹]+|\d{1,2}\))", 1)
    rows = page_order(blocks.where((F.col("category") == "Footnote") & (mark != "")), pages).select("id", "book", "page", "_idx", "ord", mark.alias("mark"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("book").orderBy(*in_order()))).drop("ord", "_idx")


# How a reference to a figure, table or chapter begins, and the categories that hold references.
REFERENCE = r"(?:[Рр]ис\.|[Рр]исун[а-яё]+|[Тт]абл\.|[Тт]аблиц[а-яё]+|[Гг]л\.|[Гг]лав[аеуы])\s*"
REFERRING = ("Text", "Caption", "List-item", "Section-header", "Title", "Footnote", "Table")


def roman_references(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """(id, fixed): texts of books with Roman chapters in which a reference had a 1 for an I (1.28, 1V.4)."""
    mine = blocks.where(F.col("category").isin(*REFERRING) & F.col("txt").isNotNull()).join(books.where("is_roman").select("book"), "book", "left_semi")
    pattern = rf"(?U)(?<![\w.]){REFERENCE}[1IVX]+\.\s?\d+(?![\d]|\.\d)"

    def word(w: Column) -> Column:
        part = F.regexp_extract(w, r"([1IVX]+)\.\s?\d+$", 1)
        roman = text.roman_chapter(part)
        return F.when(roman.isNotNull(), F.concat(F.regexp_replace(w, r"[1IVX]+\.\s?\d+$", ""), roman, F.regexp_extract(w, r"(\.\s?\d+)$", 1))).otherwise(w)

    fixed = text.replaced(F.col("txt"), pattern, word)
    return mine.select("id", "txt", fixed.alias("fixed")).where("txt <> fixed").select("id", "fixed")


def roman_books(blocks: DataFrame, ratio: int = 3) -> DataFrame:
    """(book, roman, arabic, is_roman): does the book number its chapters in Roman numerals?

    Distinct Roman references must be ``ratio`` times the Arabic ones with a chapter not of ones alone, one with V or X.
    """
    prefix = REFERENCE
    r = F.regexp_extract_all("txt", F.lit(rf"(?U)(?<![\w.]){prefix}([IVX]+\.\s?\d+)(?![\d]|\.\d)"), F.lit(1))
    a = F.regexp_extract_all("txt", F.lit(rf"(?U)(?<![\w.]){prefix}(\d+\.\s?\d+)(?![\d]|\.\d)"), F.lit(1))
    rows = blocks.where(F.col("txt").isNotNull() & F.col("book").isNotNull() & F.col("category").isin(*REFERRING)).select("book", F.explode(F.concat(F.transform(r, lambda x: F.struct(F.lit("r").alias("k"), x.alias("v"))), F.transform(a, lambda x: F.struct(F.lit("a").alias("k"), x.alias("v"))))).alias("s"))
    v = F.regexp_replace("s.v", r"\s", "")
    rows = rows.select("book", "s.k", v.alias("v")).where(~((F.col("k") == "a") & F.col("v").rlike(r"^1+\."))).distinct()
    g = rows.groupBy("book").agg(F.count_if(F.col("k") == "r").alias("roman"), F.count_if(F.col("k") == "a").alias("arabic"), F.coalesce(F.bool_or((F.col("k") == "r") & F.col("v").rlike("^[IVX]*[VX]")), F.lit(False)).alias("vx"))
    return g.select("book", "roman", "arabic", ((F.col("roman") > 0) & F.col("vx") & (F.col("roman") >= ratio * F.col("arabic"))).alias("is_roman"))
