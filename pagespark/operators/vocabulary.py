"""Words of a book: vocabulary, words broken at line ends, words outside a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = r"\p{L}"
SOFT_BREAK = rf"({LETTERS}+)-[ \t]*\r?\n[ \t]*(\p{{Ll}}+)"


def whole_words(c: Column) -> Column:
    """Lower-case words that stand whole: not beside a hyphen, a digit or inside markup."""
    plain = F.regexp_replace(c, r"<[^<>]*>|\$[^$]*\$", " ")
    plain = F.regexp_replace(plain, r"[\p{L}\p{N}_]+(?:-[ \t]*\r?\n?[ \t]*[\p{L}\p{N}_]+)+", " ")
    runs = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(F.filter(runs, lambda w: w.rlike(rf"^{LETTERS}+$")), F.lower)


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(book, word, n) of the whole words; counted before and after the shuffle."""
    return blocks.where("txt is not null").select("book", F.explode(whole_words(F.col("txt"))).alias("word")).groupBy("book", "word").agg(F.count("*").alias("n"))


def compounds(blocks: DataFrame) -> DataFrame:
    """(book, word, n) of words written with a hyphen inside the line."""
    found = F.regexp_extract_all("txt", F.lit(rf"(?<![\p{{L}}\p{{N}}_-])({LETTERS}+-\p{{Ll}}+)(?![\p{{L}}\p{{N}}_-])"), F.lit(1))
    return blocks.where("txt is not null").select("book", F.explode(F.transform(found, F.lower)).alias("word")).groupBy("book", "word").agg(F.count("*").alias("n"))


def line_breaks(blocks: DataFrame, vocab: DataFrame, hyphenated: DataFrame, keep: int = 2) -> DataFrame:
    """(id, book, left, right, joined, n): words broken at a line end or inside it that the book also has whole.

    A form written with its hyphen at least ``keep`` times inside lines is a compound and stays.
    """
    soft = F.regexp_extract_all("txt", F.lit(SOFT_BREAK), F.lit(0))
    inline = F.regexp_extract_all("txt", F.lit(rf"(?<![\p{{L}}\p{{N}}_-])({LETTERS}+-\p{{Ll}}+)(?![\p{{L}}\p{{N}}_-])"), F.lit(1))
    forms = F.array_distinct(F.concat(F.transform(soft, lambda x: F.struct(x.alias("f"), F.lit(True).alias("soft"))), F.transform(inline, lambda x: F.struct(x.alias("f"), F.lit(False).alias("soft")))))
    rows = blocks.where("txt is not null").select("id", "book", F.explode(forms).alias("s"))
    rows = rows.select("id", "book", "s.soft", F.regexp_extract("s.f", r"^(\p{L}+)-", 1).alias("left"), F.regexp_extract("s.f", r"-\s*(\p{L}+)$", 1).alias("right"))
    rows = rows.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("form", F.lower(F.concat_ws("-", "left", "right")))
    known = rows.join(vocab.select("book", F.col("word").alias("joined"), "n"), ["book", "joined"])
    comp = hyphenated.where(F.col("n") >= keep).select("book", F.col("word").alias("form"), F.lit(True).alias("_c"))
    real = known.join(comp, ["book", "form"], "left")
    return real.where(F.col("soft") | F.col("_c").isNull()).select("id", "book", "left", "right", "joined", "n").distinct()


def unknown_words(vocab: DataFrame, dictionary: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` most frequent words of at least three letters that the dictionary lacks: (word, n, books)."""
    words = vocab.where(F.length("word") >= 3).join(dictionary.select("word"), "word", "left_anti")
    return words.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("books")).orderBy(F.desc("n"), "word").limit(top)


def repeated_top(vocab: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` words of every book: (book, word, n, rank); ties by the word."""
    w = Window.partitionBy("book").orderBy(F.desc("n"), "word")
    return vocab.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


SPELLED = "[A-Za-zÄÖÜäöüßА-Яа-яЁё]+"


def spelling(blocks: DataFrame, pages: DataFrame, dictionary: DataFrame, top: int = 30, most_pages: int = 10) -> DataFrame:
    """(book, word, n, pages, rank): the ``top`` unknown words of every book with the first pages they stand on.

    Words of three letters and more outside formulas and tags, short capitals left out; a word of two alphabets is
    unknown whatever the dictionary says.  Ties go to the word that comes first.
    """
    plain = F.regexp_replace("txt", r"(?s)\$\$.+?\$\$|\$[^$\n]+?\$|\\\(.+?\\\)|\\\[.+?\\\]|<[^>]*>", " ")
    rows = blocks.where("txt is not null").join(pages.select("book", F.col("name").alias("page"), "idx"), ["book", "page"])
    words = rows.select("book", "page", "idx", "ord", "id", F.posexplode(F.regexp_extract_all(plain, F.lit(f"({SPELLED})"), F.lit(1))).alias("at", "word"))
    words = words.where((F.length("word") >= 3) & ~((F.upper("word") == F.col("word")) & (F.length("word") <= 6)))
    place = F.struct("idx", "ord", "id", "at")
    per_page = words.groupBy("book", "word", "page").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    mixed = F.col("word").rlike("[А-Яа-яЁё]") & F.col("word").rlike("[A-Za-zÄÖÜäöüß]")
    known = dictionary.select(F.col("word").alias("_low")).distinct().withColumn("_known", F.lit(True))
    odd = per_page.withColumn("_low", F.lower("word")).join(known, "_low", "left").where(F.col("_known").isNull() | mixed)
    g = odd.groupBy("book", "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "page"))).alias("all"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= top)
    return ranked.select("book", "word", "n", F.array_join(F.transform(F.slice("all", 1, most_pages), lambda x: x["page"]), ", ").alias("pages"), "rank")
