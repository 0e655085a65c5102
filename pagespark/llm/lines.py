"""Problem 1: lines repeated across the pages of one source.

Method: incremental per-source line-count tables.  A batch of blocks becomes a
line table (``line_table``: document, line, source, page, hashes and key of every
line), which is appended to the stored ones; ``count_table`` holds on how many
pages of its source each line stands, and ``merge_counts`` adds a batch to it
without counting the old rows again.  ``repeated`` finds the lines above the
threshold from these tables alone, ``crossings`` those that a batch lifted over it,
and ``rebuild`` reads only the documents that hold one.

A line key is made of the look-alike prototypes of the line's letters: digits,
case, spacing, punctuation, accents and the alphabet of a letter don't count.
A single misread letter (another letter, none, or two in its place) is allowed
for by joining keys that share their first or second half (one such edit leaves
one half whole), so no pair of keys is compared that can't be one edit apart.

A class is a centre with all readings one misreading away.  Its readings share one
of the centre's four halves (two per length), so a class on T pages has a half on
T/4 of them: only keys with such a half can be centres, and all readings of the
centres' halves, frequent or not, are then counted.  Centres are the most frequent
key of every such half and every key on ``centre_share`` of the needed pages.

Defined results: NULL texts, sources or pages give no rows; lines under
``min_letters`` letters are never repeated lines; a block delivered twice counts
once because pages, not rows, are counted; a book with no page has no lines; equal
page counts prefer the greater hash.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, stored
from .skeleton import PROTO


@dataclass(frozen=True)
class Rule:
    """A line is repeated when it stands on at least ``min_pages`` and ``min_share`` of its source's pages."""

    min_letters: int = 4
    min_pages: int = 5
    min_share: float = 0.04
    #: A class of readings is named by a reading that has at least this share of the needed pages.
    centre_share: float = 0.25


@lru_cache
def _fold() -> tuple[str, str]:
    """translate() table: every accented, full-width or look-alike capital -> its prototype, one character each."""
    src, dst = [], []
    ranges = [(0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFF21, 0xFF5B)]
    for lo, hi in ranges:
        for cp in range(lo, hi):
            c = chr(cp)
            base = unicodedata.normalize("NFKD", c.upper())
            base = "".join(x for x in base if not unicodedata.combining(x)).upper()
            base = base.translate(PROTO)
            if len(base) == 1 and base != c:
                src.append(c)
                dst.append(base)
    return "".join(src), "".join(dst)


def line_key(line: Column) -> Column:
    """Letters of the line as look-alike prototypes."""
    src, dst = _fold()
    up = F.upper(line)
    for a, b in (("ﬀ", "FF"), ("ﬁ", "FI"), ("ﬂ", "FL")):
        up = F.replace(up, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(up, src, dst), r"\P{L}+", "")


def lines_of(blocks: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(id, source, page, line_no, line, key) of every line with enough letters."""
    split = F.split(F.regexp_replace("text", "\r", ""), "\n", -1)
    base = blocks.where(F.col("text").isNotNull() & F.col("source").isNotNull() & F.col("page").isNotNull())
    rows = base.select("id", "source", "page", F.posexplode(split).alias("line_no", "line"))
    keyed = rows.withColumn("key", line_key(F.col("line")))
    return keyed.where(F.length("key") >= rule.min_letters)


#: Columns that name a line of a source: two 64-bit hashes of its key.
LINE = ("source", "h", "k")
HALVES = ("p0", "s0", "p1", "s1")


def line_table(lines: DataFrame) -> DataFrame:
    """(id, line_no, source, page, h, k, halves, key) of a batch of lines, written once."""
    return stored(lines.select("id", "line_no", "source", "page", F.xxhash64("key").alias("h"), F.xxhash64(F.lit("2"), "key").alias("k"), *_halves(), "key"))


def on_pages(table: DataFrame) -> DataFrame:
    """Distinct (line, halves, page) of a line table."""
    return table.select(*LINE, *HALVES, "page").distinct()


def count_table(table: DataFrame) -> DataFrame:
    """(line, halves, pages): on how many pages of its source each line stands."""
    return on_pages(table).groupBy(*LINE, *HALVES).agg(F.count("*").alias("pages"))


def merge_counts(counts: DataFrame, state: DataFrame, delta: DataFrame) -> DataFrame:
    """The count table with a batch added: only places the stored tables don't have are counted, so a batch may come twice."""
    new = on_pages(delta).join(state.select(*LINE, "page"), [*LINE, "page"], "left_anti").groupBy(*LINE, *HALVES).agg(F.count("*").alias("pages"))
    return counts.unionByName(new).groupBy(*LINE, *HALVES).agg(F.sum("pages").alias("pages"))


def _halves() -> list[Column]:
    """Hashes of the halves that two keys one edit apart share, for this length and for one less."""
    n = F.length("key")
    out = []
    for less, names in ((0, ("p0", "s0")), (1, ("p1", "s1"))):
        m = n - less
        half = (m / 2).cast("int")
        out += [
            F.xxhash64(F.lit("p"), m, F.substring("key", F.lit(1), half)).alias(names[0]),
            F.xxhash64(F.lit("s"), m, F.substring("key", n - half + 1, half)).alias(names[1]),
        ]
    return out


def one_misreading(a: Column, b: Column) -> Column:
    """Equal but for one letter that was changed, lost, added, or read as two."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    at = F.sequence(F.lit(1), F.length(short))
    split = F.exists(at, lambda i: (F.substring(short, F.lit(1), i - 1) == F.substring(long, F.lit(1), i - 1)) & (F.substring(short, i + 1, F.length(short)) == F.substring(long, i + 2, F.length(long))))
    gap = F.length(long) - F.length(short)
    return (gap <= 1) & ((F.levenshtein(a, b, 1) >= 0) | ((gap == 1) & (F.levenshtein(a, b, 2) >= 0) & split))


def merge(state: DataFrame | None, delta: DataFrame) -> DataFrame:
    """The stored line tables with a batch appended."""
    return delta if state is None else state.unionByName(delta)


def page_table(blocks: DataFrame) -> DataFrame:
    """Distinct (source, page) of all pages that have blocks."""
    return blocks.where(F.col("source").isNotNull() & F.col("page").isNotNull()).select("source", "page").distinct()


def page_counts(blocks: DataFrame) -> DataFrame:
    """(source, n_pages) of all pages that have blocks."""
    return page_table(blocks).groupBy("source").agg(F.count("*").alias("n_pages"))


def needed(rule: Rule) -> Column:
    return F.greatest(F.lit(rule.min_pages), F.ceil(F.col("n_pages") * rule.min_share - 1e-9))


def _spread(df: DataFrame, *keep: str) -> DataFrame:
    """One row per half of a line."""
    return df.select(*keep, F.explode(F.array_distinct(F.array(*HALVES))).alias("half"))


def centres(counts: DataFrame, n_pages: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(source, ch, ck, half): lines that can be the centre of a class above the threshold, by their halves."""
    wide = _spread(counts, *LINE, "pages", *HALVES)
    halves = wide.groupBy("source", "half").agg(F.sum("pages").alias("n"), F.max_by(F.struct("h", "k", *HALVES), F.struct("pages", "h", "k")).alias("top"))
    halves = halves.where(F.col("n") * 4 >= rule.min_pages)  # before the join, so that a hot source brings few rows to it
    heavy = halves.join(n_pages, "source").where(F.col("n") * 4 >= needed(rule)).select("source", "top.*")
    strong = counts.where(F.col("pages") >= rule.min_pages * rule.centre_share).join(n_pages, "source").where(F.col("pages") >= needed(rule) * rule.centre_share)
    both = heavy.unionByName(strong.select(*heavy.columns)).distinct().withColumnsRenamed({"h": "ch", "k": "ck"})
    return _spread(both, "source", "ch", "ck")


def repeated(table: DataFrame, n_pages: DataFrame, rule: Rule = Rule(), counts: DataFrame | None = None) -> DataFrame:
    """(source, h, k, ch, ck, class_pages): every reading of a line above the threshold, with the centre of its class.

    ``table`` is the stored line table, ``n_pages`` the pages of each source; nothing else is read.
    """
    counts = cut_lineage(count_table(table)) if counts is None else counts
    near = _spread(counts, *LINE, "pages").join(centres(counts, n_pages, rule), ["source", "half"]).select("source", "ch", "ck", "h", "k", "pages").distinct()
    # no class has more pages than its readings together
    most = near.groupBy("source", "ch", "ck").agg(F.sum("pages").alias("most")).join(n_pages, "source").where(F.col("most") >= needed(rule)).select("source", "ch", "ck")
    near = cut_lineage(near.join(most, ["source", "ch", "ck"]).drop("pages"))
    asked = near.select(*LINE).union(near.select("source", "ch", "ck")).distinct()
    keys = cut_lineage(table.select(*LINE, "key").join(asked, list(LINE), "left_semi").distinct())
    read = near.join(keys, list(LINE)).join(keys.select("source", F.col("h").alias("ch"), F.col("k").alias("ck"), F.col("key").alias("centre")), ["source", "ch", "ck"])
    read = read.where(one_misreading(F.col("key"), F.col("centre"))).select("source", "ch", "ck", "h", "k")
    pages = read.join(table.select(*LINE, "page").distinct(), list(LINE)).select("source", "ch", "ck", "page").distinct()
    full = pages.groupBy("source", "ch", "ck").agg(F.count("*").alias("class_pages")).join(n_pages, "source").where(F.col("class_pages") >= needed(rule)).drop("n_pages")
    best = F.max_by(F.struct("ch", "ck", "class_pages"), F.struct("class_pages", "ch", "ck")).alias("c")
    return read.join(full, ["source", "ch", "ck"]).groupBy(*LINE).agg(best).select(*LINE, "c.*")


def crossings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(line, crossed): readings that a batch lifted over the threshold, or left behind as the source grew (crossed false)."""
    up = after.select(*LINE).join(before, list(LINE), "left_anti").withColumn("crossed", F.lit(True))
    down = before.select(*LINE).join(after, list(LINE), "left_anti").withColumn("crossed", F.lit(False))
    return up.unionByName(down)


def found(table: DataFrame, rep: DataFrame) -> DataFrame:
    """(id, line_no) of the lines that belong to a repeated class."""
    return table.select("id", "line_no", *LINE).join(rep.select(*LINE), list(LINE), "left_semi").select("id", "line_no").distinct()


def rebuild(blocks: DataFrame, table: DataFrame, rep: DataFrame, changed: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """(id, clean): the documents that hold a repeated line, without it.

    After a batch these are the old documents with a line that ``changed`` names, and those of the batch's own line
    table ``fresh`` with any repeated line.

    Which documents and which lines they lose is read from the line table; the texts of no other document are needed.
    """
    hits = found(table, rep).groupBy("id").agg(F.collect_set("line_no").alias("drop_lines"))
    if changed is not None:
        again = found(table, changed).select("id")
        again = again if fresh is None else again.union(found(fresh, rep).select("id"))
        hits = again.distinct().join(hits, "id", "left").withColumn("drop_lines", F.coalesce("drop_lines", F.array().cast("array<int>")))
    split = F.split(F.regexp_replace("text", "\r", ""), "\n", -1)
    kept = F.filter(F.transform(split, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("drop_lines", s["i"]))
    return blocks.select("id", "text").dropDuplicates(["id"]).join(hits, "id").select("id", F.array_join(F.transform(kept, lambda s: s["x"]), "\n").alias("clean"))
