"""Reading what a run leaves behind: journals, reports, manifests, listings."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

# File kinds that hold books.
BOOK_SUFFIXES = ("pdf", "djvu", "djv")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """(file, fix fields...) of every journal; a damaged file fails the read."""
    raw = spark.read.schema(schemas.JOURNAL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.input_file_name().alias("file"), F.explode("fixes").alias("f")).select("file", "f.*")


def write_journals(fixes: DataFrame, path: str) -> None:
    """Fixes as one JSON document per book, ordered by id, under ``path/book=.../``."""
    cols = [c for c in fixes.columns if c != "book"]
    doc = fixes.groupBy("book").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("fixes"))
    doc.select("book", F.lit(1).alias("version"), "fixes").write.mode("overwrite").partitionBy("book").json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, suffix, accepted, reason) of every file under a folder; contents are not read, empty files not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    bad = F.when(~suffix.isin(*BOOK_SUFFIXES), F.concat(F.lit("unsupported format: "), suffix))
    return files.select("path", F.regexp_replace(name, r"\.[^.]+$", "").alias("name"), suffix.alias("suffix"), bad.isNull().alias("accepted"), bad.alias("reason"))


def enqueue(found: DataFrame, known: DataFrame) -> DataFrame:
    """Accepted files that are new: unknown path and name, the first of each name in path order."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    fresh = found.where("accepted").withColumn("_n", first).where("_n = 1").drop("_n")
    return fresh.join(known.select("name").distinct(), "name", "left_anti").join(known.select("path").distinct(), "path", "left_anti")


def scan_numbers(spec: str | None) -> list[int] | None:
    """``0,5,10-12`` as numbers; None for no choice; a falling range is an error."""
    if spec is None:
        return None
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"not a scan or range of scans: {part!r}")
        out += range(int(m[1]), int(m[2] or m[1]) + 1)
    return out


def even_sample(pages: DataFrame, k: int) -> DataFrame:
    """``k`` pages of each book spread evenly over it, first and last included (half-even rounding)."""
    w = Window.partitionBy("book")
    n = F.count("*").over(w)
    pos = F.row_number().over(w.orderBy("idx", "name")) - 1
    rows = pages.withColumn("_n", n).withColumn("_p", pos)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(1, k - 1)), 0).cast("int"))
    return rows.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_p"))).drop("_n", "_p")


MANIFEST = "id string, book string, scan int, side string, categories array<string>, lang string"


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """Gold pages of a TOML manifest (``[[page]]`` tables); an id twice is an error."""
    pages: Iterable[dict] = tomllib.loads(text).get("page", [])
    rows = [(p["id"], p["book"], int(p["scan"]), p.get("side", ""), list(p.get("categories", [])), p.get("lang", "ru")) for p in pages]
    ids = [r[0] for r in rows]
    if twice := {i for i in ids if ids.count(i) > 1}:
        raise ValueError(f"ids that stand twice in the manifest: {sorted(twice)}")
    return spark.createDataFrame(rows, MANIFEST)


def sections(reports: DataFrame) -> DataFrame:
    """(file, heading, line_no, line) of Markdown reports: the lines under each second-level heading.

    Of a heading that stands twice the last counts.
    """
    rows = reports.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("file").orderBy("line_no")
    head = F.when(F.col("line").startswith("## "), F.struct(F.trim(F.substring("line", 4, 1000)).alias("heading"), "line_no"))
    under = rows.withColumn("h", F.last(head, True).over(w)).where(F.col("h").isNotNull() & ~F.col("line").startswith("## "))
    last = F.max("h.line_no").over(Window.partitionBy("file", "h.heading"))
    return under.withColumn("_last", last).where("h.line_no = _last").select("file", "h.heading", "line_no", "line")


def report_fixes(lines: DataFrame) -> DataFrame:
    """(file, id, scan, page, was, now, state, reason, suggested) of the rows of a corrections table in a report."""
    cells = F.transform(F.split(F.trim("line"), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    rows = lines.where(F.col("line").startswith("| ")).withColumn("c", cells).where("size(c) = 5")
    ref = r"^(\w+)(?: \((?:p\.|с\.) ([^)]+)\))?$"
    rows = rows.where(F.get("c", F.lit(1)).rlike(ref) & ~F.get("c", F.lit(1)).isin("Page", "Страница"))
    cell = F.get("c", F.lit(3))
    part = lambda p, g: F.nullif(F.regexp_extract(cell, p, g), F.lit(""))
    reverted, missing, review = r"^~~(.*)~~ \*{0,2}reverted\*{0,2}(?:: (.*))?$", r"^(.*) \(not found in book\.md\)$", r"^(.*) \(review: (.*)\)$"
    state = F.when(cell.rlike(reverted), "reverted").when(cell.rlike(missing), "not_found").otherwise("applied")
    now = F.when(cell.rlike(reverted), F.regexp_extract(cell, reverted, 1)).when(cell.rlike(missing), F.regexp_extract(cell, missing, 1)).when(cell.rlike(review), F.regexp_extract(cell, review, 1)).otherwise(cell)
    out = rows.select("file", "line_no", F.regexp_extract(F.get("c", F.lit(1)), ref, 1).alias("scan"), F.nullif(F.regexp_extract(F.get("c", F.lit(1)), ref, 2), F.lit("")).alias("page"), F.get("c", F.lit(2)).alias("was"), now.alias("now"), state.alias("state"), F.coalesce(part(reverted, 2), part(review, 2)).alias("reason"), cell.rlike(review).alias("suggested"))
    n = F.row_number().over(Window.partitionBy("file", "scan").orderBy("line_no"))
    return out.withColumn("id", F.concat_ws("-", "scan", n)).drop("line_no")


def fixes_table(fixes: DataFrame) -> DataFrame:
    """(book, section): the corrections of every book as the rows of a Markdown table, by scan and id."""
    esc = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    ref = F.when(F.col("page").isNotNull(), F.concat(F.col("scan"), F.lit(" (p. "), F.col("page"), F.lit(")"))).otherwise(F.col("scan"))
    now: Column = (
        F.when(F.col("state") == "reverted", F.concat(F.lit("~~"), esc(F.col("now")), F.lit("~~ reverted"), F.coalesce(F.concat(F.lit(": "), F.col("reason")), F.lit(""))))
        .when(F.col("state") == "not_found", F.concat(esc(F.col("now")), F.lit(" (not found in book.md)")))
        .when(F.col("suggested"), F.concat(esc(F.col("now")), F.lit(" (review: "), F.coalesce("reason", F.lit("")), F.lit(")")))
        .otherwise(esc(F.col("now")))
    )
    row = F.concat(F.lit("| "), ref, F.lit(" | "), esc(F.col("was")), F.lit(" | "), now, F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("scan", "id", row.alias("row")))), lambda s: s["row"])
    return fixes.groupBy("book").agg(F.array_join(lines, "\n").alias("section"))
