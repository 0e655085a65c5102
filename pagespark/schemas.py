"""Schemas of the page and block store, and readers that keep one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
FIXES = "array<struct<was:string,now:string,rejected:string>>"
PAGES = "book string, name string, idx int, scan int, side string, file string, width int, height int, blank boolean, layout_status string, layout_error string, layout_seconds double, printed string"
BLOCKS = (
    f"id bigint, book string, page string, ord int, category string, kind string, bbox {BOX}, text_a string, image string, parent bigint, "
    "sketches array<struct<path:string,bbox:array<int>>>, sketches_status string, sketches_error string, text_b string, b_error string, b_seconds double, "
    "drafts_status string, decision string, cer_ab double, consensus_status string, arbiter_text string, arbiter_raw string, arbiter_error string, "
    f"arbiter_note string, arbiter_seconds double, arbiter_cer double, arbiter_fixes {FIXES}, arbiter_status string, final string, final_source string, fixes {FIXES}, origin string"
)
JOURNAL = "version int, book string, created string, fixes array<struct<id:string,scan:string,page:string,block:bigint,kind:string,was:string,now:string,state:string,suggested:boolean,reason:string,decided_by:string,before:string,after:string,crop:string>>"
# Categories and kinds of the data model.
CATEGORIES = ("Text", "Title", "Section-header", "List-item", "Caption", "Footnote", "Formula", "Table", "Picture", "Page-header", "Page-footer", "Page")
KIND_OF = {"Text": "text", "Title": "title", "Section-header": "title", "List-item": "list", "Caption": "caption", "Footnote": "footnote", "Formula": "formula", "Table": "table", "Page": "page"}


def scan(spark: SparkSession, d: str, name: str, *cols: str | Column) -> DataFrame:
    """One parquet table with only the named columns."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*cols) if cols else df


def kind_of(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])[category]


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``, which has to be total up to equal rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages with one row per (book, name): a finished layout wins, then the longer one, then the printed number."""
    cols = ["book", "name", "idx", "scan", "side", "height", "width", "blank", "layout_status", "layout_seconds", "printed"]
    order = [F.desc(F.col("layout_status") == "done"), F.desc_nulls_last("layout_seconds"), F.desc_nulls_last("printed"), F.desc_nulls_last("idx"), F.desc_nulls_last("height")]
    return latest(scan(spark, d, "pages", *cols), ["book", "name"], *order)


def block_rows(spark: SparkSession, d: str, *cols: str, heavy: bool = False) -> DataFrame:
    """Blocks with one row per id; whole rows are repeated, so any of them will do.

    ``heavy`` is for queries that spend long on each row: adaptive coalescing goes by bytes and would leave few, long tasks,
    so the same one shuffle gets as many partitions as the scan has splits (these grow with the input), at least one per core.
    """
    rows = scan(spark, d, "blocks", "id", *cols)
    if heavy:
        splits = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
        rows = rows.repartition(splits, "id")
    return rows.dropDuplicates(["id"])
