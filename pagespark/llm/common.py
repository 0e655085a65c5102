"""Helpers shared by the training-text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories whose text is not running text (fixed values of the data model).
NON_TEXT = ("Table", "Formula", "Picture")
#: Categories that hold prose (fixed values of the data model).
PROSE = ("Text", "List-item", "Footnote", "Caption", "Page")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Scan one parquet table, reading only ``cols`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def in_category(cats: Sequence[str]) -> Column:
    return F.col("category").isin(*cats)


def textual() -> Column:
    """Blocks that are not tables, formulas or pictures; a NULL category counts as text."""
    return ~F.coalesce(F.col("category"), F.lit("")).isin(*NON_TEXT)


def map_frames(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``mapInPandas`` over Arrow batches with one frame in, one frame out."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def melt_fields(df: DataFrame, key: str, fields: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per (key, field, value) for the non-NULL values of ``fields``."""
    structs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    out = df.select(key, *extra, F.explode(F.filter(structs, lambda s: s["value"].isNotNull())).alias("_s"))
    return out.select(key, *extra, "_s.field", "_s.value")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the cluster's shared checkpoint folder and read it from there; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``.

    Where that is unset, a session that runs in one process (as in tests) gets a temporary one; on a cluster a folder
    of one machine would lose what others write, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagespark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """The frame written as a column table in the shared folder: later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows with the least hash of their key.

    A hash threshold lets about a quarter more than that through, so that no task holds or sends more than its share;
    only where it lets too few through is the whole sorted.
    """
    n = rows.count()
    h = F.xxhash64(key)
    first = rows
    if n > 2 * size:
        cut = min(2**63 - 1, int(-(2**63) + 1.25 * (size + 40) / n * 2**64))
        few = rows.where(h < F.lit(cut))
        first = few if few.count() >= size else rows
    return first.orderBy(h, key).limit(size)


def memo(fn: Callable[[str], object], limit: int = 50_000) -> Callable[[str], object]:
    """Remember results by text; the store is emptied when it holds ``limit`` texts."""
    store: dict[str, object] = {}

    def call(text: str) -> object:
        try:
            return store[text]
        except KeyError:
            if len(store) >= limit:
                store.clear()
            out = store[text] = fn(text)
            return out

    return call
