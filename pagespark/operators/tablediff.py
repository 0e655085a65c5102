"""Comparing and merging keyed tables: sync, incremental loads, sets with repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sync(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, removed or changed rows between two versions; NULLs are equal to each other."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def wanted(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are still to be loaded."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def last_value(rows: DataFrame, keys: list[str], value: str, version: str) -> DataFrame:
    """Last write wins: the value of the highest version per key."""
    return rows.groupBy(*keys).agg(F.max_by(value, version).alias(value))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def multiset_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def united(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of all parts, each key once."""
    out = parts[0].select(*keys)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys))
    return out.distinct()


def is_subset(part: DataFrame, whole: DataFrame, keys: list[str]) -> bool:
    """Does ``whole`` have every key of ``part``?  NULL keys count as keys."""
    on = [part[k].eqNullSafe(whole[k]) for k in keys]
    return part.join(whole, on, "left_anti").isEmpty()


def appended(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows of the parts one behind the other, with their place: by part, then by ``order``."""
    rows = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    before = out.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return out.withColumn("_at", within).join(F.broadcast(before.drop("_n")), "_part").withColumn("place", F.col("_base") + F.col("_at")).drop("_part", "_base", "_at")
