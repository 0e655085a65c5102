"""Scores against a gold text, averages, best entries, and the statistics of a run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tables, text


def number_scores(rows: DataFrame, pred: Column, gold: Column, key: str) -> DataFrame:
    """(key, precision, recall, f1) of the number multisets of two texts of a row; within the row, without a shuffle."""
    both = rows.select(key, F.array_sort(text.numbers(pred)).alias("p"), F.array_sort(text.numbers(gold)).alias("g"))
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    hit = F.aggregate(F.array_distinct("p"), F.lit(0), lambda n, x: n + F.least(times(F.col("p"), x), times(F.col("g"), x)))
    s = both.select(key, hit.alias("hit"), F.size("p").alias("n_p"), F.size("g").alias("n_g"))
    none = (F.col("n_p") == 0) & (F.col("n_g") == 0)
    prec = F.when(none, 1.0).when(F.col("n_p") == 0, 0.0).otherwise(F.col("hit") / F.col("n_p"))
    rec = F.when(none, 1.0).when(F.col("n_g") == 0, 0.0).otherwise(F.col("hit") / F.col("n_g"))
    f1 = F.when(prec + rec == 0, 0.0).otherwise(2 * prec * rec / (prec + rec))
    return s.select(key, F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(f1, 6).alias("f1"))


@F.pandas_udf(T.DoubleType())
def word_error(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """Edit distance of the word lists over the gold length, at most 1."""

    def one(p: str | None, g: str | None) -> float:
        a, b = (p or "").split(), (g or "").split()
        if not b:
            return float(bool(a))
        return min(1.0, tables.levenshtein(a, b) / len(b))

    return pd.Series([one(p, g) for p, g in zip(pred, gold)], dtype="float64")


def concordance(places: list[int]) -> float | None:
    """Share of pairs in rising order; NULL with fewer than two places or only ties."""
    good = total = 0
    for i, a in enumerate(places):
        for b in places[i + 1 :]:
            if a != b:
                total += 1
                good += a < b
    return good / total if total else None


def averages(scores: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Mean of every metric (NULLs left out) and the number of rows, per group."""
    return scores.groupBy(*group).agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics], F.count("*").alias("rows"))


def best(scores: DataFrame, group: str, name: str, up: str, down: str) -> DataFrame:
    """(group, best): the name with the greatest ``up``, then the least ``down`` (NULL last), then the first name."""
    rank = F.struct(F.coalesce(up, F.lit(0.0)), -F.coalesce(down, F.lit(1.0)))
    top = scores.groupBy(group).agg(F.max(rank).alias("_r"))
    at = scores.withColumn("_r", rank).join(top, [group, "_r"])
    return at.groupBy(group).agg(F.min(name).alias("best"))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), digits)


def run_statistics(blocks: DataFrame) -> DataFrame:
    """One row per book: how its blocks were decided, failed and corrected."""
    decided = F.count_if(F.col("decision").isin("accept", "arbiter"))
    arb = F.count_if(F.col("decision") == "arbiter")
    return blocks.groupBy("book").agg(
        F.count("*").alias("blocks"),
        F.countDistinct("page").alias("pages"),
        decided.alias("decided"),
        arb.alias("arbitrated"),
        share(arb, decided).alias("arbitrated_share"),
        F.count_if(F.col("arbiter_status") == "rejected").alias("rejected"),
        F.count_if(F.col("arbiter_status") == "failed").alias("failed"),
        F.count_if(F.col("text_b").isNull() & (F.col("drafts_status") == "done")).alias("lost_drafts"),
        F.coalesce(F.sum(F.size("arbiter_fixes")), F.lit(0)).alias("fixes"),
        F.round(F.avg("cer_ab"), 6).alias("mean_cer"),
    )


def quality_report(stats: DataFrame) -> DataFrame:
    """(book, report): the figures of ``run_statistics`` as a Markdown table."""
    percent = lambda c: F.concat(F.format_string("%.1f", c * 100), F.lit(" %"))
    lines = [
        F.concat(F.lit("# Recognition quality: "), "book"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---|"), F.concat(F.lit("| Pages | "), F.col("pages"), F.lit(" |")),
        F.concat(F.lit("| Blocks | "), F.col("blocks"), F.lit(" |")), F.concat(F.lit("| Arbitrated share | "), percent(F.col("arbitrated_share")), F.lit(" ("), F.col("arbitrated"), F.lit(" of "), F.col("decided"), F.lit(") |")),
        F.concat(F.lit("| Answers rejected | "), F.col("rejected"), F.lit(" |")), F.concat(F.lit("| Failures | "), F.col("failed"), F.lit(" |")), F.concat(F.lit("| Lost drafts | "), F.col("lost_drafts"), F.lit(" |")),
        F.concat(F.lit("| Misprint fixes | "), F.col("fixes"), F.lit(" |")),
    ]
    return stats.select("book", F.array_join(F.array(*lines), "\n").alias("report"))


def comparison_report(scores: DataFrame, group: str, name: str, up: str, down: str) -> DataFrame:
    """(group, report): entries of every group as a Markdown table, best first: greatest ``up``, then least ``down`` (NULL last)."""
    shown = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("—"))
    rank = F.struct((-F.coalesce(up, F.lit(0.0))).alias("a"), F.coalesce(down, F.lit(1.0)).alias("b"), F.col(name).alias("c"), F.concat(F.lit("| "), name, F.lit(" | "), F.when(F.col(up).isNull(), "—").otherwise(shown(up)), F.lit(" | "), F.when(F.col(down).isNull(), "—").otherwise(shown(down)), F.lit(" |")).alias("row"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(rank)), lambda r: r["row"]), "\n")
    return scores.groupBy(group).agg(F.concat(F.lit(f"| {name} | {up} | {down} |\n|---|---|---|\n"), rows).alias("report"))
