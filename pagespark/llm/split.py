"""Problem 3: splitting oversized items at natural boundaries.

Method: bounded-quantifier regular expression.  The alternatives are ordered by
the strength of the boundary that ends a piece (paragraph, line or table row,
sentence, clause, word), each consuming about half of the limit at least and
all of it at most; the last alternative takes the limit in plain characters, so every text
is cut.  A piece after the first begins with the last ``overlap`` characters before
its core, put together from the few cores before it; the core of a piece
is therefore at most ``limit - overlap`` long.  Everything is SQL functions on
arrays, without Python, in time that grows with the length of the text.

Characters are code points, which is what Java's classes count.  Joining the cores
of the pieces gives the text back exactly.

Defined results: NULL texts and categories without a limit give no rows; a text
within the limit (or empty) is one piece; an overlap of NULL counts as 0, one as
large as the limit is cut to ``limit - 1``; a limit under 1 is an error; of several
limits of one category the first in order of size counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of a piece from the strongest boundary to the weakest; each is put behind a bounded run of characters.
BOUNDARIES = (
    r"\n[ \t]{0,4}\n{1,3}",  # paragraph
    r"(?:\n|</tr>|</table>)",  # line or table row
    r"[.!?…][\"»”)\]]{0,3}\s",  # sentence
    r"(?:[;:,]\s|\s[—–-]\s|</t[dh]>)",  # clause or table cell
    r"\s",  # word
)
#: Longest boundary in characters.
RESERVE = 8
#: A piece of at most <n> characters; short ones only look for a space.
_SHORT = r"[\s\S]{1,<n>}\z|[\s\S]{0,<n-1>}\s|[\s\S]{1,<n>}"
_LONG = "|".join([r"[\s\S]{1,<n>}\z", *[rf"[\s\S]{{<low>,<high>}}{b}" for b in BOUNDARIES], r"[\s\S]{1,<n>}"])
#: With at most this many limits every category has an expression of its own; with more they are joined as a table.
FEW = 64


def _piece(n: Column) -> Column:
    def filled(template: str, **numbers: Column) -> Column:
        c = F.lit(template)
        for name, value in numbers.items():
            c = F.replace(c, F.lit(f"<{name}>"), value.cast("string"))
        return c

    short = filled(_SHORT, n=n, **{"n-1": n - 1})
    return F.when(n <= 2 * RESERVE, short).otherwise(filled(_LONG, n=n, low=F.floor(n / 2) - RESERVE, high=n - RESERVE))


def pattern(limit: Column, overlap: Column) -> Column:
    """Expression that consumes one piece: ``limit`` characters at most for the first, ``limit - overlap`` for the others."""
    return F.concat(F.lit(r"\A(?:"), _piece(limit), F.lit(r")|\G(?:"), _piece(limit - overlap), F.lit(")"))


def cores(text: Column, limit: Column, overlap: Column) -> Column:
    """Array of consecutive pieces without overlap; their concatenation is the text."""
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.regexp_extract_all(text, pattern(limit, overlap), F.lit(0)))


def bound(fn: Callable[[Column], Column], **values: Column) -> Column:
    """``fn`` of a struct of the values, each worked out once however often ``fn`` names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn), F.lit(0))


def leads(cores: Column, overlap: Column) -> Column:
    """The last ``overlap`` characters before each core, from as many cores before it as can hold them."""
    sizes = F.transform(F.slice(cores, 1, F.greatest(F.size(cores) - 1, F.lit(1))), lambda p: F.length(p))
    reach = F.ceil(overlap / F.greatest(F.lit(1), F.array_min(sizes))).cast("int")

    def lead(s: Column, i: Column) -> Column:
        n = F.least(i, s["reach"])
        return F.when(n > 0, F.right(F.array_join(F.slice(s["cores"], i - n + 1, n), ""), s["overlap"])).otherwise("")

    return bound(lambda s: F.transform(s["cores"], lambda _, i: lead(s, i)), cores=cores, overlap=overlap, reach=reach)


def split_items(items: DataFrame, limits: DataFrame | list[tuple[str, int, int | None]], key: str = "id", text: str = "final", category: str = "category") -> DataFrame:
    """(key, piece_no, start, core_start, piece, n_chars): the pieces of every item, whole items included.

    ``limits`` holds (category, max_chars, overlap_chars), as a short list or as a table of any length.
    """
    rows = items.where(F.col(text).isNotNull() & F.col(category).isNotNull()).select(F.col(key), F.col(text).alias("_text"), F.col(category).alias("_cat"))
    if isinstance(limits, DataFrame):
        first = limits.where("category is not null and max_chars is not null").groupBy("category").agg(F.min(F.struct(F.col("max_chars").alias("limit"), F.coalesce("overlap_chars", F.lit(0)).alias("over"))).alias("_l"))
        checked = first.select(F.col("category").alias("_cat"), F.when(F.col("_l.limit") < 1, F.raise_error(F.lit("a limit is under 1")).cast("int")).otherwise(F.col("_l.limit")).alias("_limit"), F.least("_l.over", F.col("_l.limit") - 1).alias("_over"))
        cut = rows.join(checked, "_cat").select(key, "_over", cores(F.col("_text"), F.col("_limit"), F.col("_over")).alias("_cores"))
    else:
        found, over = F.lit(None).cast("array<string>"), F.lit(0)
        for cat, limit, overlap in sorted(limits, key=lambda x: (x[1], x[2] or 0), reverse=True):
            if limit < 1:
                raise ValueError(f"the limit of {cat} is {limit}")
            lap = F.lit(min(overlap or 0, limit - 1))
            here = F.col("_cat") == cat
            found = F.when(here, cores(F.col("_text"), F.lit(limit), lap)).otherwise(found)
            over = F.when(here, lap).otherwise(over)
        cut = rows.where(F.col("_cat").isin(*[c for c, _, _ in limits])).select(key, over.alias("_over"), found.alias("_cores"))
    parts = bound(lambda s: F.arrays_zip(s["cores"].alias("core"), leads(s["cores"], s["over"]).alias("lead"), starts(s["cores"]).alias("at")), cores=F.col("_cores"), over=F.col("_over"))
    led = cut.select(key, F.posexplode(parts).alias("piece_no", "_p")).select(key, "piece_no", "_p.core", "_p.lead", "_p.at")
    return led.select(
        key, "piece_no", (F.col("at") - F.length("lead")).cast("int").alias("start"), F.col("at").cast("int").alias("core_start"),
        F.concat("lead", "core").alias("piece"), (F.length("lead") + F.length("core")).alias("n_chars"),
    )


def starts(cores: Column, block: int = 64) -> Column:
    """Where each core begins: running sums within blocks of pieces on top of running sums of the blocks."""
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda acc, x: acc + x)
    part = lambda arr, b: F.slice(arr, b * block + 1, F.lit(block))

    def sums(s: Column) -> Column:
        return F.transform(s["blocks"], lambda b: total(part(s["sizes"], b)))

    def spread(s: Column) -> Column:
        return F.flatten(F.transform(s["blocks"], lambda b: _running(part(s["sizes"], b), total(F.slice(s["sums"], F.lit(1), b)))))

    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(cores) - 1) / block).cast("int"), F.lit(0)))
    return bound(lambda s: bound(spread, sizes=s["sizes"], blocks=s["blocks"], sums=sums(s)), sizes=F.transform(cores, lambda p: F.length(p)), blocks=blocks)


def _running(sizes: Column, before: Column) -> Column:
    """``before`` plus the sum of the sizes ahead of each; ``sizes`` is a short array."""
    ahead = lambda s, i: s["before"] + F.aggregate(F.slice(s["sizes"], F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return bound(lambda s: F.transform(s["sizes"], lambda _, i: ahead(s, i)), sizes=sizes, before=before)


def oversized(pieces: DataFrame, key: str = "id") -> DataFrame:
    """Keys of the items that were cut into several pieces."""
    return pieces.where(F.col("piece_no") == 1).select(key).distinct()
